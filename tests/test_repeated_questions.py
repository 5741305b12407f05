"""Questions whose ids are the same against the SQL engine."""

import shutil

import duckdb

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"


def test_sources_of_questions_with_the_same_id(spark, tmp_path):
    """Turn 100 of one conversation has the id of turn 0 of the next; a turn may be there twice, and without a text."""
    rows = [(1, 100, "user", "why the crash"), (2, 0, "user", "wifi dropped"), (2, 0, "user", "wifi dropped"), (2, 1, "user", "and now"), (2, 3, "user", None), (2, 0, "assistant", "so")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shutil.copy(f"{SF}/events.parquet", tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(f"SELECT question_id, capture_id, sources FROM ({registry.oracle_sql()['batch_evidence_sources']})").fetchall()
    got = registry.queries()["batch_evidence_sources"](spark, str(tmp_path))
    assert got.columns == ["question_id", "capture_id", "sources"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 5
