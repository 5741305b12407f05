"""Capture files listed and planned by tasks: the driver names no file, and folders ``key=value`` are read too."""

import pickle
import zipfile

from tracewell.plans import fixtures
from tracewell.sources import capture_source, captures


def test_units_are_planned_by_tasks(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"shard={i % 3}"
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"capture-{i}.zip", "w") as z:
            z.writestr("bugreport-a.txt", f"first {i}\nlast")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.doc").write_text("in no folder that is read")
    path, options = str(tmp_path), {"table": "lines", "roles": "report"}
    plan = captures.planned(spark, path, captures.listing(spark, path), options)
    reader = capture_source.CaptureReader(["line"], options | {"path": path, "plan": plan})
    parts = reader.partitions()
    assert not any(p.units for p in parts) and len(parts) <= captures.at_most(spark) and len(pickle.dumps(parts)) < 300 * 20
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 600
    assert sorted(r.line for r in captures.report_lines(spark, path).where("line_no = 1").collect()) == sorted(f"first {i}" for i in range(300))


def test_keys_of_files_do_not_go_through_the_driver(spark):
    """Not even where they are few enough for Spark to broadcast them."""
    folder = fixtures.texts(spark, spark.createDataFrame([(i, f"line {i}") for i in range(9)], "key long, text string"))
    rows = fixtures.keyed(spark, folder, captures.report_lines(spark, folder))
    assert sorted((r.capture_id, r.line) for r in rows.collect()) == [(i, f"line {i}") for i in range(9)]
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_counts_of_many_ranges_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    """Not even where Spark finds them few enough to broadcast while it runs the join."""
    monkeypatch.setattr(captures, "MOST_RANGES", 4)
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("".join(f"line {n}\n" for n in range(20)))
    rows = captures.report_lines(spark, tmp_path.as_uri(), 16)
    assert sorted((r.line_no, r.line) for r in rows.collect()) == sorted((n + 1, f"line {n}") for n in range(20) for _ in range(3))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
