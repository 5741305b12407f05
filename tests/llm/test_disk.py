"""What near duplicates keep on disk."""

from tracewell.llm import near_duplicates


def test_postings_are_in_their_shuffle_alone(spark, monkeypatch):
    """No table of postings stands beside the shuffle that deals them; every document comes through it, empty ones too."""
    names, whole = [], near_duplicates.written
    monkeypatch.setattr(near_duplicates, "written", lambda df, name: names.append(name) or whole(df, name))
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "a b"), (4, ""), (None, text), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 36, 1), (2, 37, 1), (3, 1, 3), (4, 0, 4), (None, 36, 1), (5, 0, 5)], key=repr)
    assert "candidates" in names and "postings" not in names
