"""Incremental ingest: batches, failures, restarts."""

import numpy as np
import pytest

from lantern.streaming import ingest

SCHEMA = "file string, doc_id string, text string, error string, at string"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """These tables are tiny: two tasks a shuffle, and two state stores."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def embed(texts):
    if any("poison" in t for t in texts):
        raise ValueError("the model can't take this")
    return np.array([[len(t), len(t.encode())] for t in texts], np.float32)


def batch(spark, *rows):
    return spark.createDataFrame([(f, d, t, e, at) for f, d, t, e, at in rows], SCHEMA)


FIRST = [("a.md", "a.md", "one two three. four five", None, "1"), ("b.md", "b.md#1", "page one", None, "1"), ("b.md", "b.md#2", "page two", None, "1"), ("c.md", "c.md", "gone soon", None, "1"), ("e.md", "e.md", None, None, "1")]
SECOND = [("b.md", "b.md#1", "page one changed", None, "2"), ("c.md", "c.md", None, "broken", "2"), ("d.md", "d.md", "old text", None, "2"), ("d.md", "d.md", "new text", None, "3"), ("a.md", "a.md", "one two three. four five", None, "2")]


def job(path, model=embed):
    return ingest.Ingest(str(path), model, size=16, overlap=2)


def state(spark, folder):
    points = sorted((r["doc_id"], r["number"], r["text"], r["id"], tuple(r["vector"])) for r in ingest.snapshot(spark, folder).collect())
    return points, sorted((r["doc_id"], r["status"], r["hash"]) for r in ingest.documents(spark, folder).collect())


def test_states_and_snapshot(spark, tmp_path):
    own = job(tmp_path)
    ingest.ingested(batch(spark, *FIRST), own, 1000)
    ingest.ingested(batch(spark, *SECOND), own, 2000)
    points, docs = state(spark, own.folder)
    assert {p[0]: p[2] for p in points} == {"a.md": "one two three. four five", "b.md#1": "page one changed", "d.md": "new text"}
    assert [d[:2] for d in docs] == [("a.md", "live"), ("b.md#1", "live"), ("d.md", "live"), ("e.md", "live")]
    said = {(r["v"], r["file"]): (r["state"], r["documents"], r["error"]) for r in ingest.reports(spark, own.folder).collect()}
    assert said[1000, "b.md"] == ("new", 2, None) and said[2000, "a.md"][0] == "unchanged" and said[2000, "b.md"] == ("changed", 1, None)
    assert said[2000, "c.md"] == ("failed", 0, "broken") and said[2000, "d.md"] == ("new", 1, None)
    ingest.ingested(batch(spark, *[(f, d, t, e, "9") for f, d, t, e, _ in SECOND if e is None and t != "old text"]), own, 3000)
    assert state(spark, own.folder) == (points, docs)  # a second run: all unchanged
    assert {r["state"] for r in ingest.reports(spark, own.folder).filter("v = 3000").collect()} == {"unchanged"}


@pytest.mark.parametrize("at", ["docs", "commits"])
def test_a_batch_that_dies_midway_and_runs_again(spark, tmp_path, monkeypatch, at):
    clean, own = job(tmp_path / "clean"), job(tmp_path / "own")
    for j in (clean, own):
        ingest.ingested(batch(spark, *FIRST), j, 1000)
    before, write = state(spark, own.folder), ingest._write

    def dies(df, folder, name, version):
        write(df, folder, name, version) if name != at else (_ for _ in ()).throw(OSError("killed"))

    monkeypatch.setattr(ingest, "_write", dies)
    with pytest.raises(OSError):
        ingest.ingested(batch(spark, *SECOND), own, 2000)
    assert state(spark, own.folder) == before  # nothing of it is seen
    monkeypatch.undo()
    for _ in range(2):  # and again after its commit
        ingest.ingested(batch(spark, *SECOND), own, 2000)
    ingest.ingested(batch(spark, *SECOND), clean, 2000)
    assert state(spark, own.folder) == state(spark, clean.folder)


def test_failing_model_leaves_documents_pending(spark, tmp_path):
    own = job(tmp_path)
    ingest.ingested(batch(spark, ("a.md", "a.md", "fine", None, "1"), ("p.md", "p.md", "fine too", None, "1")), own, 1000)
    ingest.ingested(batch(spark, ("p.md", "p.md", "some poison", None, "2"), ("q.md", "q.md", "clean", None, "2")), own, 2000)
    points, docs = state(spark, own.folder)
    assert {p[0] for p in points} == {"a.md", "q.md"} and [d[:2] for d in docs] == [("a.md", "live"), ("p.md", "pending"), ("q.md", "live")]
    assert "ValueError" in ingest.documents(spark, own.folder).filter("doc_id = 'p.md'").first()["error"]
    mended = job(tmp_path, lambda texts: np.ones((len(texts), 2), np.float32))
    ingest.ingested(batch(spark, ("z.md", "z.md", "another", None, "3")), mended, 3000)
    points, docs = state(spark, own.folder)
    assert ("p.md", 0, "some poison") in {p[:3] for p in points} and {d[1] for d in docs} == {"live"}
    assert ingest.reports(spark, own.folder).filter("v = 3000 AND file = 'p.md'").first()["state"] == "retried"


def test_removed_files_and_compaction(spark, tmp_path):
    own = job(tmp_path)
    ingest.ingested(batch(spark, *FIRST), own, 1000)
    ingest.removed(spark, own, spark.createDataFrame([("a.md",), ("c.md",)], "file string"))
    points, docs = state(spark, own.folder)
    assert [d[0] for d in docs] == ["a.md", "c.md"]
    ingest.compacted(spark, own)
    assert state(spark, own.folder) == (points, docs) and len(ingest.versions(spark, own.folder)) == 1
    ingest.ingested(batch(spark, ("b.md", "b.md", "back", None, "5")), own, 2000)
    assert [d[0] for d in state(spark, own.folder)[1]] == ["a.md", "b.md", "c.md"]


def test_stream_of_files(spark, tmp_path):
    root, own = tmp_path / "corpus", job(tmp_path / "index")

    def deliver(name, files):
        for file, text in files.items():
            (root / name / file).parent.mkdir(parents=True, exist_ok=True)
            (root / name / file).write_text(text)
        ingest.ingest(ingest.corpus_files(spark, str(root)), own).trigger(availableNow=True).start().awaitTermination()

    deliver("2024-01", {"faq/a b.md": "alpha\r\n\n\n\nbeta", "x.html": "<html><body><article>Page text</article></body></html>", "y.bin": "?"})
    deliver("2024-02", {"faq/a b.md": "alpha changed"})
    points, docs = state(spark, own.folder)
    assert {p[0]: p[2] for p in points} == {"faq/a b.md": "alpha changed", "x.html": "Page text"}
    said = {(r["v"], r["file"]): (r["state"], r["error"]) for r in ingest.reports(spark, own.folder).collect()}
    assert said[1000, "y.bin"] == ("failed", "unsupported: bin") and said[2000, "faq/a b.md"] == ("changed", None)


def test_equal_chunks_go_through_the_model_once_and_move_once(spark, tmp_path):
    """Chunks keep their rows, a text of many documents is embedded once across Arrow batches, and one shuffle is enough."""
    from lantern.streaming import ingest

    seen = spark.sparkContext.accumulator(0)

    def embed(found):
        seen.add(len(found))
        return [[float(len(t))] for t in found]

    rows = [(f"d{i}", 0, "x" * (i % 3 + 1), 1, f"k{i % 3}") for i in range(50)]
    chunks = spark.createDataFrame(rows, "doc_id string, number int, text string, tokens long, key string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = ingest._embedded(chunks, ingest.Ingest(str(tmp_path), embed, batch=2))
        assert sorted((r["doc_id"], r["text"], r["vector"], r["error"]) for r in found.collect()) == sorted((d, t, [float(len(t))], None) for d, _, t, _, _ in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen.value == 3
