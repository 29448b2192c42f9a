"""Run files, the judge and semantic chunks on the cases that the queries' tables don't hold."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions import texts
from lantern.operators import chunking, judging
from lantern.sources import runs

SCHEMA = "id long, response string, contexts array<string>, config struct<a:int,b:string>, score double, n int"
HARD = [
    (1, 'a "quoted", text\r\nwith lines\rand é 日本語 🎉', ["x\ny", '"', ""], (1, None), 0.5, 3), (2, "", [], None, float("nan"), None), (3, None, None, (None, "é"), None, 0), (4, "  spaces  ", [None, "a"], None, -1e-300, 1),
    (5, "#no comment\\", ["\\", "a\\\"b"], None, 1.0, 2), (6, '"', ["null"], None, float("inf"), 2), (7, "null", ["x" * 5000], None, 0.1, 2), (8, "end,\n", [",;\t"], None, 3.0, 2),
]


def test_rows_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(HARD, SCHEMA)
    runs.written(rows.repartition(3), spark.createDataFrame([("a", {"score": 0.5})], "label string, metrics map<string,double>"), str(tmp_path), "a")
    assert runs.committed(spark, str(tmp_path)) == ["a"]
    got = {r["id"]: r for r in runs.rows_of(spark, str(tmp_path), "a", SCHEMA).collect()}
    for id_, response, contexts, config, score, n in HARD:
        r = got[id_]
        assert (r["response"], r["contexts"], r["config"] and tuple(r["config"]), r["n"], r["bad"]) == (response, contexts, config, n, [])
        assert math.isnan(r["score"]) if score is None or math.isnan(score) else r["score"] == score


def test_bad_cells_are_set_apart(spark):
    raw = spark.createDataFrame([("1", '["a"]', "0.5"), ("x", '["a"', "n/a"), (None, '{"a": 1}', None), ("4", "", "1")], "id string, contexts string, score string")
    got = [(r["id"], r["contexts"], r["bad"]) for r in runs.parsed(raw, T.StructType.fromDDL("id long, contexts array<string>, score double").fields).collect()]
    assert got == [(1, ["a"], []), (None, None, ["id", "contexts", "score"]), (None, None, ["contexts"]), (4, None, ["contexts"])]


@pytest.mark.parametrize("at", ["csv", "json"])
def test_a_killed_writer_leaves_nothing_readable(spark, tmp_path, monkeypatch, at):
    from pyspark.sql.readwriter import DataFrameWriter

    rows, summary, folder = spark.createDataFrame(HARD, SCHEMA), spark.createDataFrame([("a",)], "label string"), str(tmp_path)
    runs.written(rows.limit(1), summary, folder, "old")
    write = getattr(DataFrameWriter, at)

    def dies(self, path, *a, **b):
        if at == "csv" or path.endswith("/commits/run=new"):
            raise OSError("killed")
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, at, dies)
    with pytest.raises(OSError):
        runs.written(rows, summary, folder, "new")
    monkeypatch.undo()
    assert runs.committed(spark, folder) == ["old"]
    with pytest.raises(ValueError):
        runs.rows_of(spark, folder, "new", SCHEMA)
    runs.written(rows, summary, folder, "new")
    assert runs.rows_of(spark, folder, "new", SCHEMA).count() == len(HARD)
    assert runs.committed(spark, str(tmp_path / "none")) == []


def test_a_folder_of_runs(spark, tmp_path):
    metric = {"faithfulness": {"mean": 0.5, "n": 3, "nan": 1}}
    shapes = {
        "b.json": {"label": "two", "timestamp": "2024-02", "metrics": metric, "config": {"k": 1, "rerank": {"enabled": True}}, "judge": {"judge_model": "j"}}, "a.json": {"label": "one", "timestamp": "2024-02", "metrics": {}},
        "c.json": {"label": "early", "metrics": {"other": {"mean": None}}, "config": None}, "d.json": [1, 2], "e.json": {"metrics": metric}, "f.json": {"label": "x"},
    }
    for name, doc in shapes.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "g.json").write_text('{"label": "cut')
    (tmp_path / "h.json.partial").write_text("{}")
    got = runs.run_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["reason"]) for r in got if r["reason"]] == [("d.json", "not an object"), ("e.json", "no label"), ("f.json", "no metrics"), ("g.json", "not JSON")]
    assert [r["label"] for r in got if not r["reason"]] == ["early", "one", "two"]
    two = got[-1]
    assert two["metrics"]["faithfulness"]["n"] == 3 and two["config"] == {"k": "1", "rerank.enabled": "true"} and two["judge"] == {"judge_model": "j"}
    diff = {r["label"]: (r["changes"], r["warnings"]) for r in runs.config_diff(runs.run_files(spark, str(tmp_path)).filter("reason IS NULL"), "two", {"k": "2", "s": "no"}).collect()}
    assert diff == {"two": ("—", ""), "one": ("k 1→2, rerank.enabled true→—", "judge"), "early": ("k 1→2, rerank.enabled true→—", "judge")}


def test_judge_fails_on_one_row_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def judge(metric, inputs):
        calls.add(len(inputs))
        if any("bad" in x.get("question", "") for x in inputs):
            raise RuntimeError("judge  down")
        return [(None, "no\nidea") if x.get("question") == "open" else ("no" if metric == "has_citation" else 0.25) for x in inputs]

    schema = "id long, question string, response string, contexts array<string>, reference string"
    rows = [(1, "good", "an answer [1]", ["c"], "r"), (2, "bad", "an answer", ["c"], "r"), (3, "open", "an answer", ["c"], "r"), (4, "good", " \n", ["c"], "r"), (5, "good", "an answer [1]", [], "r"), (6, "good", "an answer", None, None), (7, "good", "an answer [1]", ["c"], "r"), (None, None, None, None, None)]
    found = judging.judged(spark.createDataFrame(rows, schema), judge).collect()
    got = {(r["id"], r["metric"]): (r["score"] if not math.isnan(r["score"]) else None, r["error"]) for r in found}
    assert len(found) == 5 * len(rows)
    assert got[1, "faithfulness"] == got[7, "faithfulness"] == (0.25, None) and got[1, "has_citation"] == (0.0, None)
    assert got[2, "context_recall"] == (None, "RuntimeError: judge down") and got[2, "has_citation"] == (0.0, None)
    assert got[3, "answer_relevancy"] == (None, "нет значения: no idea")
    assert {got[4, m] for m in judging.METRICS} == {got[None, m] for m in judging.METRICS} == {(None, judging.EMPTY)}
    assert got[5, "faithfulness"] == (None, judging.NO_CONTEXT) and got[5, "context_recall"] == (0.0, judging.NOTHING_FOUND) and got[6, "context_precision"] == (None, judging.NO_REFERENCE)
    asked = judging.judged(spark.createDataFrame([rows[0]] * 50, schema), judge)
    calls.value = 0
    assert asked.count() == 250 and calls.value <= 5  # once for each distinct input
    assert judging.judged(spark.createDataFrame([], schema), judge).count() == 0


def test_semantic_chunks_are_the_text(spark):
    docs = [(1, "One. Two! Three?  Four…\n\nFive. " * 20), (2, ""), (3, None), (4, "no end"), (5, "\n\n  \n"), (6, "Привет. Мир! «Да.» Нет."), (7, "Same. Same. Same. Same. Same. Same. ")]
    seen = spark.sparkContext.accumulator(0)

    def embed(found):
        seen.add(len(found))
        return np.array([[len(t), t.count("o"), 1] for t in found], np.float32)

    df = spark.createDataFrame(docs, "doc_id long, text string")
    chunks = chunking.semantic_chunks(df, embed).collect()
    for d, text in docs:
        own = sorted((c["number"], c["text"]) for c in chunks if c["doc_id"] == d)
        assert "".join(t for _, t in own) == (text or "") and [n for n, _ in own] == list(range(len(own)))
    assert len([c for c in chunks if c["doc_id"] == 1]) > 1
    seen.value = 0
    assert chunking.semantic_chunks(df.filter("doc_id = 7"), embed).count() >= 1 and seen.value <= 3 * 2  # distinct groups, for the two uses of the distances


def _shuffled(df):
    """The columns and the partitioning of every exchange of the plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+\(.*?)#", plan)
    return [({c.split("#")[0] for c in columns.split(", ")}, by) for columns, by in found]


def test_semantic_chunks_move_texts_by_document_only(spark):
    df = spark.createDataFrame([(k, f"One {k}. Two! Three? " * 9) for k in range(9)], "doc_id long, text string").repartition(3)
    chunks = chunking.semantic_chunks(df, lambda found: np.array([[len(t), 1] for t in found], np.float32))
    shuffled = _shuffled(chunks)
    assert any("text" in c for c, _ in shuffled)
    assert all(c == {"doc_id", "text"} for c, _ in shuffled if c & {"text", "sentence", "group"})  # no sentence and no group of them
    assert len({r["doc_id"] for r in chunks.collect()}) == 9


def test_judged_texts_move_once(spark):
    schema = "id long, question string, response string, contexts array<string>, reference string"
    rows = spark.createDataFrame([(k % 7, f"q{k % 5}", f"an answer {k % 3} [1]" if k % 4 else " \t", ["c"] if k % 2 else [], "r" if k % 3 else "\n") for k in range(60)], schema).repartition(3)
    calls = spark.sparkContext.accumulator(0)

    def judge(metric, inputs):
        calls.add(len(inputs))
        return [0.5] * len(inputs)

    found = judging.judged(rows, judge)
    narrow = {"id", "row", "metric", "score", "error", "key", "own", "judged", "why", "min", "asks", "buf"}
    wide = [(c, by) for c, by in _shuffled(found) if not c <= narrow]
    assert len(wide) == 1 and wide[0][1].endswith("(row")  # texts go by the row, once for all metrics
    got = found.collect()
    plain = {(f"q{k % 5}", k % 3, k % 2) for k in range(60) if k % 4}
    assert len(got) == 300 and all((r["error"] == judging.EMPTY) == math.isnan(r["score"]) for r in got if r["metric"] == "has_citation")
    # of these inputs: faithfulness with contexts, relevancy by question and text, both context metrics by question, citation by text
    assert calls.value == sum(c for *_, c in plain) + len({x[:2] for x in plain}) + 2 * len({q for q, k, c in plain if c and k}) + len({k for _, k, _ in plain})


def test_answer_forms(spark):
    rows = [("Answer.", 2), ("Cites [1].", 2), ("По базе не нашёл, могу", 1), ("Line\n\nИсточники: .", 3), ("Gap\n\n", 1), ("none", None), ("", 1), (None, 1), ("foreign [9]", 2)]
    df = spark.createDataFrame(rows, "a string, n int")
    got = [tuple(r) for r in df.select(texts.with_sources_line(F.col("a"), F.col("n"), F.lit(3)), texts.sources_suffix(F.col("a"), F.col("n"), F.lit(3))).collect()]
    assert got[0] == ("Answer.\n\nИсточники: [2]", "\n\nИсточники: [2]") and got[1] == ("Cites [1].", "") and got[2] == (rows[2][0], "")
    assert got[3] == ("Line\n\nИсточники: [3]", " [3]") and got[4] == ("Gap\n\nИсточники: [1]", "Источники: [1]") and got[5] == ("none", "") and got[6] == ("", "")
    assert got[8] == ("foreign [9]\n\nИсточники: [2]", "\n\nИсточники: [2]")
    final = [tuple(r[0]) for r in df.select(texts.final_answer(F.col("a"))).collect()]
    assert final[0] == ("Answer.", True) and final[2] == final[6] == final[7] == (texts.NO_ANSWER, False) and final[4] == ("Gap", True)
