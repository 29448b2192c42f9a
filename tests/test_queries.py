"""Every query of the library's own jobs beside its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import evaluation, vectors
from lantern.plans.catalog import ORACLES, QUERIES
from tools.compare import TABLES, plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), df.columns
    if name not in ORACLES:
        assert columns
        return
    found = db.execute(ORACLES[name])
    wanted, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(columns) == sorted(wanted)
    order = sorted(columns)
    assert sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows) == sorted(tuple(plain(r[wanted.index(c)]) for c in order) for r in want)


def test_top_k_of_the_whole_query_set(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    asked = v[ids % 20 == 0]
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    for name, scores, k in (("top2_per_question_top_k", unit(asked) @ unit(v).T, 5), ("jn4_top_k_dot", asked @ v.T, 10)):
        want = {(int(q), i + 1, int(ids[j])) for q, s in zip(ids[ids % 20 == 0], scores, strict=True) for i, j in enumerate(np.lexsort((ids, -np.round(s, 12)))[:k])}
        assert {(r["query_id"], r["rank"], r["id"]) for r in QUERIES[name](spark, SF).collect()} == want
    assert {r["query_id"] for r in QUERIES["jn16_agreement"](spark, SF).collect()} == set(ids[ids % 20 == 0].tolist()) == {r["query_id"] for r in QUERIES["jn3_filtered_top_k"](spark, SF).collect()}
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q, p = points.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), points.withColumnRenamed("vec_id", "id")
    found = lambda **how: sorted(tuple(r)[:3] for r in vectors.top_k(q, p, 5, **how).collect())
    assert found(most_queries=3) == found()


def test_lexical_search_reads_whole_texts(spark, tmp_path):
    head = "".join(f"filler{i} " for i in range(600))
    docs = [(1, head + "zebra quartz", "src"), (2, head + "walnut", "src"), (3, "zebra", "src"), (4, head + "quartz " + head + "zebra walnut", "src")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, 0, "Zebra, quartz?"), (9, 1, "walnut quartz")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(tuple(r) for r in QUERIES["jn5_lexical_search"](spark, str(tmp_path)).select("question_id", "rank", "id", "score").collect()) == [("9-0", 1, 3, 3), ("9-0", 2, 1, 2), ("9-0", 3, 4, 2), ("9-1", 1, 4, 2)]
    from lantern.functions import texts

    asked = spark.createDataFrame([(1, "zebra quartz"), (1, "walnut"), (2, None), (3, "absent")], "question_id long, question string")
    articles = spark.createDataFrame([(i, "zebra" if i % 2 else None, "quartz" if i % 3 else "", "walnut " * (i % 5)) for i in range(1, 40)], "id long, title string, keywords string, text string")
    score = {i: 3 * (i % 2) + 2 * (i % 3 > 0) + (i % 5 > 0) for i in range(1, 40)}
    want = [(1, k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:3])]
    for how in ({}, {"most_questions": 1}):
        assert sorted(map(tuple, evaluation.lexical(asked, articles.repartition(3), texts.terms, **how).collect())) == want
    assert evaluation.lexical(asked, articles.limit(0), texts.terms).count() == evaluation.lexical(asked.limit(0), articles, texts.terms).count() == 0


def test_lexical_search_over_many_groups(spark):
    """Stems that all, some and few questions have, sums over 255, in one group and in many: as counted one by one; the stems are made once for all groups."""
    from lantern.functions import texts

    def said(i, kinds, n):
        return " ".join(f"{chr(97 + k)}{j}q" for k in range(kinds) for j in range(n) if (i * 7 + j * (k + 3)) % (k + 2) == 0)

    asked = [(i, said(i, 4, 330) if i < 3 else said(i, 6, 20)) for i in range(45)]
    articles = [(100 - i, said(i, 2, 9), said(i + 1, 3, 9), said(i, 6, 330 if i < 3 else 25)) for i in range(60)]
    score = lambda q, a: sum(w * len(set(q.split()) & set(t.split())) for w, t in zip((3, 2, 1), a[1:], strict=True))
    want = sorted((q, k + 1, i, -s) for q, t in asked for k, (s, i) in enumerate(sorted((-score(t, a), a[0]) for a in articles if score(t, a) >= 2)[:3]))
    assert max(x[3] for x in want) > 255
    q, a = spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(articles, "id long, title string, keywords string, text string")
    for how in ({}, {"most_questions": 5}):
        found = evaluation.lexical(q, a.repartition(2), texts.terms, **how)
        assert sorted(map(tuple, found.collect())) == want
    assert "InMemoryTableScan" in found._jdf.queryExecution().toString()


def test_citations_in_whole_answers(spark, tmp_path):
    head = "word " * 400
    spark.createDataFrame([(6, head + "late [3, 4] , end")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in QUERIES["fn14_citations"](spark, str(tmp_path)).collect()] == [(6, "1,2,3,4")]
    assert [tuple(r) for r in QUERIES["fn15_without_citations"](spark, str(tmp_path)).collect()] == [(6, head + "late, end.")]


def test_attribution_against_brute_force(spark):
    texts = ["", "a", "ab", "a b c d", "x a b c d y", "refund policy", "the refund policy of today", "efund poli", "long  text\nwith lines", "so long  text\nwith lines here", " a b", "b c", "日本語", "これは日本語です", "one two three four five six seven", "two three four five six", "wo three four five si"]
    contexts = [(i, t) for i, t in enumerate(texts)] + [(90, "<1-hop>\n\nrefund policy"), (91, "<2-hop>"), (92, None), (5, "refund policy")]
    docs = [(100 + i, t) for i, t in enumerate(texts)] + [(190, None), (105, texts[5])]
    clean = lambda t: "\n".join(x for x in (t or "").splitlines() if not (x.startswith("<") and x.endswith("-hop>"))).strip()
    want = {(c, d) for c, x in contexts for d, y in docs if clean(x) and y and (clean(x) in y or y in clean(x))}
    for how in ({}, {"most_contexts": 0}, {"most_bytes": 0}):
        got = [tuple(r) for r in evaluation.attributed(spark.createDataFrame(contexts, "context_id long, context string"), spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    one = spark.createDataFrame(docs, "doc_id long, text string")
    assert evaluation.attributed(spark.createDataFrame([], "context_id long, context string"), one).count() == 0


def test_last_beneath_of_deep_traces_and_cycles(spark):
    deep = [(1, i, i - 1 if i > 1 else None, "answer" if i in (1, 30) else "llm" if i == 70 else "tool", i) for i in range(1, 71)]
    ring = [(2, 1, 3, "answer", 1), (2, 2, 1, "llm", 5), (2, 3, 2, "llm", 4), (3, 1, None, "answer", 1)]
    got = evaluation.last_beneath(spark.createDataFrame(deep + ring, "trace_id long, span_id long, parent_id long, span_kind string, start_time long"), "answer", "llm")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 70), (1, 30, 70), (2, 1, 2), (3, 1, None)}


def test_trigrams_of_long_batches_in_parts(spark):
    """A batch is counted in parts by size, and hashes that are forgotten are made again: the same counts."""
    rows = spark.createDataFrame([(i, None if i == 3 else f"some Text {i} " * (i % 7)) for i in range(60)], "id long, text string").coalesce(1)
    counts = lambda **how: sorted(map(tuple, vectors.trigram_counts(rows, ["id"], "text", **how).collect()))
    assert counts(most_letters=40, most_known=5) == counts(most_letters=1) == counts()


def beside_sql(spark, folder, name, texts):
    """The rows of a query and of its SQL over documents of these texts."""
    rows = [(i, t, "en", "web", 10 * i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    if os.path.isdir(folder / "benchmark.parquet"):
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    columns, want = [d[0] for d in found.description], found.fetchall()
    return (sorted(tuple(map(plain, r)) for r in x) for x in (QUERIES[name](spark, str(folder)).select(*columns).collect(), want))


#: Texts that are empty, missing or only white space, among others.
BARE = ["", "a b", None, "", "  ", "c", None, "", "\n\t\u00a0", " d  e ", "f", "", "", None, "g"]


def test_run_totals_of_documents_without_text(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "agg15_run_totals", BARE)
    assert got == want and got[0][:3] == ("15", "70", "70")


def test_attribution_of_empty_texts_as_in_sql(spark, tmp_path):
    """By both ways: an empty text is held by every one, a missing one by none, and white space counts."""
    contexts = [(1, "a b"), (2, ""), (3, None), (4, " a b"), (5, "<1-hop>\nc"), (6, "so a b it is")]
    spark.createDataFrame(contexts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, want = beside_sql(spark, tmp_path, "jn10_source_attribution", [*BARE, "so a b it is", " a b c"])
    assert got == want and ("1", "0") in got and ("2", "0") in got and not {x[1] for x in got} & {"2", "6"}
    c, docs = spark.createDataFrame(contexts, "context_id long, context string"), spark.read.parquet(str(tmp_path / "documents.parquet"))
    far = evaluation.attributed(c, docs, most_contexts=0, plain=True)
    assert sorted(tuple(map(plain, r)) for r in far.collect()) == want


def test_ingest_of_documents_without_words_as_in_sql(spark, tmp_path):
    """A document without words stays live, whole and without chunks; its older wording is another one."""
    got, want = beside_sql(spark, tmp_path, "str1_incremental_ingest", BARE)
    assert got == want and len({x[1] for x in got}) == 4


def test_lexical_search_keeps_only_rows_that_may_be_among_the_best(spark):
    """A floor from the largest articles leaves out the rest before rows move; few seeds, no room for rows of ones and long articles give the same rows."""
    from lantern.functions import texts

    words = [f"{chr(97 + i % 26)}{i}q" for i in range(400)]
    said = lambda seed, n: " ".join(words[(seed * 31 + j * j * 7) % 400] for j in range(n))
    asked = [(i, said(i, 3 + i % 40)) for i in range(30)] + [(98, None), (99, "absent")]
    articles = [(i, said(i, 2) if i % 3 else None, said(i + 5, 4), said(i * 3, 300 if i % 10 == 0 else 30)) for i in range(80)]
    score = lambda q, a: sum(w * len(set((q or "").split()) & set((t or "").split())) for w, t in zip((3, 2, 1), a[1:], strict=True))
    cut = lambda q: " ".join({x[:5] for x in (q or "").split()})
    asked, articles = [(i, cut(t)) for i, t in asked], [(a[0], *map(cut, a[1:])) for a in articles]
    best = {q: sorted((-score(t, a), a[0]) for a in articles if score(t, a) >= 2) for q, t in asked}
    want = sorted((q, k + 1, i, -s) for q in best for k, (s, i) in enumerate(best[q][:3]))
    q, a = spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(articles, "id long, title string, keywords string, text string").repartition(8)
    assert sorted(map(tuple, evaluation.lexical(q, a, texts.terms).collect())) == want
    stems = q.select("question_id", texts.terms(F.col("question")).alias("stems"))
    fields = a.select("id", *(texts.terms(F.col(c)).alias(c) for c in ("title", "keywords", "text"))).persist()
    for seeds in (2, 8, 80):
        floor = evaluation._with_floor(stems, fields, 2, 3, most_seeds=seeds)
        assert all(r["floor"] <= max(2, -([*best[r["question_id"]], (-2, 0), (-2, 0), (-2, 0)][2][0])) for r in floor.collect())
        for cells in (100_000_000, 200, 0):
            rows = evaluation._scored(fields, floor, 2, 3, most_cells=cells).collect()
            found = {k: sorted((-r["score"], r["id"]) for r in rows if r["question_id"] == k)[:3] for k in best}
            assert found == {k: b[:3] for k, b in best.items()}
    assert len(rows) < 150  # every task kept three rows of every question before
