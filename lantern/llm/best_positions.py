"""Ranked lexical search by the Best Position Algorithm over impact lists.

Every block of documents keeps, for each term of a query, a list of its documents by falling impact, and the same
postings by document for direct access.  For a query all its lists are read in step; what is met anywhere is looked
up in every other list at once, and the place where it is found counts as seen.  A list's best position is the last
place before its first unseen one, which direct accesses push beyond what was read.  No unseen document can score more
than the impacts at the best positions together; when that is strictly below the k-th score so far (an equal score
could still win by its id), the query is done in this block.  The k best of each block are merged.

1. One pass over the texts gives each document's number of terms and the counts of the queries' terms: the postings,
   a checkpoint of narrow rows.  Documents are never shuffled by term, so that a term of any frequency is spread as the
   documents are.
2. Totals and document frequencies are aggregates of the postings.
3. Each task turns its postings into blocks of lists and searches all queries, with the k-th score of earlier
   blocks as a first bound.

Queries are the rows of a stated set; they are taken in groups of about `most_terms` terms, each group broadcast and
with a pass of its own.

Defined results: null and empty texts have no terms, are no documents of the statistics and are never found; rows with
one id are documents of their own; a null id comes last among equal scores; rows of one item id are one query of all
their terms; items without terms find nothing; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import durable
from .texts import blocks, terms, text_column


@dataclass(frozen=True)
class Search:
    k: int = 10
    b: int = 90  # share of a document's length in its saturation, in hundredths
    most_terms: int = 500_000  # of a group of queries
    block: int = 16_384  # most documents whose lists are searched together
    postings: int = 4_000_000  # and about the most postings
    step: int = 32  # places read of every list in the first round; each round reads twice as many


class Lists:
    """The impact lists of a block: postings of each term by falling impact, and by document for direct access."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        by_impact = np.lexsort((doc, -impact, term))
        by_doc = np.lexsort((doc, term))
        self.first = np.searchsorted(term[by_doc], np.arange(n_terms + 1))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        self.of_doc, self.of_impact = doc[by_doc], impact[by_doc]
        place = np.empty(len(term), np.int64)
        place[by_impact] = np.arange(len(term))
        self.place = place[by_doc] - self.first[term[by_doc]]
        self.n_docs = n_docs

    def best(self, query: np.ndarray, k: int, step: int, least: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best by (score, document) that may reach `least`, and how many documents were looked up."""
        bounds = [(int(self.first[t]), int(self.first[t + 1])) for t in query]
        bounds = [(a, b) for a, b in bounds if a < b]
        seen = [np.zeros(b - a + 1, bool) for a, b in bounds]  # the last place stays unseen
        best = [0] * len(bounds)
        known = np.zeros(self.n_docs, bool)
        docs, scores, read, n_known = np.empty(0, np.int64), np.empty(0, np.int64), 0, 0
        while any(p < b - a for p, (a, b) in zip(best, bounds, strict=True)):
            met = [self.doc[a + read : min(b, a + read + step)] for a, b in bounds]
            for s in seen:
                s[read : min(read + step, len(s) - 1)] = True
            read, step = read + step, 2 * step
            fresh = np.unique(np.concatenate(met))
            fresh = fresh[~known[fresh]]
            known[fresh] = True
            n_known += len(fresh)
            if len(fresh):
                score = np.zeros(len(fresh), np.int64)
                for s, (a, b) in zip(seen, bounds, strict=True):
                    at = np.searchsorted(self.of_doc[a:b], fresh)
                    at[at == b - a] = 0
                    hit = self.of_doc[a + at] == fresh
                    at = a + at[hit]
                    score[hit] += self.of_impact[at]
                    s[self.place[at]] = True
                docs, scores = np.append(docs, fresh), np.append(scores, score)
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
            bound = 0
            for j, (s, (a, b)) in enumerate(zip(seen, bounds, strict=True)):
                best[j] += int(np.argmin(s[best[j] :]))
                bound += int(self.impact[a + best[j] - 1]) if best[j] < b - a else 0
            kth = max(least, int(scores[k - 1]) if len(scores) >= k else -1)
            if bound < kth:
                break
        return docs, scores, n_known


def _queries(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct) of every item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = terms(data, offsets)
                lists = [sorted({words.vocab[i].as_py().decode() for i in np.unique(words.ids[a:b])}) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary), tf of every text with a term; a checkpoint."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(text_column(batch)):
                words = terms(data, offsets)
                own = np.array([number.get(x, -1) for x in words.vocab.to_pylist()], np.int64)
                n = np.diff(words.first)
                ids = own[words.ids] if len(own) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(hi - lo), n)[ids >= 0]
                pairs, tf = np.unique(doc * len(number) + ids[ids >= 0], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(hi - lo + 1) * max(1, len(number)))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(number)), tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
                yield rows.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return durable(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<int>"))


@dataclass(frozen=True)
class _Weighed:
    """A group of queries, their terms' weights, and what a document's length counts against."""

    queries: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    length: int
    plan: Search

    def lists(self, rows: pa.Table) -> Lists:
        """rows sorted by id."""
        plan = self.plan
        # in Python's whole numbers: length times documents may leave 64 bits
        m = np.array([100 - plan.b + plan.b * n * self.n_docs // self.length for n in rows["n"].to_pylist()], np.int64)
        flat = [rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf")]
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["terms"]).to_numpy())
        term, tf = flat
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        return Lists(term[some], doc[some], impact[some], len(self.weights), rows.num_rows)


def _searched(found: DataFrame, weighed: _Weighed) -> DataFrame:
    """query, doc_id, score: the k best of each task's documents."""
    shared = found.sparkSession.sparkContext.broadcast(weighed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        plan, kind = own.plan, None
        top: list[list[tuple]] = [[] for _ in own.queries]

        def search(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts)
            rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_end"))
            lists, ids = own.lists(rows), rows["doc_id"].to_pylist()
            for q, query in enumerate(own.queries):
                least = -top[q][-1][0] if len(top[q]) == plan.k else -1
                docs, scores, _ = lists.best(query, plan.k, plan.step, least)
                more = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                top[q] = sorted(top[q] + more)[: plan.k]

        waiting, n_docs, n_postings = [], 0, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                waiting.append(part)
                n_docs, n_postings = n_docs + part.num_rows, n_postings + len(part.column(2).flatten())
                if n_docs + 2048 > plan.block or n_postings > plan.postings:
                    search(waiting)
                    waiting, n_docs, n_postings = [], 0, 0
        if waiting:
            search(waiting)
        rows = [(q, None if none else i, -s) for q, best in enumerate(top) for s, none, i in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), kind, pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return found.mapInArrow(run, f"query int, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, plan: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, equal scores by ascending id."""
    queries = durable(_queries(items))
    n_terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = max(1, -(-n_terms // plan.most_terms))
    out = None
    for g in range(groups):
        asked = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # about plan.most_terms terms of the stated set of queries
        names = docs.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(asked)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _of_group(docs, asked, plan).join(F.broadcast(names), "query").drop("query")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.k).select("item_id", "rank", "doc_id", "score")


def _of_group(docs: DataFrame, asked: list, plan: Search) -> DataFrame:
    vocabulary = sorted({t for r in asked for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    found = postings(docs, vocabulary)
    n_docs, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of the group
        held[r["t"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    return _searched(found, _Weighed([np.array([number[t] for t in r["terms"]], np.int64) for r in asked], weights, n_docs, max(1, length), plan))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
 s AS (SELECT count(*) AS nn, sum(len(w))::bigint AS ll FROM d WHERE len(w) > 0),
 q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
 tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY r, t),
 wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, s GROUP BY t, nn),
 sc AS (SELECT item_id, r, sum(wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * nn) // ll))))::bigint AS score FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN d USING (r), s GROUP BY item_id, r)
 SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM sc JOIN d USING (r) WHERE score > 0) WHERE rank <= 10"""
