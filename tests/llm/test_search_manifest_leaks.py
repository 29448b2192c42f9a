"""Ranked search, the Merkle manifest and decontamination against brute force on tables that hold the hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from lantern.llm import best_positions, decontaminate, merkle

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tf int, log string, g string, __runs int, `a b` struct<`c d`: int>"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def items():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 3)))
    long = " ".join(word() for _ in range(30))
    return [(1, long), (2, " ".join(word() for _ in range(14))), (3, "Solo word"), (4, None), (5, "!!!"), (6, "ÀB cÉ-x"), (None, "no id item"), (1, "another text of item one"), (7, "x " * 12), (8, long), (9, "Solo word"), (10, "a")]


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    known = [t for _, t in items() if t]
    texts = [None, "", " .;", "solo WORD", text(40), text(40) + ". " + known[0].upper() + "! " + text(5), known[1].replace(" ", "\n"), "Àb cÉ x", "x " * 40, "no, id; item", text(9000), "solo word " * 3, "z" * 4000]
    texts += [text(r.randint(1, 60)) for _ in range(60)] + [known[0][3:] + " tail", " ".join(known[0].split()[4:17]), text(3) + " " + " ".join(known[0].split()[4:13])]
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), 1, "l", "g", 2, (3,)) for i, t in enumerate(texts)]
    out += [out[5], out[5], (9, "same id, other text solo word", None, None, None, None, None, None, None, None), (None, known[0], None, "s1", None, None, None, None, None, None), (None, text(20), "de", "", 7, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in items()], "item_id long, text string, score int")


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if re.match(r"op\d+_", n)] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names


def brute_ranks(k):
    d = [(i, terms(t)) for i, t, *_ in rows() if terms(t)]
    n, length = len(d), sum(len(w) for _, w in d)
    df = Counter(t for _, w in d for t in set(w))
    asked = defaultdict(set)
    for i, t in items():
        asked[i] |= set(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for j, (doc, w) in enumerate(d):
            tf, m = Counter(w), 10 + 90 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in q & set(w))
            found.append((-score, doc is None, doc or 0, j))
        found = [x for x in sorted(found) if x[0] < 0][:k]
        out += [(i, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("plan", [best_positions.Search(), best_positions.Search(k=3, step=1, block=2048), best_positions.Search(k=25, most_terms=9, postings=1)])
def test_ranked_search(docs, none, bench, plan):
    assert collected(best_positions.ranked(docs, bench, plan)) == brute_ranks(plan.k)
    assert best_positions.ranked(none, bench, plan).count() == 0
    assert best_positions.ranked(docs, bench.limit(0), plan).count() == 0


def test_best_positions_stop_early_and_lose_nothing():
    """Random lists with many equal impacts: the k best are those of a full scan, and fewer documents are looked up."""
    r = np.random.default_rng(3)
    looked, whole = 0, 0
    for trial in range(40):
        n, m = 3000, 6
        held = [np.flatnonzero(r.random(n) < p) for p in r.uniform(0.05, 0.9, m)]
        impact = [(r.integers(1, 6, len(h)) ** 4 if trial % 2 else r.pareto(1.2, len(h)) * 100).astype(np.int64) + 1 for h in held]
        order = r.permutation(sum(map(len, held)))
        lists = best_positions.Lists(*(np.concatenate(x)[order] for x in ([np.full(len(h), t) for t, h in enumerate(held)], held, impact)), m, n)
        total = np.zeros(n, np.int64)
        for h, x in zip(held, impact, strict=True):
            total[h] += x
        found, scores, read = lists.best(np.arange(m), 10, 4)
        want = np.lexsort((np.arange(n), -total))[:10]
        assert found.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        looked, whole = looked + read, whole + np.count_nonzero(total)
        kth = int(total[want][-1])
        again, *_ = lists.best(np.arange(m), 10, 4, kth)
        assert set(want[total[want] >= kth]) <= set(again.tolist())  # a bound equal to a score keeps it
    assert looked < 0.8 * whole


def test_positions_in_postorder():
    for n in (1, 2, 16, 17, 255, 256, 257, 300, 4096, 5000):
        sizes = merkle.counts(n)
        at = {merkle.position(level, i, sizes) for level, size in enumerate(sizes) for i in range(size)}
        assert at == set(range(sum(sizes)))
        order = sorted(((merkle.position(level, i, sizes), level, i) for level, size in enumerate(sizes) for i in range(size)))
        seen = [0] * len(sizes)
        for _, level, i in order:  # a node comes directly after its last child
            assert i == seen[level] and (not level or seen[level - 1] == min(16 * (i + 1), sizes[level - 1]))
            seen[level] += 1


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """The root, and for every leaf its siblings as (left, right) by level."""
    paths, nodes = [[] for _ in leaves], [(x, [i]) for i, x in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for lo in range(0, len(nodes), 16):
            run = nodes[lo : lo + 16]
            for j, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            above.append((h("".join(x for x, _ in run)), [i for _, own in run for i in own]))
        nodes = above
    return nodes[0][0], paths


def brute_manifest(table):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, g, n, t: h("".join(map(field, (d, s, g, n, t))))
    by_source = defaultdict(list)
    for d, t, g, s, n, *_ in table:
        own = leaf(d, s, g, n, t)
        other = leaf(d, s, g, n, t and t.translate(LOWER)) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else own
        by_source[s].append((d is not None, d or 0, own, other, d))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by_source[s])]) for s in sources]
    root, upper = brute_tree([r for r, _ in trees])
    out = []
    for s, (subroot, paths), above in zip(sources, trees, upper, strict=True):
        for (_, _, own, other, d), path in zip(sorted(by_source[s]), paths, strict=True):
            fold, whole = other, [*path, *above]
            for left, right in whole:
                fold = h(left + fold + right)
            out.append((d, own, subroot, root, h("".join(a + b for a, b in whole)), fold, fold == root))
    return sorted(out, key=str)


def test_manifest(docs, none):
    assert collected(merkle.manifest(docs)) == brute_manifest(rows())
    assert merkle.manifest(none).count() == 0 and merkle.manifest(none).columns == merkle.manifest(docs).columns
    assert merkle.manifest(docs.filter("doc_id = 3")).collect()[0]["verified"]


def test_manifest_of_many_rows_and_sources(spark):
    """More rows in a source, and more sources, than one builder takes; a hot id."""
    table = [(i if i % 3 else 5, f"T{i % 11}", None, "hot" if i % 2 else f"s{i}", i) for i in range(1400)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert collected(merkle.manifest(df)) == brute_manifest(table)


def test_append_log(spark):
    table = [(i, f"t{i}", None, "a" if i % 9 else None, i) for i in range(700)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    log = merkle.append_log(df).toPandas()
    subroots = {r["leaf"]: r["subroot"] for r in merkle.manifest(df).collect()}
    for _, own in log.groupby("source", dropna=False):
        own = own.sort_values("position")
        assert own.position.tolist() == list(range(len(own)))
        assert {subroots[x] for x in own[own.level == 0].digest} == {own.digest.iloc[-1]}
        at = {(r.level, r.place): r.digest for r in own.itertuples()}
        for (level, place), x in at.items():
            if level:
                assert x == h("".join(at[level - 1, k] for k in range(16 * place, 16 * place + 16) if (level - 1, k) in at))


def brute_leaks():
    windows = defaultdict(set)
    for i, t in items():
        w = terms(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(i)
    out = []
    for d, t, *_ in rows():
        w, hit, found = terms(t), set(), set()
        for p in range(len(w)):
            for n in range(1, 11):
                if p + n <= len(w) and (own := windows.get(tuple(w[p : p + n]))):
                    hit |= set(range(p, p + n))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), h(",".join(names)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("plan", [decontaminate.Leaks(), decontaminate.Leaks(most_bytes=0)])
def test_decontamination(docs, none, bench, plan):
    want = brute_leaks()
    assert sum(x[5] for x in want) > 10 and sum(not x[5] for x in want) > 10
    assert collected(decontaminate.digests(docs, bench, plan)) == want
    assert decontaminate.digests(none, bench, plan).count() == 0
    assert decontaminate.digests(docs, bench.limit(0), plan).filter("contaminated").count() == 0
    clean = decontaminate.clean_documents(docs, bench, plan)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    cut = decontaminate.without_spans(docs, bench, plan)
    assert cut.columns == docs.columns and cut.schema["a b"].dataType == docs.schema["a b"].dataType
    left = Counter((r["doc_id"], len(terms(r["text"]))) for r in cut.collect())
    assert left == Counter((x[0], x[1] - x[2]) for x in want)
    same = {(r["doc_id"], r["text"]) for r in cut.collect()} & {r[:2] for r in rows()}
    assert len(same) >= len({(x[0]) for x in want if not x[5]})


def test_spans_are_cut_from_the_text(spark):
    d = spark.createDataFrame([(1, "Keep this. Solo, WORD! é stays"), (2, "solo word")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "solo word")], "item_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decontaminate.without_spans(d, b).collect()} == {1: "Keep this. ! é stays", 2: ""}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "_hashed", lambda ids: np.zeros(len(ids), np.uint64))
    windows = decontaminate.WindowSet([("a", "one two three"), ("b", "two three one"), ("c", "one two four")], 2)
    data = b"one two three four one"
    hit, found = windows.hits(decontaminate.terms(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert hit.tolist() == [True, True, True, False, False] and found == [["a", "b", "c"]]
