"""Values of the queries that SQL can't express, against plain Python on the smallest tables."""

import datetime as dt
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lantern.functions.texts import PII
from lantern.operators import chunking
from lantern.plans.catalog import QUERIES
from lantern.plans.chats import MESSAGES
from lantern.plans.safety import PROBES
from lantern.streaming import moderation

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """These tables are tiny: two tasks a shuffle, and two state stores."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def probed(db):
    """chat_id, seq, role, content of the messages with probes in their places."""
    rows = db.execute(f"SELECT chat_id, seq, role, content, interface FROM ({MESSAGES}) ORDER BY 1, 2").fetchall()
    return [(c, s, r, PROBES[c % len(PROBES)] if (c + s) % 3 == 0 else t, i) for c, s, r, t, i in rows]


def test_chunks(spark, db):
    docs = db.execute("SELECT doc_id, text FROM documents").fetchall()
    for name, cut in (("chk1_fixed_chunks", chunking.window_chunks), ("chk2_recursive_chunks", chunking.recursive_chunks)):
        want = {(d, i, c, -(-len(c.encode()) // 4)) for d, t in docs for i, c in enumerate(cut(t, 512, 64))}
        assert {tuple(r) for r in QUERIES[name](spark, SF).collect()} == want
        assert max(n for *_, n in want) <= 512
    chunks = [c for _, t in docs for c in chunking.window_chunks(t, 512, 64)]
    tokens = [-(-len(c.encode()) // 4) for c in chunks]
    got = QUERIES["agg9_chunk_stats"](spark, SF).first()
    assert (got["chunks"], got["documents"], got["tokens_least"], got["tokens_most"]) == (len(chunks), len(docs), min(tokens), max(tokens))
    assert got["tokens_mean"] == pytest.approx(sum(tokens) / len(tokens), abs=0.006) and got["chars_mean"] == pytest.approx(sum(map(len, chunks)) / len(chunks), abs=0.006)


def test_counts_of_personal_data(spark, db):
    found, touched = Counter(), Counter()
    for (text,) in db.execute("SELECT text FROM documents").fetchall():
        for label, pattern in PII.items():
            text, n = re.subn(pattern, f"[{label}]", text)
            found[label] += n
            touched[label] += n > 0
    got = QUERIES["fn2_pii_counts"](spark, SF).collect()
    assert {(r["label"], *(r[c] for c in r.asDict() if c != "label")) for r in got} in ({(k, found[k], touched[k]) for k in PII}, {(k, found[k], touched[k]) for k in PII if found[k]})


def test_rate_limit(spark, db):
    by_client = defaultdict(list)
    for user, ts in db.execute("SELECT user_id, ts FROM events ORDER BY ts").fetchall():
        by_client[str(user)].append(ts)
    want = []
    for client, times in by_client.items():
        opened, n = None, 0
        for t in times:
            if opened is None or t >= opened + dt.timedelta(days=1):
                opened, n = t, 0
            n += 1
            want.append((client, n <= 2, max(2 - n, 0), 0 if n <= 2 else round((opened + dt.timedelta(days=1) - t).total_seconds())))
    for name in ("win13_rate_limit", "str3_rate_limit_stream"):
        assert sorted((r["client"], r["allowed"], r["remaining"], round(r["retry_after"])) for r in QUERIES[name](spark, SF).collect()) == sorted(want)


def test_screening(spark, probed):
    rules = {(r["chat_id"], r["seq"]): r["rule"] for r in QUERIES["fn20_input_checks"](spark, SF).collect()}
    by_text = {text: {rules[c, s] for c, s, _, t, _ in probed if t == text} for text in PROBES}
    assert by_text == {PROBES[0]: {"injection"}, PROBES[1]: {"injection"}, PROBES[2]: {None}, PROBES[3]: {"encoded_payload"}, PROBES[4]: {None}, PROBES[5]: {None}, PROBES[6]: {"injection"}}
    got = {r["probe"]: (r["n"], r["blocked"], r["injection"], r["payload"]) for r in QUERIES["agg26_validator_coverage"](spark, SF).collect()}
    want = defaultdict(lambda: [0, 0, 0, 0])
    for c, s, *_ in probed:
        w = want[c % len(PROBES)]
        for k, hit in enumerate((True, rules[c, s] is not None, rules[c, s] == "injection", rules[c, s] == "encoded_payload")):
            w[k] += hit
    assert got == {k: tuple(v) for k, v in want.items()}
    messages = {r["id"]: r for r in QUERIES["str2_screened_messages"](spark, SF).collect()}
    for c, s, _, text, _ in probed:
        m = messages[f"{c}-{s}"]
        assert m["categories"] == ",".join(moderation.matched(text)) and m["allowed"] == (rules[c, s] is None and not m["categories"]) and (m["masked"] is not None) == m["allowed"]
    kept = {(r["chat_id"], r["seq"]): r["blocked"] for r in QUERIES["win6_screened_history"](spark, SF).collect()}
    chats = defaultdict(list)
    for c, s, role, *_ in probed:
        chats[c].append((s, role, rules[c, s] is not None))
    for c, turns in chats.items():
        last = max((s for s, role, _ in turns if role == "user"), default=None)
        blocked = any(bad and (role == "system" or s == last) for s, role, bad in turns)
        stay, before = set(), False
        for s, role, bad in turns:
            gone = bad and role in ("user", "assistant") and s != last or role == "assistant" and before
            before = role == "user" and bad
            if blocked or not gone:
                stay.add(s)
        assert {s for (k, s) in kept if k == c} == stay and {kept[c, s] for s in stay} <= {blocked}


def test_running_moderation(spark, db):
    got = defaultdict(dict)
    for r in QUERIES["str5_running_moderation"](spark, SF).collect():
        got[r["answer_id"]][r["seq"]] = (r["sent"], r["rules"])
    from lantern.plans.streams import answer_deltas

    texts = defaultdict(list)
    for r in answer_deltas(spark, SF).orderBy("answer_id", "seq").collect():
        texts[r["answer_id"]].append((r["seq"], r["delta"]))
    assert set(got) == set(texts)
    hits = 0
    for a, parts in texts.items():
        so_far, blocked = "", False
        for seq, delta in parts:
            so_far += delta or ""
            rules = [] if blocked else moderation.matched(so_far)
            blocked = blocked or bool(rules)
            hits += bool(rules)
            assert got[a][seq] == (not blocked, ",".join(rules) or None)
    assert hits


def test_false_positives(spark, db):
    n = Counter(i for (i,) in db.execute(f"SELECT interface FROM ({MESSAGES})").fetchall())
    got = {r["interface"]: r for r in QUERIES["agg26_false_positives"](spark, SF).collect()}
    assert {k: r["n"] for k, r in got.items()} == dict(n) and all(r["blocked"] <= r["n"] and (r["blocked"] == 0) == (r["rules"] == "") for r in got.values())
