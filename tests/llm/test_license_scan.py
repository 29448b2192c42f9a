"""The license scan against brute-force containment over all windows."""

import random
import re

import pytest

from lantern.llm import licenses


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, notices):
    """doc, license, containment of the best aligned window of each template's class."""
    out = {}
    for d, t in rows:
        own = shingles(t or "")
        for name, notice in notices.items():
            want = set(shingles(notice))
            s = licenses.size_class(len(want)) if want else 0
            best = max((len(want & set(own[a : a + 2 * s])) / len(want) for a in range(0, len(own), s)), default=0) if want else 0
            if best >= licenses.LEAST:
                out[d, name] = max(best, out.get((d, name), 0))
    return out


def test_scan_is_containment(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    notices = dict(licenses.NOTICES) | {f"own-{n}": prose(n) for n in (5, 6, 7, 9, 13, 20, 21, 37, 70)} | {"twin": "a b c d e f g", "twin too": "a b c d e f g"}
    rows = [(0, None), (1, ""), (2, "too short"), (3, prose(300))]
    for name, notice in notices.items():
        w = notice.split()
        broken = [*w[: len(w) // 2], "other", *w[len(w) // 2 + 1 :]]
        for text in (notice, notice.upper().replace(" ", " \n"), " ".join(broken), " ".join(w[: max(5, int(len(w) * 0.9))]), " ".join(w[: len(w) // 2]), prose(r.randint(1, 90)) + " " + notice + ", " + prose(r.randint(1, 90))):
            rows.append((len(rows), text))
    rows.append((len(rows), prose(20_000) + " " + " ".join(notices.values()) + " " + prose(20_000)))  # a very long text with all of them
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS s", "3 AS shingles").repartition(3)
    found = licenses.scanned(df, notices).collect()
    got = {(x["doc_id"], x["license"]): x["containment"] for x in found}
    assert len(got) == len(found)
    want = brute(rows, notices)
    assert len(want) > 80 and got == pytest.approx(want)
    assert licenses.scanned(df.limit(0), notices).count() == 0


def test_guarantee_of_the_bands():
    for n in range(1, 2000):
        assert licenses.found(n) > 0.9998 and (n < 3 or licenses.least_similarity(n) > 0.185)
