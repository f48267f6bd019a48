import hashlib
import os
import random
import zlib

import pytest
from helpers import documents, words

from hearthlake.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    """All maximal stretches with a period, by comparing every two places a period apart; those of a smaller period go."""
    n, found = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, 2 * p):
                part = w[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(draw, n, kinds):
    w = [str(draw.randrange(kinds)) for _ in range(n)]
    if n and draw.random() < 0.5:
        a = draw.randrange(n)
        p = draw.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_many_documents_equal_the_plain_search():
    draw = random.Random(1)
    for _ in range(120):
        texts = [periodic_words(draw, draw.choice([0, 1, 5, 13, 30, 80]), draw.choice([1, 2, 3, 20])) for _ in range(draw.randint(1, 6))]
        least = draw.choice([2, 4, 12])
        runs, kept = periodic._judge([[x.encode() for x in t] for t in texts], least)
        for t, r, k in zip(texts, runs, kept, strict=True):
            want = plain_runs(t, least)
            assert [tuple(x) for x in r.tolist()] == want
            assert k == collapsed(t, want)


def test_fibonacci_words_and_long_periods():
    a, b = ["a"], ["a", "b"]
    while len(b) < 300:
        a, b = b, b + a
    runs, _ = periodic._judge([[x.encode() for x in b]], 2)
    assert [tuple(x) for x in runs[0].tolist()] == plain_runs(b, 2)
    long = [str(i) for i in range(50_000)] * 2 + ["end"]
    runs, kept = periodic._judge([[x.encode() for x in long]], 12)
    assert runs[0].tolist() == [[0, 100_000, 50_000]] and kept[0].split() == long[50_000:]
    runs, kept = periodic._judge([[b"q"] * 100_000], 12)
    assert runs[0].tolist() == [[0, 100_000, 1]] and kept == ["q"]


def test_nulls_blanks_ties_repeats_and_small_batches(spark):
    once = "x " * 11
    rows = [(1, None, "s"), (2, " \t\n", "s"), (3, once, "s"), (4, once + "x", "s"), (4, once + "x", "s"), (None, "a b c " * 6 + "z " * 12, "s"), (5, "one " + "u v w " * 5, "s"), (6, "", "s"), (7, "ä ß " * 13 + "end", "s")]
    docs = documents(spark, rows)
    for batch in (1, 10, 1 << 18):
        got = periodic.collapse_runs(docs, batch_words=batch).collect()
        assert len(got) == len(rows)
        by_text = {(i, t): (sorted(plain_runs(words(t)), key=lambda r: (r[0], r[2])), collapsed(words(t), plain_runs(words(t)))) for i, t, _ in rows}
        texts = {1: None, 2: " \t\n", 3: once, 4: once + "x", None: rows[5][1], 5: rows[6][1], 6: "", 7: rows[8][1]}
        for r in got:
            want = by_text[(r.doc_id, texts[r.doc_id])]
            assert ([tuple(x) for x in r.runs], r.kept_text) == want
    assert periodic.collapse_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_against_the_plain_version(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        w = words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = fast_plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        want[r.doc_id] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(collapsed(w, runs)))
    got = queries.op12_periodic_runs(spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(x[0] for x in want.values()) > 3


def fast_plain_runs(w, least=12):
    """``plain_runs`` with the comparison of one period in one numpy step, for whole documents."""
    import numpy as np

    names = {}
    x = np.array([names.setdefault(t, len(names)) for t in w])
    found = []
    for p in range(1, len(x) // 2 + 1):
        same = np.r_[False, x[p:] == x[:-p], False].astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i + p >= max(least, 2 * p):
                part = x[i : j + p]
                if not any((part[q:] == part[:-q]).all() for q in range(1, p)):
                    found.append((i, j + p - i, p))
    return sorted(found, key=lambda r: (r[0], r[2]))
