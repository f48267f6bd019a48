import hashlib
import random

import numpy as np
from helpers import documents, words

from hearthlake.llm import substring


def plain(rows, span=13):
    least = {}
    for i, t, _ in rows:
        w = words(t)
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - span + 1):
            if least[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def make_rows():
    draw = random.Random(4)
    vocabulary = ["the", "of", "a", "ä", "x1", "yy", "zed", "quod", "erat", "demo"]
    text = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", "", str(draw.randint(0, 30))]) for _ in range(n))
    passage, rows = text(55), []
    for i in range(40):
        t = text(draw.randint(0, 120))
        if i % 3 == 0:
            t += "\n" + passage[: draw.randint(60, len(passage))] + " " + text(20)
        rows.append((i * 7 % 41, t, "s"))
    rows += [(100, rows[3][1], "s"), (101, rows[3][1].replace(" ", "  \n"), "s"), (102, None, "s"), (103, "", "s"), (104, "eron " * 500, "s"), (105, "eron " * 300, "s"), (106, "one two", "s")]
    return rows


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def test_removed_words_match_plain_version(spark, monkeypatch):
    rows = make_rows()
    assert got(substring.remove_repeats(documents(spark, rows))) == plain(rows)
    monkeypatch.setattr(substring, "BLOCK_CHARS", 700)  # more blocks, so more is left for the shards
    assert got(substring.remove_repeats(documents(spark, rows).repartition(5))) == plain(rows)


def test_windows_of_hot_minimizers_dealt_one_by_one(spark, monkeypatch):
    rows = make_rows()
    monkeypatch.setattr(substring, "BLOCK_CHARS", 700)
    df = documents(spark, rows).repartition(5)
    some = substring.hot_minimizers(df, weighed=1, least=900)
    every = substring.hot_minimizers(df, weighed=1, least=1)
    assert 0 < len(some) < len(every) and (np.diff(every) > 0).all()
    for least in (900, 1):
        assert got(substring.remove_repeats(df, weighed=1, hot_bytes=least)) == plain(rows)


def test_edges_of_a_common_passage_are_spread():
    draw = np.random.default_rng(2)
    passage = draw.integers(0, 2**63, 40, dtype=np.uint64)
    hashes = np.concatenate([np.r_[draw.integers(0, 2**63, 20, dtype=np.uint64), passage, draw.integers(0, 2**63, 20, dtype=np.uint64)] for _ in range(300)])
    bounds = np.arange(0, len(hashes) + 1, 80)
    values, count = np.unique(substring.cut_runs(hashes, bounds)[3], return_counts=True)
    assert count.max() == 300
    hot = values[count >= 100]
    owner, start, size, value = substring.cut_runs(hashes, bounds, hot=hot)
    covered = np.unique(np.concatenate([np.arange(a, a + n - 12) for a, n in zip(start, size)]))
    assert len(covered) == 300 * 68  # each window once
    edge = (start % 80 < 20) | (start % 80 > 60 - 13)
    assert np.unique(value[edge], return_counts=True)[1].max() < 100  # what is left are minimizers that were not hot


def test_null_and_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = documents(spark, [(None, text, "s"), (3, text, "s"), (3, text, "s"), (3, text + " more", "s")])
    found = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect())
    assert found == [(False, 40, 0), (False, 40, 0), (False, 41, 0), (True, 40, 40)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_or_none_are_told_apart(spark, monkeypatch):
    draw = random.Random(8)
    shared = [" ".join(f"p{draw.randint(0, 99)}" for _ in range(20)) for _ in range(4)]
    rows = [(draw.choice([None, None, 7, 7, 2**63 - 1, i]), " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 40))) + " " + " ".join(draw.sample(shared, 2)), "s") for i in range(120)]
    rows += rows[:5]
    rank = {i: k for k, i in enumerate(sorted({r[0] for r in rows if r[0] is not None}))} | {None: 10**6}
    want = sorted((n, g, d) for _, n, g, d in plain([(rank[i], t, x) for i, t, x in rows]))
    for size in (8_000_000, 900):
        monkeypatch.setattr(substring, "BLOCK_CHARS", size)
        out = got(substring.remove_repeats(documents(spark, rows)).fillna(-1, "doc_id"))
        assert sorted(x[1:] for x in out) == want
    assert sum(x[0] == 2**63 - 1 for x in out) == sum(r[0] == 2**63 - 1 for r in rows)


def test_index_counts_and_finds_patterns():
    draw = np.random.default_rng(1)
    sequence = np.r_[draw.integers(1, 6, 400), 0]
    matrix = substring.WaveletMatrix(sequence)
    for c in range(6):
        at = draw.integers(0, len(sequence) + 1, 50)
        assert matrix.rank(np.full(50, c), at).tolist() == [int((sequence[:i] == c).sum()) for i in at]
    index = substring.FMIndex(sequence, 5)
    ends = np.arange(4, 400)
    length, low, high = index.match(ends, least=1)
    assert (length == 5).all()
    for e, a, b in zip(ends, low, high):
        pattern = sequence[e - 4 : e + 1]
        assert b - a == sum((sequence[i : i + 5] == pattern).all() for i in range(396))
