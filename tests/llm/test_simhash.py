import random

import numpy as np
import pytest
import xxhash
from helpers import components, documents, words

from hearthlake.llm import simhash


def plain_fingerprint(text, k=3):
    w = [x.encode().lower().decode() if False else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(seed=1, n=60):
    draw = random.Random(seed)
    base = [" ".join(draw.choice("abcdefghij") * draw.randint(1, 5) for _ in range(150)) for _ in range(8)]
    out = []
    for i in range(n):
        w = base[i % 8].split()
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = "x%d" % draw.randint(0, 5)
        out.append(" ".join(w))
    return out


def test_components_match_plain_version(spark):
    texts = near_texts() + [None, "", "  ", "One", "one", "a B", "A b", "çà Là", "word " * 30_000]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)] + [(None, "lonely text of null id", "s")]
    fp = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = components(sorted(i for i in fp if i is not None), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    for bucket_rows in (simhash.BUCKET_ROWS, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(documents(spark, rows), bucket_rows=bucket_rows).collect()}
        assert len(got) == len(rows)
        assert {i: f for i, (f, _) in got.items()} == {i: f"{fp[i]:016x}" for i in fp}
        assert {i: c for i, (_, c) in got.items() if i is not None} == want
        assert got[None][1] is None


def test_forest_spans_what_links(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique([int(b) ^ sum(1 << int(x) for x in draw.integers(0, 64, 2)) for b in base for _ in range(40)]).astype(np.uint64)[:, None]
    links = simhash.forest(fps, simhash.distance_table(fps, simhash.pivots()), 3)
    items = list(range(len(fps)))
    want = components(items, lambda a, b: int(simhash.hamming(fps[a], fps[b])) <= 3)
    edges = {frozenset(x) for x in links}
    assert components(items, lambda a, b: frozenset((a, b)) in edges) == want
    assert len(links) == len(items) - len(set(want.values()))


def test_similar_texts_are_found_and_others_left(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(60):
        w = [word() for _ in range(300)]
        rows.append((2 * i, " ".join(w), "s"))
        if i % 2 == 0:  # 6 changed words: a resemblance of about 0.8 and more
            for k in range(6):
                w[draw.randrange(300)] = word()
            rows.append((2 * i + 1, " ".join(w), "s"))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, rows)).collect()}
    caught = sum(got[i] == i - 1 for i in got if i % 2)
    assert caught >= 28
    assert all(got[i] == i for i in got if i % 2 == 0)
    kept = simhash.drop_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert simhash.near_components(documents(spark, rows).limit(0)).count() == 0


def graded_texts(seed=9):
    """Texts of 200 words with variants whose resemblance runs from about 0.6 to 0.95, chains of them, blanks and short ones."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(40):
        w = [word() for _ in range(200)]
        rows.append(" ".join(w))
        for changes in (1, 5, 7, 9, 10):
            v = list(w)
            for k in draw.sample(range(200), changes):
                v[k] = word()
            rows.append(" ".join(v))
    rows += [None, "", " \t", "one two three four five six", "one two three four five seven", "One  two three four five six", "x", "X"]
    rows += [" ".join(word() for _ in range(6)) for _ in range(300)]  # two shingles each, some near the fingerprint zero
    draw.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def plain_sets(rows, k=5):
    out = {}
    for i, t, _ in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def test_only_texts_that_resemble_are_dropped(spark):
    rows = graded_texts()
    sets = plain_sets(rows)
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    want = components([i for i, _, _ in rows], lambda a, b: like(a, b) >= 0.8)
    assert sum(0.6 <= like(a, b) < 0.8 for a in sets for b in range(a)) > 100
    for chunk_texts in (simhash.CHUNK_TEXTS, 2):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, rows), chunk_texts=chunk_texts).collect()}
        assert got.keys() == want.keys()
        assert all(want[got[i]] == want[i] for i in got)  # nothing is merged that doesn't belong together
        assert sum(got[i] != want[i] for i in got) <= 2  # candidates are found with a recall of 0.97
    assert all(got[i] == i for i, t, _ in rows if not (t or "").strip())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert kept == {i for i in got if got[i] == i}


class Searched(Exception):
    pass


def sample_recall(spark, rows, pairs=4000):
    """Share of random pairs at the accepted radius that the stage deals to one bucket, were there so many rows."""
    found, masks_of = [], simhash.sampled_masks

    def caught(classes, masks, radius, *_):
        found.append((masks, radius))
        raise Searched

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "sampled_masks", lambda lanes, _, *a: masks_of(lanes, rows, *a))
        patch.setattr(simhash, "links_within", caught)
        with pytest.raises(Searched):
            simhash.similar_components(documents(spark, [(1, "a b c d e f", "s")]))
    (masks, radius), draw = found[0], np.random.default_rng(rows)
    apart = np.zeros((pairs, 256), dtype=np.uint8)
    for row in apart:
        row[draw.choice(256, radius, replace=False)] = 1
    apart = np.packbits(apart, axis=1, bitorder="little").view("<u8")
    return np.any([((apart & np.array(m, dtype=np.uint64)) == 0).all(axis=1) for m in masks], axis=0).mean(), len(masks)


def test_recall_of_bit_samples_holds_at_the_radius_for_any_number_of_rows(spark):
    for rows in (2_000, 80_000, 6_000_000):
        assert sample_recall(spark, rows)[0] >= 0.98


def test_candidates_are_audited_and_made_whole(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, size=(60, 4), dtype=np.int64)
    rows = []
    for b in base:
        rows.append(b)
        for _ in range(2):  # 30 of 256 bits differ
            bits = np.zeros(256, dtype=np.uint8)
            bits[draw.choice(256, 30, replace=False)] = 1
            rows.append(b ^ np.packbits(bits, bitorder="little").view(np.int64))
    classes = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "cid long, f0 long, f1 long, f2 long, f3 long").persist()
    fps = np.array(rows).view(np.uint64)
    want = components(range(len(rows)), lambda a, b: int(simhash.hamming(fps[a], fps[b])) <= 40)
    grouped = lambda found: {r.id: r.component_id for r in found.collect()}
    whole = {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    assert grouped(simhash.candidate_groups(classes, 4, 40 / 256, 40, 0.99, 20_000)) == whole
    nothing = lambda lanes, *a: [[-1 & (2**64 - 1)] * lanes]  # noqa: E731  one sample of all bits: only equal ones meet
    monkeypatch.setattr(simhash, "sampled_masks", nothing)
    none = spark.createDataFrame([], "id long, component_id long")
    assert simhash.audit_groups(classes, none, 40) == 0.0
    assert grouped(simhash.candidate_groups(classes, 4, 40 / 256, 40, 0.99, 20_000)) == whole  # all chunks were compared
    assert simhash.candidate_groups(classes.limit(0), 4, 40 / 256, 40, 0.99, 20_000).count() == 0
