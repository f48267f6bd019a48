import math

import numpy as np
from helpers import components

from hearthlake.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, near string"


def clustered(n=700, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, 32))
    rows = []
    for i in range(n):
        near = draw.random() < 0.5
        v = centres[draw.integers(40)] + draw.normal(size=32) * 0.12 if near else draw.normal(size=32)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    return rows


def plain(rows, threshold=0.93):
    ok = {i: np.array(v, dtype=np.float64) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    linked = lambda a, b: a in ok and b in ok and label[a] == label[b] and len(ok[a]) == len(ok[b]) and float(unit[a] @ unit[b]) >= threshold
    ids = sorted(label)
    return {i: sum(linked(i, j) for j in ids if j != i) for i in ids}, components(ids, linked)


def test_links_and_components_match_brute_force(spark):
    rows = clustered()
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, None, 0), (1004, [0.0] * 32, 0), (1005, [math.nan] + [1.0] * 31, 0), (1006, [None] + [1.0] * 31, 0), (1007, rows[0][1], None), (1008, [], 0), (1009, [1.0, 2.0], 0), (1010, [2.0, 4.0], 0), (1011, [math.inf] * 32, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    degree, roots = plain(rows)
    for shard_rows in (2000, 90):
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, shard_rows=shard_rows).collect()}
        assert len(got) == len(rows)
        found, wanted = sum(r.n_links for r in got.values()), sum(degree.values())
        assert all(got[i].n_links <= degree[i] for i in degree)  # none below the threshold
        assert found >= 0.97 * wanted, (found, wanted)
        if found == wanted:
            assert {i: r.component_id for i, r in got.items()} == roots
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_multiples_of_one_vector_cannot_be_split_but_meet(spark):
    draw = np.random.default_rng(4)
    one = draw.normal(size=16)
    rows = [(i, [float(x) for x in one * (1 + i)], 0) for i in range(150)] + [(500 + i, [float(x) for x in draw.normal(size=16)], 0) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    degree, roots = plain(rows)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, shard_rows=40).collect()}
    assert {i: r.n_links for i, r in got.items()} == degree and {i: r.component_id for i, r in got.items()} == roots


def test_null_and_repeated_ids(spark):
    v = [1.0, 0.0]
    df = spark.createDataFrame([(None, v, 1, "x", "y"), (5, v, 1, "x", "y"), (5, v, 1, "x", "y")], SCHEMA)
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5)]


def test_pruned_graph_keeps_near_ones():
    x = embed_dedup._unit(np.random.default_rng(2).normal(size=(200, 8)))
    lists = embed_dedup.prune(x)
    nearest = (x @ x.T - 2 * np.eye(200)).argmax(axis=1)
    assert all(nearest[i] in lists[i] for i in range(200))
    assert all(i in lists[j] for i in range(200) for j in lists[i])


def test_a_missed_recall_is_made_up_for_exactly(spark):
    rows = clustered(300, seed=6)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    degree, roots = plain(rows)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, shard_rows=40, recall=1.1, retries=0).collect()}
    assert {i: r.n_links for i, r in got.items()} == degree and {i: r.component_id for i, r in got.items()} == roots


def test_tiny_and_huge_components_keep_their_direction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1e-200, 0.0], 1), (3, [1e300, 1e290], 1), (4, [0.0, 1e-300], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_recall_is_returned(spark):
    rows = clustered(400, seed=3)
    classes = spark.createDataFrame([(i, v, label) for i, v, label in rows], "cid long, vector array<double>, label int")
    links, recall = embed_dedup.find_links(classes, shard_rows=60)
    brute = embed_dedup._all_pairs(classes, 0.93, 50)
    found, wanted = ({(r.src, r.dst) for r in x.collect()} for x in (links, brute))
    assert found <= wanted and len(found) >= 0.97 * len(wanted) and 0.98 <= recall <= 1
    assert len(wanted) == sum(plain(rows)[0].values()) // 2
