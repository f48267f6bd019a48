import math
import random

import numpy as np
from helpers import rows_by_sql
from pyspark.sql import functions as F

from hearthlake.llm import hard_negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, score long, query string, part string"


def vectors(spark, rows):
    """Vectors with more columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, v, y, 1, "q", "p") for i, v, y in rows], VECTORS)


def plain(rows, k=5, low=80, high=100, step=100):
    """Every anchor against every row."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in good:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:k]:
            fits = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:k]
            out += [(i, p, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **sizes):
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"), **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(n, d, labels, draw):
    centres = draw.normal(size=(6, d))
    return [(i, (centres[draw.integers(6)] + 0.3 * draw.normal(size=d)).astype(np.float32).tolist(), int(draw.integers(labels))) for i in range(n)]


def test_equal_to_the_plain_search(spark):
    draw = np.random.default_rng(3)
    for n, d, labels in ((700, 8, 3), (500, 2, 2), (401, 16, 40)):
        rows = made(n, d, labels, draw)
        assert mined(spark, rows, part_rows=150, block_rows=3) == plain(rows)
    assert len(plain(rows)) > 0


def test_ties_copies_nulls_lengths_and_small_groups(spark):
    one = [0.5, 0.25, -0.5]
    rows = [(100 * k, one, k % 2) for k in range(4)] + [(1 + k, one, k % 2) for k in range(60)]  # one large group of copies
    rows += [(900, [1.0, 2.0], 1), (901, [1.0, 2.0], 1), (902, [1.0, 1.9], 2), (903, [1.0, 0.0], 2), (800, one, None), (None, one, 1), (700, None, 1), (600, [0.1, None, 0.2], 1), (500, [0.1, float("nan"), 0.2], 1), (400, [float("inf"), 0.0, 0.0], 0)]
    rows += [(1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [9.0] * 40, 7), (1200, [-1.0, 0.0, 0.0, 0.0], 4), (1201, [1.0, 0.0, 0.0, 0.0], 4), (1202, [1.0, 0.1, 0.0, 0.0], 5)]
    want = plain(rows)
    assert mined(spark, rows) == want and mined(spark, rows, part_rows=9, block_rows=2) == want
    assert {r[0] for r in want} >= {0, 100, 900} and not {500, 600, 700, 800, 1100, 1200} & {r[0] for r in want}
    again = rows + [(901, [1.0, 2.0], 1)]  # a repeated row counts as a row
    assert len([r for r in mined(spark, again) if r[0] == 900]) == len([r for r in want if r[0] == 900]) * 2
    assert mined(spark, []) == [] and mined(spark, [(1, one, 1), (2, one, 2)]) == []


def test_trees_prune_without_losing_rows():
    draw = np.random.default_rng(8)
    centres = 40 * draw.normal(size=(30, 12))
    x = np.floor(10 * (centres[draw.integers(30, size=6000)] + draw.normal(size=(6000, 12))))
    ids = draw.permutation(6000)
    q = x[:50]
    tree, best = hard_negatives.BallTree(x, ids), hard_negatives.Best(50, 5)
    top = np.sort(q @ x.T, axis=1)[:, -200]  # scores around the 200th best
    taken = hard_negatives.search(tree, q, ids[:50], np.full(50, -np.inf), top, np.arange(50), best)
    assert taken < 50 * 6000 / 2
    for a in range(50):
        s = x @ q[a]
        want = sorted((-t, i) for t, i in zip(s, ids, strict=True) if i != ids[a] and t <= top[a])[:5]
        assert [(-t, i) for t, i in zip(best.score[a], best.ids[a], strict=True)] == want


def test_query_equals_its_sql_on_made_vectors(spark, tmp_path):
    draw = random.Random(6)
    rows = []
    for i in range(900):
        v = [draw.choice([-0.25, 0.0, 0.125, 0.5]) + draw.choice([0.0, 0.001]) for _ in range(6)]
        rows.append((i, draw.choice([v] * 30 + [None, v[:5] + [None], v[:5] + [float("nan")]]), draw.choice([0, 1, 1, 1, 9, None])))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    want = rows_by_sql(queries.OP13_SQL, tmp_path, got.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 20
