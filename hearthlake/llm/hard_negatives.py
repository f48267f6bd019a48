"""Hard negatives by ball trees: branch and bound on inner products from both sides.

Rows are dealt to parts of about ``PART_ROWS`` by a hash, so a label or a group of
copies that holds most rows is spread like any other. Every part builds one ball
tree a label (a node: centre, radius, greatest norm, smallest id). Anchors are
dealt to blocks of ``BLOCK_ROWS``; each block meets each part in a task of its own,
which takes a stated query set against all rows, in blocks. Two rounds:

1. positives: the nodes of the anchor's own label, depth first, the nearer child
   first. For a node with centre c and radius r, the product with an anchor q lies
   in q·c ± r|q|. A node goes when its upper bound is strictly beneath the current
   k-th score; equal ones stay, as ids decide among ties, unless the node's smallest
   id loses too. The best of all parts are merged by a window that keeps k rows a
   task before the shuffle;
2. negatives: each (anchor, positive) has its window of scores. Nodes of other
   labels go when their lower bound is above the window, their upper bound below
   it, or their upper bound beneath the current k-th score.

A block runs through a tree as one: bounds and scores are matrix products over the
queries that are still open at a node.

Scores are sums of products of whole numbers, exact in double precision below
2**53. Bounds are widened by a share of 1e-9, so rounding never prunes a row that
counts. The work grows with anchors times rows, as anchors are a share of the
rows; a task holds one part and one block, whatever the size of the table.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; vectors of different length do not meet;
"other" rows have another id; rows that repeat an id count each; an anchor without
positives, or a pair without a fitting negative, gives no row; so does an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.session import write_table

#: Rows of a part, queries of a block, rows of a leaf.
PART_ROWS, BLOCK_ROWS, LEAF = 16_384, 8192, 64
#: What rounding may add to a bound, as a share of it.
SLACK = 1e-9


class BallTree:
    """Nodes of one label's rows; ``order`` puts the rows of a node side by side."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centre, radius, todo = [], [], [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            rows = x[self.order[a:b]]
            c = rows.mean(axis=0)
            off = np.linalg.norm(rows - c, axis=1)
            self.span.append((a, b))
            self.children.append(None)
            centre.append(c)
            radius.append(off.max())
            if b - a <= leaf or not off.max():
                continue
            # Two far rows are the poles; the rows are halved by where they lie between them.
            far = rows[off.argmax()]
            other = rows[np.linalg.norm(rows - far, axis=1).argmax()]
            turn = np.argsort(rows @ (far - other), kind="stable")
            self.order[a:b] = self.order[a:b][turn]
            mid = (a + b) // 2
            todo += [(a, mid, node, 0), (mid, b, node, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.x, self.ids = x[self.order], ids[self.order]
        self.least = np.array([self.ids[a:b].min() for a, b in self.span])


class Best:
    """The k best (score, id) of each query so far, the best first; empty places have the score -inf."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the given ids for some queries; -inf for those that do not count."""
        k = self.score.shape[1]
        counts = (score > self.score[rows, -1:]) | ((score == self.score[rows, -1:]) & (ids[None, :] < self.ids[rows, -1:]))
        some = np.flatnonzero((counts & (score > -np.inf)).any(axis=1))
        if not some.size:
            return
        rows, score = rows[some], score[some]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], axis=1)
        turn = np.lexsort((i, -s), axis=-1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, turn, axis=1), np.take_along_axis(i, turn, axis=1)


def search(tree: BallTree, q: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, open_: np.ndarray, best: Best) -> int:
    """Offer ``best`` the tree's rows with another id and a score from ``low`` to ``high`` of each open query; returns the scores taken."""
    norm = np.linalg.norm(q, axis=1)
    todo, taken = [(0, open_)], 0
    while todo:
        node, rows = todo.pop()
        middle = q[rows] @ tree.centre[node]
        reach = tree.radius[node] * norm[rows]
        slack = SLACK * (np.abs(middle) + reach) + SLACK
        upper, lower = middle + reach + slack, middle - reach - slack
        kth, kth_id = best.score[rows, -1], best.ids[rows, -1]
        alive = (upper >= low[rows]) & (lower <= high[rows]) & (upper >= kth) & ~((tree.least[node] > kth_id) & (upper < kth + 1))
        rows = rows[alive]
        if not rows.size:
            continue
        pair = tree.children[node]
        if pair is None:
            a, b = tree.span[node]
            score = q[rows] @ tree.x[a:b].T
            taken += score.size
            fits = (score >= low[rows, None]) & (score <= high[rows, None]) & (tree.ids[a:b][None, :] != own[rows, None])
            best.offer(rows, np.where(fits, score, -np.inf), tree.ids[a:b])
        else:
            near, far = pair if (q[rows] @ (tree.centre[pair[0]] - tree.centre[pair[1]])).sum() >= 0 else pair[::-1]
            todo += [(far, rows), (near, rows)]
    return taken


def _hit_part(part: pd.DataFrame, queries: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best of a part for each query; ``same``: among rows of the query's label, else among those of others."""
    out = {"query": [], "score": [], "id": []}
    length = part["vector"].map(len).to_numpy()
    asked = queries["vector"].map(len).to_numpy()
    for d in np.intersect1d(length, asked):
        rows, wants = part[length == d], queries[asked == d]
        x, q = np.stack(rows["vector"]).astype(np.float64), np.stack(wants["vector"]).astype(np.float64)
        ids, own = rows["id"].to_numpy(np.int64), wants["id"].to_numpy(np.int64)
        low, high = wants["low"].to_numpy(np.float64), wants["high"].to_numpy(np.float64)
        of_row, names = pd.factorize(rows["label"])
        of_query = pd.Index(names).get_indexer(wants["label"])
        best = Best(len(wants), k)
        for label in range(len(names)):
            open_ = np.flatnonzero((of_query == label) == same)
            if open_.size:
                mine = np.flatnonzero(of_row == label)
                search(BallTree(x[mine], ids[mine]), q, own, low, high, open_, best)
        row, place = np.nonzero(best.score > -np.inf)
        out["query"].append(wants["query"].to_numpy(np.int64)[row])
        out["score"].append(best.score[row, place].astype(np.int64))
        out["id"].append(best.ids[row, place])
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({c: np.concatenate([none, *v]) for c, v in out.items()})


def best_matches(rows: DataFrame, queries: DataFrame, k: int, same: bool, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query, score, id, place): the k best rows of each query, place from 1.

    rows (id, label, vector); queries (query, id, label, vector, low, high): scores
    from low to high count, of rows with another id.
    """
    parts = max(1, math.ceil(rows.count() / part_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(F.lit(n), *c), F.lit(n)).cast("int")
    held = rows.select("id", "label", "vector", deal(["id", "label", "vector"], parts).alias("part"), every(blocks).alias("block"))
    asked = queries.select("query", "id", "label", "vector", "low", "high", deal(["query"], blocks).alias("block"), every(parts).alias("part"))

    def hit(part: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        return _hit_part(part, wants, k, same) if len(part) and len(wants) else pd.DataFrame({"query": [], "score": [], "id": []})

    found = held.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(hit, "query long, score long, id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def whole_numbers(vector: Column, scale: float) -> Column:
    """Components as the whole numbers at or below ``scale`` times themselves."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double"))


def mine(vectors: DataFrame, anchor: Column, label: Column, k: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", **sizes) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows ask; label: the label that counts, both over the columns of ``vectors``.
    Positives are the k best other rows of an anchor's label; a positive's
    negatives are the k best rows of other labels whose score is from low to high
    percent of the positive's.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("raw"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = read.filter("id is not null and label is not null and raw is not null").filter(F.coalesce(F.forall("raw", finite), F.lit(False)))
    rows = write_table(usable.select("id", "label", whole_numbers(F.col("raw"), scale).alias("vector"), "anchor").withColumn("query", F.monotonically_increasing_id()))
    anchors = rows.filter("anchor").select("query", "id", "label", "vector")
    every = F.lit(math.inf)
    positives = write_table(best_matches(rows, anchors.withColumns({"low": -every, "high": every}), k, True, **sizes))
    pairs = positives.select("query", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"), "place").join(anchors, "query")
    pairs = write_table(pairs.withColumn("pair", F.monotonically_increasing_id()))
    # Whole scores from low to high percent of the positive's, in whole numbers.
    first, last = F.col("positive_score") * low, F.col("positive_score") * high
    hundred = F.lit(100).cast("long")
    window = {"low": ((first + F.pmod(-first, hundred)) / 100).cast("double"), "high": ((last - F.pmod(last, hundred)) / 100).cast("double")}
    wanted = pairs.select(F.col("pair").alias("query"), "id", "label", "vector", "positive_score").withColumns(window).filter("low <= high").drop("positive_score")
    negatives = best_matches(rows, wanted, k, False, **sizes)
    found = negatives.withColumnsRenamed({"query": "pair", "score": "negative_score", "id": "negative_id", "place": "rank"}).join(pairs.select("pair", F.col("id").alias("anchor_id"), "positive_id", "positive_score"), "pair")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
