"""Connected components of an edge table, by repeated contraction.

Each round every vertex points at the neighbour (or itself) that comes first in
an order, and the edges are rewritten between the vertices pointed at. The first
round's order is that of the ids, which contracts stars around their smallest
vertex at once; each later round draws a random one. Random orders keep pointer chains short, so the edge
table shrinks by a constant factor a round whatever the shape of the graph.
Only joins and partial aggregations are used; nothing is collected but the
number of edges left. Once no more than LAST_EDGES are left, however many there
were, one task labels their vertices, which spares the rounds of a table that is
small already. ``local_passes`` contract the edges within tasks before
that: every task replaces a bounded number of edges at a time by stars around the
smallest vertex of what they connect, so that few rounds are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.session import materialize, shuffle_partitions

#: Rounds whose pointers are followed in one plan.
ROUNDS_A_PLAN = 3
#: Edges that a task contracts at a time, and parts that the edges of one vertex are dealt to.
LOCAL_EDGES, LOCAL_PARTS = 1_000_000, 64
#: Edges (16 bytes each) that end the rounds, as one task labels them at once.
LAST_EDGES = 200_000


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the smallest of 0..n-1 of each component of the pairs (a, b), one for each other member."""
    label = np.arange(n)
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of the same components, u the smallest vertex of what LOCAL_EDGES of the given ones connect."""

    def contract(held: list[np.ndarray]) -> pd.DataFrame:
        edges = np.concatenate(held)
        names, at = np.unique(edges, return_inverse=True)
        a, b = at.reshape(edges.shape).T
        member, root = spanning(a, b, len(names))
        return pd.DataFrame({"u": names[root], "v": names[member]})

    held, n = [], 0
    for batch in batches:
        held.append(batch[["u", "v"]].to_numpy(dtype=np.int64))
        n += len(batch)
        if n >= LOCAL_EDGES:
            yield contract(held)
            held, n = [], 0
    if n:
        yield contract(held)


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every vertex of all the edges (u, v) with the smallest vertex that they connect it with."""
    edges = np.concatenate([np.zeros((0, 2), dtype=np.int64), *(b[["u", "v"]].to_numpy(dtype=np.int64) for b in batches)])
    names, at = np.unique(edges, return_inverse=True)
    label = np.arange(len(names))
    member, root = spanning(*at.reshape(edges.shape).T, len(names))
    label[member] = root
    yield pd.DataFrame({"id": names, "root": names[label]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_passes: int = 0) -> DataFrame:
    """Rows ``(id, component_id)`` for every vertex that has an edge to another one.

    ``component_id`` is the smallest vertex reachable. Vertices without edges do
    not appear; null ends and loops are ignored, repeated edges count once.
    """
    spark = edges.sparkSession
    plain = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    for k in range(local_passes):
        # Edges meet by the one end or the other; the first end is the smaller one, which may be that of most edges, so its edges go to parts.
        ends = [F.col("v")] if k % 2 else [F.col("u"), F.pmod(F.col("v"), F.lit(LOCAL_PARTS))]
        plain = plain.repartition(shuffle_partitions(spark), *ends).mapInPandas(_stars, "u long, v long")
    left = materialize(plain.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    count = left.count()
    if not count:
        return spark.createDataFrame([], "id long, component_id long")
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if count <= LAST_EDGES:
            break
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.xxhash64(F.col(c), F.lit(r * 7919 + 17)) if r else F.col(c)
        # The neighbour first in this round's order; the vertex itself if it is first.
        first = (
            both.groupBy("u")
            .agg(F.min(F.struct(order("v").alias("o"), F.col("v").alias("v"))).alias("best"))
            .select("u", F.when(order("u") <= F.col("best.o"), F.col("u")).otherwise(F.col("best.v")).alias("to"))
        )
        first = materialize(first)
        maps.append(first)
        left = materialize(
            left.join(first.withColumnRenamed("to", "a"), "u")
            .join(first.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .filter("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct()
        )
        count = left.count()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = materialize(left.coalesce(1).mapInPandas(_labels, "id long, root long"))
    if not maps:
        return found.withColumnRenamed("root", "component_id")
    # Follow the pointers of the rounds from the last one back; a few rounds at a time, as one plan of all keeps the driver busy with dozens of stages at once.
    for k, step in enumerate(reversed(maps), 1):
        found = (
            step.select(F.col("u").alias("id"), F.col("to"))
            .join(found.select(F.col("id").alias("to"), "root"), "to", "left")
            .select("id", F.coalesce("root", "to").alias("root"))
        )
        if k % ROUNDS_A_PLAN == 0:
            found = materialize(found)
    smallest = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(smallest, "root").select("id", "component_id")
