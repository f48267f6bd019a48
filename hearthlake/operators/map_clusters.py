"""Clusters of map points for each zoom: greedy by radius, from the finest zoom to the coarsest.

At a zoom, nodes are taken in a seeded order; one that no earlier centre has within the
radius becomes a centre, and a node belongs to the earliest centre within its
radius. A centre and its nodes are one node of the next coarser zoom, at their weighted mean.

The greedy order is followed without going through the nodes one by one: in a
round, every node that comes before all open nodes within the radius is a centre,
whatever happens elsewhere. Nodes lie on cells smaller than the radius, so only the
first node of a cell can be a centre in a round, and it is compared with the
nodes of 25 cells. A node meets 25 candidates at most, however dense its cell is; cells
with many nodes are dealt to parts. The order is random to the map, so the rounds
grow with the logarithm of the nodes.

Defined results: points without a position or an id have no cluster; points at one
place share theirs; rows that repeat an id share its first position; zooms
without points have no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.operators.skew import dealt_join
from hearthlake.session import materialize

TILE, RADIUS = 512, 50
#: Side of a cell as a share of the radius: two nodes of a cell are always within it.
SIDE = 0.7


def mercator(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Place on the square world map, 0..1 both ways."""
    s = F.sin(F.radians(latitude))
    y = F.lit(0.5) - F.lit(0.25) * F.log((1 + s) / (1 - s)) / F.lit(math.pi)
    return longitude / 360 + F.lit(0.5), F.least(F.greatest(F.coalesce(y, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def _celled(nodes: DataFrame, side: float) -> DataFrame:
    return nodes.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})


def _around(nodes: DataFrame, side: float) -> DataFrame:
    """Nodes as (turn_, at_x, at_y, of) in every cell that their radius reaches."""
    reach = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    spread = _celled(nodes, side).withColumn("o", F.explode(reach))
    return spread.select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("turn").alias("turn_"), F.col("x").alias("at_x"), F.col("y").alias("at_y"), F.col("node").alias("of"))


def _near(r: float) -> Column:
    dx, dy = F.col("x") - F.col("at_x"), F.col("y") - F.col("at_y")
    return dx * dx + dy * dy <= F.lit(r * r)


def _centres(nodes: DataFrame, r: float) -> DataFrame:
    """The nodes that the greedy order makes centres."""
    side, open_, found = r * SIDE, materialize(_celled(nodes, r * SIDE)), None
    columns = nodes.columns
    while not open_.isEmpty():
        first = open_.groupBy("cx", "cy").agg(F.min(F.struct("turn", *(c for c in columns if c != "turn"))).alias("f")).select("f.*").select(*columns)
        candidates = materialize(first)
        # A candidate that an earlier open node has within the radius waits.
        waits = dealt_join(open_.select("cx", "cy", "turn", "x", "y"), _around(candidates, side), ["cx", "cy"], ["turn"]).filter((F.col("turn") < F.col("turn_")) & _near(r)).select(F.col("of").alias("node")).distinct()
        new = materialize(candidates.join(waits, "node", "left_anti").select(*columns))
        covered = dealt_join(open_.select("cx", "cy", "turn", "x", "y", "node"), _around(new, side), ["cx", "cy"], ["turn"]).filter(_near(r)).select("node").distinct()
        open_ = materialize(open_.join(covered, "node", "left_anti").select(*open_.columns))
        found = new if found is None else found.unionByName(new)
    return materialize(found) if found is not None else nodes.limit(0)


def cluster_points(points: DataFrame, zooms: list[int], id_col: str = "id", radius: int = RADIUS, seed: int = 7) -> DataFrame:
    """Rows (zoom, id, cluster, x, y, points): the cluster of every point at every zoom, its place on the world map and its size.

    points (id_col, latitude, longitude), ids as long.
    """
    x, y = mercator(F.col("latitude"), F.col("longitude"))
    read = points.filter("latitude is not null and longitude is not null").select(F.col(id_col).cast("long").alias("node"), x.alias("x"), y.alias("y")).filter("node is not null")
    place = read.groupBy("node").agg(F.min(F.struct("x", "y")).alias("p"))
    turn = F.struct(F.xxhash64(F.lit(seed), "node"), "node").alias("turn")
    nodes = materialize(place.select("node", "p.x", "p.y", F.lit(1).cast("long").alias("weight"), turn))
    owner = nodes.select(F.col("node").alias("id"), "node")
    out = None
    for zoom in sorted(zooms, reverse=True):
        r = radius / (TILE * 2.0**zoom)
        centres = _around(_centres(nodes, r), r * SIDE)
        met = dealt_join(_celled(nodes, r * SIDE), centres, ["cx", "cy"], ["node"]).filter(_near(r))
        joined = met.groupBy("node").agg(F.min_by("of", "turn_").alias("cluster"), *(F.first(c).alias(c) for c in ("x", "y", "weight")))
        joined = materialize(joined)
        mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
        merged = materialize(joined.groupBy(F.col("cluster").alias("node")).agg(mean("x"), mean("y"), F.sum("weight").alias("weight")).select("node", "x", "y", "weight", turn))
        owner = materialize(owner.join(joined.select("node", "cluster"), "node").select("id", F.col("cluster").alias("node")))
        level = owner.join(merged, "node").select(F.lit(zoom).alias("zoom"), "id", F.col("node").alias("cluster"), "x", "y", F.col("weight").alias("points"))
        out = level if out is None else out.unionByName(level)
        nodes = merged
    return out
