"""Exact medians whose memory does not grow with a group.

Values are counted first, by group and value, so a group with most of the rows is as
many counters as it has values. Where a group still has more than ``FEW`` values,
the interval that holds the wanted rank is narrowed: quantiles of the values left,
from a sketch of bounded size, cut them into ``CUTS`` parts, the parts are
counted, and the one with the rank stays. Each round keeps about a ``CUTS``-th of the
values, whatever their distribution. What is left is at most ``FEW`` values, whose
running count gives the rank.

Defined results: null values and groups without values have no row; NaN is the
largest value; an even number of values has the mean of the middle two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.operators.skew import dealt_join
from hearthlake.session import materialize

FEW, CUTS = 4096, 64


def _met(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each target's interval; the values of a group are dealt to parts, its targets (two at most) go to each."""
    return dealt_join(values, targets, keys, ["value"]).filter((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))))


def exact_medians(counts: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """Rows (keys, median, n) of counted values: counts (keys, value double, n long), keys without nulls."""
    counts = materialize(counts.filter("value is not null").groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("left"))
    ranks = F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    none = F.lit(None).cast("double")
    targets = materialize(totals.select(*keys, "total", "left", F.explode(ranks).alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below")))
    done = targets.filter(F.col("left") <= few)
    large = targets.filter(F.col("left") > few)
    target, part = [*keys, "rank"], Window.partitionBy(*keys, "rank").orderBy("part")
    while not large.isEmpty():
        scope = _met(counts, large, keys)
        cuts = scope.groupBy(*target).agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts"))
        held = large.join(cuts, target)
        parts = _met(counts, held, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
        parts = parts.groupBy(*target, "total", "below", "part").agg(F.sum("n").alias("here"), F.count(F.lit(1)).alias("left"), F.min("value").alias("low"), F.max("value").alias("high"))
        # A target has CUTS parts at most.
        parts = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("here").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        kept = materialize(parts.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("here"))).select(*targets.columns))
        done, large = done.unionByName(kept.filter(F.col("left") <= few)), kept.filter(F.col("left") > few)
    running = Window.partitionBy(*target).orderBy("value")
    found = _met(counts, done, keys).withColumn("upto", F.col("below") + F.sum("n").over(running)).filter(F.col("upto") > F.col("rank"))
    found = found.groupBy(*target).agg(F.min("value").alias("value"), F.first("total").alias("total"))
    return found.groupBy(*keys).agg(F.avg("value").alias("median"), F.first("total").alias("n"))
