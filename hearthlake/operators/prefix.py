"""Running sums over any number of rows, with no key or a key that holds most of them in one task.

Rows are dealt to ranges of (keys, order) and each range adds up its own rows. A key that
goes on in the next range carries its sum over: one row a range, its first and last
key with their sums, goes to the driver and comes back as what each range
starts with.

Defined results: rows that tie in keys and order are added in any order among
themselves; null costs add nothing; an empty table gives no rows. Sums are exact for
whole costs below 2**53, other ones are rounded as sums of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.session import materialize, shuffle_partitions


def running_before(items: DataFrame, keys: list[str], order: list[str], cost: str, out: str = "spent") -> DataFrame:
    """``items`` with the sum of the costs before each row, within its keys and in the given order."""
    spark = items.sparkSession
    at = [*keys, *order]
    dealt = materialize(items.repartitionByRange(shuffle_partitions(spark), *at).withColumn("__range", F.spark_partition_id()))
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    amount = F.coalesce(F.col(cost).cast("double"), F.lit(0.0))
    sums = dealt.groupBy("__range", key.alias("key")).agg(F.sum(amount).alias("total"))
    ends = sums.groupBy("__range").agg(F.min_by(F.struct("key", "total"), "key").alias("first"), F.max_by(F.struct("key", "total"), "key").alias("last"))
    starts, last, carried = [], None, 0.0
    for r in ends.orderBy("__range").collect():  # one row a range
        if last is None or r["first"]["key"] != last:
            carried = 0.0
        starts.append((r["__range"], carried))
        whole = r["first"]["key"] == r["last"]["key"]
        last, carried = r["last"]["key"], (carried if whole else 0.0) + r["last"]["total"]
    table = spark.createDataFrame(starts, "__range int, __start double")
    # Only the first key of a range goes on from the range before.
    first = ends.select("__range", F.col("first.key").alias("__first"))
    known = F.broadcast(table.join(first, "__range"))  # one row a range
    own = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("__own", F.coalesce(F.sum(amount).over(own), F.lit(0.0))).join(known, "__range")
    start = F.when(key.eqNullSafe(F.col("__first")), F.col("__start")).otherwise(0.0)
    return met.withColumn(out, F.col("__own") + start).select(*items.columns, out)
