"""Selection of what needs work, within budgets and cost caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.scalars import round_half_up
from hearthlake.operators.prefix import running_before

#: Price per million tokens of input and output where a model has none of its own; a parameter, not a bill.
DEFAULT_PRICE = (3.0, 15.0)


def needs_work(items: DataFrame, prior: DataFrame, key: str, hash_col: str, version: int, force: bool = False) -> DataFrame:
    """Items with ``need``: forced, never done, failed last time, done by another version or on other content."""
    before = prior.select(F.col(key), F.col("content_hash").alias("__hash"), F.col("version").alias("__version"), F.col("error").alias("__error"), F.lit(True).alias("__done"))
    met = items.join(before, key, "left")
    need = F.lit(force) | F.col("__done").isNull() | F.col("__error").isNotNull() | (~F.col("__version").eqNullSafe(F.lit(version))) | (~F.col("__hash").eqNullSafe(F.col(hash_col)))
    return met.withColumn("need", need).drop("__hash", "__version", "__error", "__done")


def cost_usd(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, price_in: Column | float = DEFAULT_PRICE[0], price_out: Column | float = DEFAULT_PRICE[1]) -> Column:
    """Estimated cost to six digits: cache reads at a tenth, cache writes at five quarters of the input price."""
    price_in, price_out = (p if isinstance(p, Column) else F.lit(float(p)) for p in (price_in, price_out))
    million = F.lit(1_000_000.0)
    total = tokens_in / million * price_in + tokens_out / million * price_out + cache_read / million * price_in * F.lit(0.1) + cache_write / million * price_in * F.lit(1.25)
    return round_half_up(total, 6)


def within_cap(items: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Items with ``spent`` before them and whether they still run: the cap is tested before each one. ``keys`` may be empty."""
    return running_before(items, keys, order, cost, "spent").withColumn("runs", F.col("spent") < cap)


def plan_fetches(page: DataFrame, known: DataFrame, budget: int) -> DataFrame:
    """Detail pages to fetch per source: new ones, then those never fetched, then those whose price moved.

    page (source_id, listing_id, pos, price); known (source_id, listing_id,
    price, detail_fetched_at, stale_status). Known listings without details that
    are not on the page join behind it while they are active or missed once.
    """
    keys = ["source_id", "listing_id"]
    had = known.select(*keys, F.col("price").alias("__price"), F.col("detail_fetched_at").alias("__detail"), F.lit(True).alias("__known"))
    on_page = page.join(had, keys, "left")
    reason = F.when(F.col("__known").isNull(), "new").when(F.col("__detail").isNull(), "backlog").when(F.col("price") != F.col("__price"), "price_moved")
    first = on_page.select(*keys, "pos", reason.alias("reason"))
    off = known.filter("detail_fetched_at is null and stale_status in ('active', 'missing_once')").join(page.select(*keys), keys, "left_anti")
    behind = off.select(*keys, F.lit(None).cast("int").alias("pos"), F.lit("backlog").alias("reason"))
    rows = first.unionByName(behind).filter("reason is not null")
    rank = F.when(F.col("reason") == "new", 0).when(F.col("reason") == "backlog", 1).otherwise(2)
    order = Window.partitionBy("source_id").orderBy(rank, F.asc_nulls_last("pos"), "listing_id")
    return rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= budget)
