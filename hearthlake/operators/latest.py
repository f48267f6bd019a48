"""Newest and first rows per key, trends between runs, and boundaries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``; an aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is smallest in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1. Spark cuts the groups before and after the shuffle."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank_col) <= n)


def run_trend(runs: DataFrame, key: str, started: str, count: str, status: str, skipped: str = "skipped", last: int = 8) -> DataFrame:
    """Per key: newest status, difference of the two newest counts (null if either was skipped), last success among the newest runs."""
    top = top_per_key(runs, [key], [F.col(started).desc(), F.col(count).desc()], last, "__n")
    at = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    out = top.groupBy(key).agg(
        at(1, status).alias("last_status"), at(1, started).alias("last_started"), at(2, status).alias("__before"), at(1, count).alias("__c1"), at(2, count).alias("__c2"),
        F.max(F.when(F.col(status) == "success", F.col(started))).alias("last_success"), F.count(F.lit(1)).alias("runs"),
    )
    trend = F.when((F.col("last_status") != skipped) & (F.col("__before") != skipped), F.col("__c1") - F.col("__c2"))
    return out.select(key, "runs", "last_status", "last_started", "last_success", trend.alias("trend"))


def boundary(runs: DataFrame, started: str, nth: int = 2) -> DataFrame:
    """One row with the nth newest time, null if there are fewer runs."""
    top = runs.select(F.col(started).alias("at")).orderBy(F.col("at").desc()).limit(nth)
    return top.agg(F.when(F.count(F.lit(1)) >= nth, F.min("at")).alias("boundary"))


def rebuild_price_history(listings: DataFrame, changes: DataFrame, history: DataFrame) -> DataFrame:
    """Observations for listings without any: the oldest price known, then every change.

    listings (listing_id, first_seen_at, price); changes (listing_id, at, old_price, new_price).
    """
    bare = listings.join(history.select("listing_id").distinct(), "listing_id", "left_anti")
    oldest = changes.groupBy("listing_id").agg(F.min_by("old_price", "at").alias("oldest"))
    base = bare.join(oldest, "listing_id", "left").select("listing_id", F.col("first_seen_at").alias("observed_at"), F.coalesce("oldest", "price").alias("price"))
    later = changes.join(bare.select("listing_id"), "listing_id", "left_semi").select("listing_id", F.col("at").alias("observed_at"), F.col("new_price").alias("price"))
    return base.unionByName(later)
