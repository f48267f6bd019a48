"""Coordinates for listings without any: cache, answers of a provider within a budget, then the middle of the neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.geo import in_box
from hearthlake.functions.listing_text import geocode_key
from hearthlake.functions.scalars import blank_to_null
from hearthlake.operators.spatial import locate


def _allowed(asking: DataFrame, budget: int) -> DataFrame:
    """``asking`` with ``__in``: whether budget was left when its turn came.

    A source's rows take turns in the order of ``__pos``. An attempt is free where the
    cache, or an answer to the same address before it, has a place; every other one
    costs one. What matters is the row that spends the last of the budget, so only
    the first ``budget`` costing rows of a source are ranked.
    """
    first = asking.filter("__key is not null").groupBy("source_id", "__key").agg(F.min("__pos").alias("__first"))
    met = asking.join(first, ["source_id", "__key"], "left")
    free = F.coalesce(F.col("__cached") | (F.col("__answered") & (F.col("__pos") > F.col("__first"))), F.lit(False))
    ranked = met.filter(~free).select("source_id", "__pos", F.row_number().over(Window.partitionBy("source_id").orderBy("__pos")).alias("__n")).filter(F.col("__n") <= budget)
    last = ranked.filter(F.col("__n") == budget).select("source_id", F.col("__pos").alias("__last"))
    return met.join(last, "source_id", "left").withColumn("__in", F.lit(budget > 0) & (F.col("__last").isNull() | (F.col("__pos") <= F.col("__last"))))


def resolve(rows: DataFrame, cache: DataFrame, answers: DataFrame, centroids: DataFrame, polygons: DataFrame, budget: int = 20, order_col: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` with coordinates filled in, and the new rows of the cache.

    rows (source_id, geocode_enabled, address_raw, neighborhood, latitude, longitude,
    geocode_precision), cache and answers (address_key, latitude, longitude,
    precision; null coordinates: nothing was found), centroids (name, latitude,
    longitude), polygons (name, ord, coordinates). ``order_col`` numbers the rows.
    Places outside the box are not used. An address that was asked for and has no
    answer enters the cache as a failure. A place that is no centre of a
    neighbourhood also fills a blank neighbourhood. ``geocoded`` says where a
    place came from: cache, network, fallback, or null.
    """
    names = rows.columns
    key = blank_to_null(geocode_key(F.col("address_raw")))
    lacking = F.col("latitude").isNull() | F.col("longitude").isNull()
    need = rows.filter(lacking).withColumns({"__pos": F.col(order_col), "__key": key, "__asks": F.coalesce("geocode_enabled", F.lit(False)) & (F.coalesce("address_raw", F.lit("")) != "")})

    def known(df: DataFrame, prefix: str) -> DataFrame:
        one = df.groupBy(F.col("address_key").alias("__key")).agg(F.first(F.struct("latitude", "longitude", "precision")).alias(f"__{prefix}_hit"))
        return one.withColumn(f"__{prefix}_there", F.lit(True))

    met = need.join(known(cache, "cache"), "__key", "left").join(known(answers, "answer"), "__key", "left")
    place = lambda prefix: F.col(f"__{prefix}_hit.latitude").isNotNull() & F.col(f"__{prefix}_hit.longitude").isNotNull()
    in_cache = F.coalesce("__cache_there", F.lit(False))
    met = met.withColumns({"__cached": in_cache & place("cache"), "__answered": ~in_cache & place("answer")})
    asked = _allowed(met.filter("__asks"), budget)
    waiting = met.filter("not __asks").withColumns({"__first": F.lit(None).cast(asked.schema["__first"].dataType), "__last": F.lit(None).cast(asked.schema["__last"].dataType), "__in": F.lit(False)})
    tried = asked.unionByName(waiting)

    hit = F.when(F.col("__in") & F.col("__cached"), F.col("__cache_hit")).when(F.col("__in") & F.col("__answered"), F.col("__answer_hit"))
    tried = tried.withColumn("__hit", hit)
    tried = tried.withColumn("__hit", F.when(in_box(F.col("__hit.latitude"), F.col("__hit.longitude")), F.col("__hit")))
    middle = centroids.select(F.col("name").alias("neighborhood"), F.struct("latitude", "longitude", F.lit("neighborhood").alias("precision")).alias("__middle"))
    tried = tried.join(middle, "neighborhood", "left")
    again = F.col("__pos") > F.col("__first")
    source = F.when(F.col("__hit").isNotNull(), F.when(F.col("__cached") | again, "cache").otherwise("network")).when(F.col("__middle").isNotNull(), "fallback")
    spot = F.coalesce("__hit", "__middle")
    put = lambda field, old: F.when(spot.isNotNull(), spot[field]).otherwise(F.col(old))
    filled = tried.withColumns({"geocoded": source, "latitude": put("latitude", "latitude"), "longitude": put("longitude", "longitude"), "geocode_precision": put("precision", "geocode_precision")}).select(*names, "geocoded")
    blank = (F.coalesce("neighborhood", F.lit("")) == "") & F.col("latitude").isNotNull() & (F.col("geocode_precision") != "neighborhood")
    hoods = locate(filled, polygons).withColumn("neighborhood", F.when(blank, F.coalesce("area", "neighborhood")).otherwise(F.col("neighborhood"))).select(*names, "geocoded")
    done = rows.filter(~lacking).withColumn("geocoded", F.lit(None).cast("string")).unionByName(hoods)

    calls = asked.filter(F.col("__in") & ~in_cache & F.col("__key").isNotNull()).groupBy(F.col("__key").alias("address_key")).agg(F.first("__answer_hit").alias("h"))
    fresh = calls.select("address_key", "h.latitude", "h.longitude", F.coalesce("h.precision", F.lit("unknown")).alias("precision"))
    return done, fresh
