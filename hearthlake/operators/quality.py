"""Coverage profile of a batch and the issues it raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.urls import canonical_url

# What a batch must reach.
LEAST_PRICE, LEAST_LOCATION, MOST_UNPARSED, LEAST_PHOTOS, DETAILS = 0.6, 0.6, 0.1, 0.3, 10


def profile(batch: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a batch in one pass, and how many ids and URLs repeat. ``by``: columns to profile apart."""
    c = F.col
    by = by or []
    filled = lambda x: F.coalesce(x != "", F.lit(False))
    spot = c("latitude").isNotNull() & c("longitude").isNotNull()
    counts = batch.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(c("original_url").rlike("^https?://"), F.lit(False))).alias("with_url"), F.count_if(filled(F.trim("title"))).alias("with_title"),
        F.count_if(c("price_monthly").isNotNull()).alias("with_price"), F.count_if(c("price_monthly").isNull() & filled(c("price_raw"))).alias("price_unparsed"),
        F.count_if(filled(c("neighborhood")) | filled(c("address_raw")) | spot).alias("with_location"), F.count_if(spot).alias("with_coordinates"),
        F.count_if(F.coalesce(F.size("photos"), F.lit(0)) > 0).alias("with_photos"), F.count_if(filled(c("description"))).alias("with_description"),
        F.count_if(c("fetch_depth") == "detail").alias("detail_depth"), F.count_if(~filled(c("source_listing_id"))).alias("missing_id"),
    )

    def repeats(key: Column, name: str) -> DataFrame:
        keyed = batch.select(*by, key.alias("__key")).filter("__key is not null and __key <> ''").groupBy(*by, "__key").count()
        return keyed.groupBy(*by).agg(F.sum(F.col("count") - 1).alias(name))

    url = F.when(c("original_url").rlike("^https?://"), F.coalesce(canonical_url(c("original_url")), c("original_url")))
    out = counts
    for key, name in ((c("source_listing_id"), "duplicate_ids"), (url, "duplicate_urls")):
        found = repeats(key, name)
        out = out.join(found, by, "left") if by else out.join(F.broadcast(found), F.lit(True), "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.withColumn("card_depth", F.col("total") - F.col("detail_depth"))


def issues(row: dict[str, Column] | None = None) -> Column:
    """Array of issue codes of a profile, errors first; every error code starts with ``error:``."""
    c = (row or {}).get
    v = lambda name: c(name) if row else F.col(name)
    total = v("total")
    some = total > 0
    return F.array_compact(
        F.array(
            F.when(v("with_url") < total, "error:missing_original_url"), F.when(v("with_title") < total, "error:missing_title"), F.when(v("missing_id") > 0, "error:missing_source_listing_id"),
            F.when(v("duplicate_ids") > 0, "error:duplicate_source_listing_id"), F.when(v("duplicate_urls") > 0, "error:duplicate_original_url"),
            F.when(some & (v("with_price") < LEAST_PRICE * total), "warning:low_price_coverage"), F.when(some & (v("price_unparsed") > MOST_UNPARSED * total), "warning:price_parse_failures"),
            F.when(some & (v("with_location") < LEAST_LOCATION * total), "warning:low_location_coverage"),
            F.when((v("detail_depth") >= DETAILS) & (v("with_photos") < LEAST_PHOTOS * v("detail_depth")), "warning:low_photo_coverage"),
        )
    )


def verdict(codes: Column, skipped: Column) -> Column:
    """PASS, PARTIAL (warnings only), FAIL or SKIPPED."""
    return F.when(skipped, "SKIPPED").when(F.exists(codes, lambda x: x.startswith("error:")), "FAIL").when(F.size(codes) > 0, "PARTIAL").otherwise("PASS")
