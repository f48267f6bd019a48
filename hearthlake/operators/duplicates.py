"""Duplicate listings: typed keys, guarded links to the first holder of a key, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.hashes import group_id, photo_key
from hearthlake.functions.listing_text import address_key, address_only_key, effective_unit, title_key
from hearthlake.functions.scalars import plain_number
from hearthlake.functions.urls import canonical_url
from hearthlake.operators.components import connected_components
from hearthlake.session import materialize

# How much each reason says, strongest first.
CONFIDENCE = ["exact", "high", "medium", "low"]
REASONS = {
    "same_canonical_url": "exact", "same_address_unit": "high", "same_address_price_beds_baths": "high", "same_photo_hash": "medium", "same_description_hash": "medium",
    "similar_title_price_neighborhood": "low", "repost_candidate": "medium",
}


def with_keys(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ord, unit, address and the array ``keys`` of (reason, key)."""
    c = F.col
    # Columns of their own, as keys name them several times and each takes a row of regexes.
    parsed = {
        "unit": effective_unit(c("unit_number_public"), c("title")), "address": address_only_key(c("address_normalized"), c("address_raw")),
        "__whole": address_key(F.coalesce(c("address_normalized"), c("address_raw")), c("unit_number_public")),
    }
    address, whole = c("address"), c("__whole")
    whole = F.when(F.coalesce(c("unit_number_public") != "", F.lit(False)) | whole.rlike("[0-9]"), whole)
    specs = F.concat_ws("|", address, plain_number(c("price_monthly")), plain_number(c("bedrooms")), plain_number(c("bathrooms")))
    specs = F.when(address.isNotNull() & c("price_monthly").isNotNull() & c("bedrooms").isNotNull() & c("bathrooms").isNotNull(), specs)
    key = lambda reason, value: F.struct(F.lit(reason).alias("reason"), value.alias("key"))
    single = F.array(
        key("same_canonical_url", canonical_url(c("original_url"))), key("same_address_unit", whole), key("same_address_price_beds_baths", specs),
        key("similar_title_price_neighborhood", title_key(c("title"), c("price_monthly"), c("neighborhood"))), key("same_description_hash", c("description_hash")),
    )
    photos = F.transform(F.array_distinct(F.transform(F.coalesce("photos", F.array().cast("array<string>")), photo_key)), lambda p: key("same_photo_hash", F.concat(c("source_id"), F.lit("|"), p)))
    keys = F.filter(F.concat(single, photos), lambda k: k["key"].isNotNull())
    return candidates.withColumns(parsed).withColumn("keys", keys).drop("__whole")


def links(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Rows (src, dst, reason): each later holder of a key linked to its first one, where the guard allows it.

    ``nid`` is a number that identifies a candidate. A key is a star, so a key that
    a third of all rows hold costs as many rows as it has holders; its first
    holder is found by an aggregate that combines before the shuffle.
    """
    # Spark would ask before an inner explode whether there are keys, and make them all once more for that.
    rows = with_keys(candidates).select("nid", F.struct(*order, "nid").alias("o"), "unit", "address", F.explode_outer("keys").alias("k")).filter("k is not null").select("nid", "o", "unit", "address", "k.reason", "k.key")
    rows = materialize(rows)  # both sides of the join read the keys, none the texts
    first = rows.groupBy("reason", "key").agg(F.min_by(F.struct(F.col("nid").alias("a_nid"), F.col("unit").alias("a_unit"), F.col("address").alias("a_address")), "o").alias("a"), F.count(F.lit(1)).alias("n"))
    met = rows.join(first.filter("n > 1").select("reason", "key", "a.*"), ["reason", "key"]).filter("nid <> a_nid")
    units_ok = ~F.coalesce(F.col("unit") != F.col("a_unit"), F.lit(False))
    addresses_ok = ~F.coalesce(F.col("address") != F.col("a_address"), F.lit(False))
    guard = (
        F.when(F.col("reason").isin("same_canonical_url", "same_address_price_beds_baths"), units_ok)
        .when(F.col("reason") == "same_photo_hash", F.col("unit").eqNullSafe(F.col("a_unit")) & addresses_ok)
        .when(F.col("reason") == "same_description_hash", units_ok & addresses_ok)
        .otherwise(F.lit(True))
    )
    return met.filter(guard).select(F.col("a_nid").alias("src"), F.col("nid").alias("dst"), "reason").distinct()


def primary_order() -> list[Column]:
    """Active first, then last seen, with details, first seen, id."""
    c = F.col
    active = (c("listing_status") == "active") & (c("stale_status") == "active")
    return [
        F.coalesce(active, F.lit(False)).desc(), F.coalesce(c("last_seen_at").cast("string"), F.lit("")).desc(), c("detail_fetched_at").isNotNull().desc(),
        F.coalesce(c("first_seen_at").cast("string"), F.lit("")).asc(), c("id").asc(),
    ]


def duplicate_groups(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One row per group: group_id, confidence, reasons, member_ids, primary_id."""
    found = links(candidates, order)
    members = connected_components(found).withColumnRenamed("id", "nid")
    told = ["id", "source_id", "source_listing_id", "listing_status", "stale_status", "last_seen_at", "detail_fetched_at", "first_seen_at"]
    rows = materialize(candidates.join(members, "nid").select("component_id", *told))  # read three times
    reasons = found.join(members.select(F.col("nid").alias("src"), "component_id"), "src").groupBy("component_id").agg(F.collect_set("reason").alias("reasons"))
    best = rows.withColumn("__n", F.row_number().over(Window.partitionBy("component_id").orderBy(*primary_order()))).filter("__n = 1").select("component_id", F.col("id").alias("primary_id"))
    repost = rows.groupBy("component_id", "source_id").agg(F.count_distinct(F.coalesce("source_listing_id", "id")).alias("k")).groupBy("component_id").agg(F.max("k").alias("k"))
    groups = rows.groupBy("component_id").agg(F.array_sort(F.collect_set("id")).alias("member_ids")).join(reasons, "component_id").join(best, "component_id").join(repost, "component_id")
    content = F.array_contains("reasons", "same_photo_hash") | F.array_contains("reasons", "same_description_hash")
    everything = F.array_sort(F.when(content & (F.col("k") > 1), F.array_append("reasons", "repost_candidate")).otherwise(F.col("reasons")))
    return groups.select(group_id(F.col("member_ids")).alias("group_id"), strongest(everything).alias("confidence"), everything.alias("reasons"), "member_ids", "primary_id")


def strongest(reasons: Column) -> Column:
    """The strongest confidence among the reasons."""
    table = F.create_map(*(F.lit(x) for r, c in REASONS.items() for x in (r, CONFIDENCE.index(c))))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.array_min(F.transform(reasons, lambda r: F.element_at(table, r))) + 1)


def shared_across(df: DataFrame, key: str, area: str) -> DataFrame:
    """Keys that occur in more than one area, letter case aside."""
    return df.filter(F.col(key).isNotNull() & (F.col(area) != "")).groupBy(key).agg(F.count_distinct(F.lower(F.col(area))).alias("areas")).filter("areas > 1")


def same_group(rows: DataFrame, id_col: str = "listing_id", group_col: str = "group_id") -> DataFrame:
    """Each row of a group with the size of the group and the number of its sources."""
    totals = rows.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("members"), F.count_distinct("source_id").alias("sources"))
    return rows.join(totals, group_col).select(id_col, group_col, (F.col("members") - 1).alias("peers"), (F.col("sources") > 1).alias("cross_source"))
