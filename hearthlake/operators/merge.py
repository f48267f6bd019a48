"""Merge of a batch of observations into a keyed snapshot, with events and price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hearthlake.functions.hashes import record_id
from hearthlake.functions.scalars import plain_number
from hearthlake.operators.liveness import MISSING

KEY = ["source_id", "source_listing_id"]
# How exact a position is.
PRECISION = {"exact_address": 5, "building": 4, "block": 3, "neighborhood": 2, "city": 1, "unknown": 0}
GONE = ["removed_by_source", "expired"]


def _rank(precision: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PRECISION.items() for x in pair))
    return F.coalesce(F.try_element_at(table, precision), F.lit(0))


def fold_batch(batch: DataFrame, detail_fields: list[str], position: str = "batch_pos") -> DataFrame:
    """One row per key: later rows of a batch win field by field, and a card never wins over details.

    Null fields never win. Position, price and title come from the last row that has them.
    """
    order = F.struct(position)
    # A null order value loses in max_by, so only rows that have the field take part.
    last = lambda c, cond=None: F.max_by(F.col(c), F.when(F.col(c).isNotNull() if cond is None else F.col(c).isNotNull() & cond, order)).alias(c)
    detail = F.col("fetch_depth") == "detail"
    every = [c for c in batch.columns if c not in (*KEY, position, "fetch_depth", *detail_fields)]
    return batch.groupBy(*KEY).agg(
        F.max_by("fetch_depth", F.struct(detail, F.col(position))).alias("fetch_depth"), *(last(c) for c in every), *(last(c, detail) for c in detail_fields), F.count(F.lit(1)).alias("batch_rows")
    )


def merge_batch(snapshot: DataFrame, batch: DataFrame, now: Column, run_id: Column, detail_fields: list[str]) -> DataFrame:
    """Old and new rows side by side with the merged values: one shuffle join of both on the key.

    snapshot and batch have KEY, price_monthly, price_effective_monthly,
    price_raw, title, neighborhood, listing_status, fetch_depth (batch), content_hash,
    latitude, longitude, geocode_precision, photos and ``detail_fields``; the
    snapshot also listing_id, first_seen_at, last_seen_at, stale_status,
    missing_since and detail_fetched_at. Returns one row per key of either side
    with all snapshot columns, and the struct ``change`` that tells what happened.
    """
    o, n = snapshot.select(F.struct(*snapshot.columns).alias("o"), *KEY), batch.select(F.struct(*batch.columns).alias("n"), *KEY)
    both = o.join(n, KEY, "full_outer")
    old, new = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    detail = F.coalesce(new("fetch_depth") == "detail", F.lit(False))
    arrives_gone = new("listing_status").isin(GONE)
    price_changed = known & seen & (old("price_monthly") != new("price_monthly"))
    price_changed = F.coalesce(price_changed, F.lit(False))
    hash_changed = F.coalesce(known & seen & detail & (~old("content_hash").eqNullSafe(new("content_hash"))) & new("content_hash").isNotNull(), F.lit(False))
    content_changed = hash_changed & ~price_changed
    was_missing = F.coalesce(known & seen & old("stale_status").isin(MISSING), F.lit(False))
    status_changed = F.coalesce(known & seen & (old("listing_status") != new("listing_status")), F.lit(False))
    better = F.coalesce(seen & new("latitude").isNotNull() & (_rank(new("geocode_precision")) > F.when(known & old("latitude").isNotNull(), _rank(old("geocode_precision"))).otherwise(-1)), F.lit(False))
    effective_changed = F.coalesce(known & detail & new("price_effective_monthly").isNotNull() & ~new("price_effective_monthly").eqNullSafe(old("price_effective_monthly")), F.lit(False))
    observed = (seen & ~known) | price_changed | effective_changed
    take = lambda c: F.coalesce(new(c), old(c))
    keep_first = lambda c: F.coalesce(old(c), new(c))
    on_detail = lambda c: F.when(detail | ~known, take(c)).otherwise(old(c))
    photos = F.when(~known, F.coalesce(new("photos"), F.array().cast("array<string>"))).when(F.coalesce(F.size(new("photos")), F.lit(0)) == 0, old("photos")).when(detail | (F.coalesce(F.size(old("photos")), F.lit(0)) == 0), new("photos")).otherwise(old("photos"))
    values = {
        "listing_id": F.coalesce(old("listing_id"), record_id("lst", *map(F.col, KEY))), "first_seen_at": F.coalesce(old("first_seen_at"), now),
        "last_seen_at": F.when(seen, now).otherwise(old("last_seen_at")), "price_monthly": take("price_monthly"), "price_raw": take("price_raw"),
        "price_effective_monthly": on_detail("price_effective_monthly"), "title": F.coalesce(F.nullif(new("title"), F.lit("")), old("title")), "neighborhood": keep_first("neighborhood"),
        "listing_status": take("listing_status"), "content_hash": F.when(detail | ~known, take("content_hash")).otherwise(old("content_hash")), "photos": photos,
        "stale_status": F.when(seen & arrives_gone & (status_changed | ~known), "likely_unavailable").when(seen, "active").otherwise(old("stale_status")),
        "missing_since": F.when(seen & arrives_gone & (status_changed | ~known), now).when(seen, F.lit(None)).otherwise(old("missing_since")),
        "detail_fetched_at": F.when(detail, now).otherwise(old("detail_fetched_at")), "run_id": F.when(seen, run_id).otherwise(old("run_id")),
    }
    values |= {c: F.when(better, new(c)).otherwise(old(c)) for c in ("latitude", "longitude", "geocode_precision")}
    values |= {c: on_detail(c) for c in detail_fields}
    change = F.struct(
        F.when(~seen, F.lit(None)).when(~known, "new").when(content_changed | price_changed, "changed").otherwise("unchanged").alias("kind"), price_changed.alias("price_changed"),
        content_changed.alias("content_changed"), was_missing.alias("reappeared"), status_changed.alias("status_changed"), observed.alias("observed"),
        old("price_monthly").alias("old_price"), old("listing_status").alias("old_status"), old("stale_status").alias("old_stale"), old("content_hash").alias("old_hash"),
    )
    columns = [c for c in snapshot.columns if c not in KEY]
    return both.select(*KEY, *(values[c].alias(c) if c in values else take(c).alias(c) for c in columns), change.alias("change"))


def snapshot_of(merged: DataFrame) -> DataFrame:
    return merged.drop("change")


def events_of(merged: DataFrame, now: Column, run_id: Column) -> DataFrame:
    """The event log of a merge: one row per thing that happened to a listing."""
    ch = lambda c: F.col(f"change.{c}")
    event = lambda kind, old, new: F.struct(F.lit(kind).alias("event_type"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    none = F.lit(None).cast("string")
    happened = F.array_compact(
        F.array(
            F.when(ch("kind") == "new", event("first_seen", none, plain_number(F.col("price_monthly")))),
            F.when(ch("reappeared"), event("reappeared", ch("old_stale"), F.lit("active"))),
            F.when(ch("status_changed"), event("listing_status_change", ch("old_status"), F.col("listing_status"))),
            F.when(ch("price_changed"), event("price_change", plain_number(ch("old_price")), plain_number(F.col("price_monthly")))),
            F.when(ch("content_changed"), event("content_change", ch("old_hash"), F.col("content_hash"))),
        )
    )
    rows = merged.filter(ch("kind").isNotNull()).select("listing_id", F.explode(happened).alias("e")).select("listing_id", "e.*")
    return rows.select(record_id("evt", F.col("listing_id"), run_id, F.col("event_type")).alias("event_id"), "listing_id", run_id.alias("run_id"), "event_type", "old_value", "new_value", now.alias("created_at"))


def price_observations(merged: DataFrame, now: Column, run_id: Column) -> DataFrame:
    """Price history rows: at first sight, and where a price really changed."""
    rows = merged.filter(F.col("change.observed"))
    return rows.select(record_id("prc", F.col("listing_id"), run_id).alias("price_id"), "listing_id", "price_monthly", "price_effective_monthly", run_id.alias("run_id"), now.alias("observed_at"))


def counters() -> list[Column]:
    """Counters of a merge, to be aggregated or observed over its rows."""
    kind = F.col("change.kind")
    return [
        F.count_if(kind == "new").alias("n_new"), F.count_if(kind == "changed").alias("n_changed"), F.count_if(kind == "unchanged").alias("n_unchanged"),
        F.count_if("change.price_changed").alias("n_price_changes"), F.count_if("change.reappeared").alias("n_reappeared"), F.count_if("change.observed").alias("n_observed"),
    ]


def run_counters(merged: DataFrame) -> DataFrame:
    """One row of counters of a merge."""
    return merged.agg(*counters())


def observed(merged: DataFrame) -> tuple[DataFrame, Observation]:
    """``merged`` and its counters, which the job that writes or reads it fills on the way.

    Nothing may run the rows a second time in between, such as a shuffle by ranges, which samples them first.
    """
    seen = Observation()
    return merged.observe(seen, *counters()), seen


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace the rows of ``table`` with their keys; columns that a row leaves null keep the old value."""
    fresh = rows.select(*keys, *(F.col(c).alias(f"__{c}") for c in rows.columns if c not in keys), F.lit(True).alias("__new"))
    both = table.withColumn("__old", F.lit(True)).join(fresh, keys, "full_outer")
    mixed = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(c)
    return both.select(*(F.col(c) if c in keys else mixed(c) for c in table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it lacks; of equal keys among the rows one is taken."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in ``gone``."""
    keys = gone.select(F.col(gone.columns[0]).alias("__k")).distinct()
    return parents.join(keys, F.col(parent_key) == F.col("__k"), "left_anti"), children.join(keys, F.col(child_key) == F.col("__k"), "left_anti")


def replace_set(table: DataFrame, computed: DataFrame, key: str, created: str, now: Column) -> DataFrame:
    """The table becomes equal to what was computed; rows that were there keep their creation time."""
    old = table.select(F.col(key), F.col(created).alias("__created"))
    return computed.join(old, key, "left").withColumn(created, F.coalesce("__created", now)).drop("__created")


def missing_set(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the snapshot that a batch of their source did not bring."""
    return snapshot.join(batch.select("source_id").distinct(), "source_id", "left_semi").join(batch.select(*KEY), KEY, "left_anti")


def pick_in_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
