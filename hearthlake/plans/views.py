"""Query views: listing cards, source health, browse, search, watched searches, digest report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.geo import haversine_miles
from hearthlake.functions.tags import snippet
from hearthlake.operators import latest, matching, preference, subscriptions


def listing_cards(listings: DataFrame, states: DataFrame, sources: DataFrame, runs: DataFrame, price_changes: DataFrame, digests: DataFrame, now: Column, vision: DataFrame | None = None) -> DataFrame:
    """One card per listing with verdict, source name, last run, last price change and badges.

    vision (listing_id, summary, features) adds visual_summary and visual_features, empty where a listing has none.

    Small tables are joined as they are and adaptive execution broadcasts those
    that turn out small; the boundary is one row.
    """
    last_run = latest.latest_per_key(runs.select("source_id", "started_at", "status"), ["source_id"], ["started_at"]).select("source_id", F.col("status").alias("source_last_run"))
    change = latest.latest_per_key(price_changes.select("listing_id", "at", "old_price", "new_price"), ["listing_id"], ["at"])
    since = latest.boundary(digests, "created_at", 2)
    met = listings.join(states.select("listing_id", F.col("status").alias("user_status")), "listing_id", "left").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")
    met = met.join(last_run, "source_id", "left").join(change, "listing_id", "left").join(F.broadcast(since), F.lit(True), "left")
    c = F.col
    marks = preference.badges(c("user_status"), c("scam_risk_level"), c("stale_status"), c("old_price"), c("new_price"), c("at"), c("first_seen_at"), c("boundary"), c("duplicate_group_id"), c("source_last_run"), now)
    shown = []
    if vision is not None:
        met = met.join(vision.select("listing_id", F.col("summary").alias("visual_summary"), F.col("features").alias("__features")), "listing_id", "left")
        shown = ["visual_summary", F.coalesce("__features", F.array().cast("array<string>")).alias("visual_features")]
    return met.select(*listings.columns, "user_status", F.coalesce("source_name", "source_id").alias("source_name"), "source_last_run", "old_price", "new_price", marks.alias("badges"), *shown)


def source_health(sources: DataFrame, listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: listings, active ones, last run, trend, last success and a status."""
    counts = listings.groupBy("source_id").agg(F.count(F.lit(1)).alias("listings"), F.count_if((F.col("listing_status") == "active") & (F.col("stale_status") != "likely_unavailable")).alias("active"))
    trend = latest.run_trend(runs, "source_id", "started_at", "listings_found", "status")
    met = sources.select(F.col("id").alias("source_id"), "name", "enabled").join(counts, "source_id", "left").join(trend, "source_id", "left")
    status = F.when(~F.col("enabled"), "disabled").when(F.col("last_status").isNull(), "never_run").when(F.col("last_status") == "failed", "failing").when(F.col("last_status") == "partial", "degraded").otherwise("healthy")
    return met.fillna(0, ["listings", "active"]).withColumn("health", status)


def browse(cards: DataFrame, areas: list[str] | None = None, hide_suspicious: bool = False, sort: str = "newest") -> DataFrame:
    """Live listings that the user hasn't put aside, filtered and sorted."""
    c = F.col
    rows = cards.filter(matching.live(c("listing_status"), c("stale_status"), c("price_monthly"), c("price_effective_monthly"), c("user_status"), ["hidden", "not_a_fit"]))
    if areas:
        rows = rows.filter(F.lower("neighborhood").isin([a.lower() for a in areas]))
    if hide_suspicious:
        rows = rows.filter(~F.array_contains("badges", "suspicious") & ~F.array_contains("badges", "verify_carefully"))
    if sort in ("price_asc", "price_desc"):
        return preference.sort_by_price(rows, "price_effective_monthly", "price_monthly", "listing_id", sort == "price_desc")
    return rows.orderBy(c("first_seen_at").desc(), "listing_id")


def search_candidates(listings: DataFrame, center: tuple[float, float] | None = None, radius_miles: float | None = None, cap: int = 5000, include_hidden: bool = False) -> DataFrame:
    """What a search ranks: live listings in the radius (those without a position stay), nearest first, else newest."""
    c = F.col
    live = matching.live(c("listing_status"), c("stale_status"), c("price_monthly"), c("price_effective_monthly"), c("user_status"))
    rows = listings.filter(F.coalesce(c("price_effective_monthly"), c("price_monthly")).isNotNull() if include_hidden else live)
    distance = haversine_miles(F.lit(center[0]), F.lit(center[1]), c("latitude"), c("longitude")) if center else F.lit(None).cast("double")
    rows = rows.withColumn("distance_mi", distance).withColumn("snippet", snippet(c("description")))
    if center and radius_miles is not None:
        rows = rows.filter(c("distance_mi").isNull() | (c("distance_mi") <= radius_miles))
    order = [F.asc_nulls_last("distance_mi")] if center else []
    return rows.orderBy(*order, c("first_seen_at").desc(), "listing_id").limit(cap)


def watched_searches(searches: DataFrame, listings: DataFrame, now: Column, newest: int = 6) -> DataFrame:
    """Per search: matches (known neighbourhood only), how many are less than a day old, and the newest ids."""
    pairs = subscriptions.match_searches(searches, listings).filter(~F.array_contains("result.unknowns", "neighborhood"))
    fresh = F.col("first_seen_at") > now - F.expr("INTERVAL 24 HOURS")
    counts = pairs.groupBy("search_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(fresh).alias("fresh"))
    top = latest.top_per_key(pairs.filter(fresh).select("search_id", "listing_id", "first_seen_at"), ["search_id"], [F.col("first_seen_at").desc(), F.col("listing_id")], newest)
    ids = top.groupBy("search_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "listing_id"))), lambda s: s["listing_id"]).alias("newest_ids"))
    return searches.select("search_id").join(counts, "search_id", "left").join(ids, "search_id", "left").fillna(0, ["matches", "fresh"])


def digest_sections(changes: DataFrame, titles: DataFrame, most: int = 50) -> DataFrame:
    """One row per search: a Markdown section with what is new, cheaper and gone (at most ``most`` lines each)."""
    told = changes.filter("kind in ('new', 'price_drop', 'dropped_out')").join(titles, "listing_id", "left")
    top = latest.top_per_key(told, ["search_id", "kind"], [F.col("listing_id")], most, "__n")
    line = F.concat(F.lit("- "), F.coalesce("title", "listing_id"), F.when(F.col("price").isNotNull(), F.concat(F.lit(" · $"), F.format_number("price", 0))).otherwise(""))
    lists = top.groupBy("search_id").pivot("kind", ["new", "price_drop", "dropped_out"]).agg(F.array_sort(F.collect_list(line)))
    part = lambda name, head: F.when(F.size(name) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(name, "\n")))
    return lists.select("search_id", F.concat_ws("\n\n", part("new", "New"), part("price_drop", "Price drops"), part("dropped_out", "No longer matching")).alias("markdown"))


def digest_totals(changes: DataFrame) -> DataFrame:
    """One row of totals of a digest."""
    return changes.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("new", "price_drop", "unchanged", "dropped_out")))


def map_points(cards: DataFrame, selected: str | None = None) -> DataFrame:
    """GeoJSON points of listings with a position; the selected one is drawn apart."""
    c = F.col
    rows = cards.filter(c("latitude").isNotNull() & c("longitude").isNotNull())
    rows = rows if selected is None else rows.filter(c("listing_id") != selected)
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    fields = F.struct("listing_id", F.col("geocode_precision").isin("neighborhood", "city").alias("approximate"), F.coalesce("price_effective_monthly", "price_monthly").alias("price"))
    return rows.select("listing_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), fields.alias("properties"))).alias("feature"))


def listing_detail(listing_id: str, cards: DataFrame, history: DataFrame, events: DataFrame, groups: DataFrame, most: int = 50) -> DataFrame:
    """One row: a card with its newest events and prices and the other members of its group.

    The id is pushed into every scan; only that listing's rows are joined.
    """
    one = cards.filter(F.col("listing_id") == listing_id)

    def newest(df: DataFrame, at: str, name: str) -> DataFrame:
        mine = df.filter(F.col("listing_id") == listing_id).orderBy(F.col(at).desc()).limit(most)
        return mine.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct(at, *(c for c in df.columns if c not in (at, "listing_id")))), asc=False).alias(name))

    found = one.join(newest(history, "observed_at", "prices"), "listing_id", "left").join(newest(events, "created_at", "events"), "listing_id", "left")
    peers = groups.filter(F.array_contains("member_ids", listing_id)).select(F.lit(listing_id).alias("listing_id"), F.array_remove("member_ids", listing_id).alias("peers"), "confidence", "reasons")
    return found.join(peers, "listing_id", "left")


def verification(batch: DataFrame, by: str) -> DataFrame:
    """Coverage profile, issues and verdict per source of a batch."""
    from hearthlake.operators import quality

    profiled = quality.profile(batch, [by]).withColumn("issues", quality.issues())
    return profiled.withColumn("verdict", quality.verdict(F.col("issues"), F.col("total") == 0))


def result_summaries(results: DataFrame, listings: DataFrame, fields: list[str]) -> DataFrame:
    """Listings that searches returned, in the order of their answers; ids without a listing are left out.

    results (search_id, ids): ids in order, of which a search returns few. ``place`` counts from 0 in the answer.
    """
    ids = results.select("search_id", F.posexplode("ids").alias("place", "listing_id"))
    return ids.join(listings.select("listing_id", *fields), "listing_id")
