"""Free-text search for many searches at once: candidates, pre-ranking, a ranker's answers, what is accepted.

Candidates of a search are live listings in its radius, nearest first, those without a
position behind them, or, without a centre, the newest ones; ``CANDIDATES`` of
them. Searches and listings meet on map cells whose size follows the radius, so
a search names some dozens of cells and a listing one a size.

Pre-ranking keeps the ``RANKED`` candidates whose text contains the most of the
search's words, in place order among equals. The words of all searches are one dictionary
that each text goes through once; what it contains meets the searches by word.
Few candidates and searches without a word keep their order.

Defined results: a search without an id has no candidates; a centre needs a radius;
searches that repeat an id share one list; null texts contain no word; empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.geo import haversine_miles
from hearthlake.operators import dictionary, matching
from hearthlake.operators.preference import SEARCH_FILLERS
from hearthlake.session import materialize

CANDIDATES, RANKED = 5000, 24
#: Degrees of the smallest cells, each size the double of the one before; sizes; miles of a degree of latitude (a little short).
CELL, SIZES, MILES = 0.05, 6, 68.7


def words(query: Column) -> Column:
    """Distinct words of a search of three letters or more, without fillers, in order."""
    split = F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(split, lambda w: (F.length(w) > 2) & ~w.isin(SEARCH_FILLERS)))


def _in_radius(searches: DataFrame, listings: DataFrame) -> DataFrame:
    """Pairs (search_id, listing_id, first_seen_at, distance_mi) within the radius, hidden listings only where asked for."""
    reach = F.col("radius_miles") / MILES
    # The size whose cell is at least a quarter of the radius, or the largest.
    size = F.least(F.greatest(F.ceil(F.log2(reach / (4 * CELL))), F.lit(0)), F.lit(SIZES - 1)).cast("int")
    side = F.lit(CELL) * F.pow(F.lit(2.0), F.col("size"))
    columns = F.round(F.lit(360.0) / side).cast("long")
    near_pole = F.abs("center_lat") + reach >= 89.0
    wide = F.when(near_pole, F.lit(180.0)).otherwise(F.least(reach / F.cos(F.radians(F.abs("center_lat") + reach)), F.lit(180.0)))
    cell = lambda c: F.floor(c / side)
    asked = searches.withColumn("size", size)
    rows = F.sequence(cell(F.col("center_lat") - reach), cell(F.col("center_lat") + reach))
    cols = F.array_distinct(F.transform(F.sequence(cell(F.col("center_lng") - wide), cell(F.col("center_lng") + wide)), lambda x: F.pmod(x, columns)))
    asked = asked.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(cols))
    used = sorted(r[0] for r in searches.select(size.alias("size")).distinct().collect())  # SIZES at most
    if not used:
        return listings.select("listing_id", "first_seen_at").limit(0).withColumns({"search_id": F.lit(None).cast(searches.schema["search_id"].dataType), "distance_mi": F.lit(None).cast("double")})
    placed = listings.filter("latitude is not null and longitude is not null").withColumn("size", F.explode(F.array(*map(F.lit, used))))
    placed = placed.withColumns({"cy": cell(F.col("latitude")), "cx": F.pmod(cell(F.col("longitude")), columns)})
    met = placed.join(asked, ["size", "cx", "cy"]).filter(F.col("include_hidden") | F.col("live"))
    met = met.withColumn("distance_mi", haversine_miles(F.col("center_lat"), F.col("center_lng"), F.col("latitude"), F.col("longitude")))
    return met.filter(F.col("distance_mi") <= F.col("radius_miles")).select("search_id", "listing_id", "first_seen_at", "distance_mi")


def candidates(searches: DataFrame, listings: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """Rows (search_id, listing_id, place, distance_mi), place from 1 to ``cap``.

    searches (search_id, query, center_lat, center_lng, radius_miles, include_hidden); listings with the columns of cards.
    """
    c = F.col
    asked = searches.filter("search_id is not null").groupBy("search_id").agg(F.first(F.struct("center_lat", "center_lng", "radius_miles", F.coalesce("include_hidden", F.lit(False)).alias("include_hidden"))).alias("s")).select("search_id", "s.*")
    asked = materialize(asked)
    priced = F.coalesce(c("price_effective_monthly"), c("price_monthly")).isNotNull()
    live = F.coalesce(matching.live(c("listing_status"), c("stale_status"), c("price_monthly"), c("price_effective_monthly"), c("user_status")), F.lit(False))
    open_ = materialize(listings.filter(priced).select("listing_id", "first_seen_at", "latitude", "longitude", live.alias("live")))
    centred = c("center_lat").isNotNull() & c("center_lng").isNotNull() & c("radius_miles").isNotNull()
    near = _in_radius(asked.filter(centred), open_)

    def newest(rows: DataFrame, hidden: bool) -> DataFrame:
        shown = rows if hidden else rows.filter("live")
        return shown.orderBy(c("first_seen_at").desc(), "listing_id").limit(cap).select(F.lit(hidden).alias("include_hidden"), "listing_id", "first_seen_at")

    def shared(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """The newest of the rows, ``cap`` at most, for each search that wants them."""
        pool = newest(rows, False).unionByName(newest(rows, True))
        return wanted.select("search_id", "include_hidden").join(F.broadcast(pool), "include_hidden").select("search_id", "listing_id", "first_seen_at", F.lit(None).cast("double").alias("distance_mi"))

    unplaced = open_.filter("latitude is null or longitude is null")
    met = near.unionByName(shared(unplaced, asked.filter(centred))).unionByName(shared(open_, asked.filter(~centred)))
    order = Window.partitionBy("search_id").orderBy(F.asc_nulls_last("distance_mi"), c("first_seen_at").desc(), "listing_id")
    return met.withColumn("place", F.row_number().over(order)).filter(c("place") <= cap).select("search_id", "listing_id", "place", "distance_mi")


def prerank(found: DataFrame, texts: DataFrame, searches: DataFrame, cap: int = RANKED) -> DataFrame:
    """The ``cap`` best of the candidates of each search: found (search_id, listing_id, place), texts (listing_id, text in lower case)."""
    asked = searches.filter("search_id is not null").select("search_id", F.explode(words(F.col("query"))).alias("key")).distinct().withColumn("entry", F.xxhash64("key"))
    found = materialize(found)
    read = texts.join(found.select("listing_id").distinct(), "listing_id", "left_semi").dropDuplicates(["listing_id"])
    contains = dictionary.contained_pairs(read.select("listing_id", "text"), F.col("text"), asked.select("entry", "key").distinct()).select("listing_id", "entry")
    hits = found.select("search_id", "listing_id").join(contains, "listing_id").join(asked.select("search_id", "entry"), ["search_id", "entry"]).groupBy("search_id", "listing_id").agg(F.count(F.lit(1)).alias("hits"))
    many = found.groupBy("search_id").agg((F.count(F.lit(1)) > cap).alias("many"))
    scored = found.join(hits, ["search_id", "listing_id"], "left").join(many, "search_id")
    scored = scored.withColumn("hits", F.when(F.col("many"), F.coalesce("hits", F.lit(0))).otherwise(0).cast("int"))
    order = Window.partitionBy("search_id").orderBy(F.desc("hits"), "place")
    return scored.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= cap).drop("many")


def accepted(replies: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Answers (search_id, listing_id, score) about listings that the search was given: score within 0..100, ``rank`` from the best on."""
    # Answers may be many more than their source's size lets a planner expect, so neither side is broadcast by estimate.
    known = replies.hint("merge").join(shortlist.select("search_id", "listing_id", "hits", "place"), ["search_id", "listing_id"])
    known = known.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score"))))
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("score"), "listing_id")))


def search_view(searches: DataFrame, listings: DataFrame, replies: DataFrame, cap: int = CANDIDATES, ranked: int = RANKED) -> DataFrame:
    """Accepted answers of all searches: (search_id, listing_id, score, hits, place, rank)."""
    texts = listings.select("listing_id", F.lower(F.concat_ws(" ", "title", "neighborhood", "description")).alias("text"))
    shortlist = prerank(candidates(searches, listings, cap), texts, searches, ranked)
    return accepted(replies.select("search_id", "listing_id", "score"), shortlist)
