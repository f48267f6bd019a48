"""What users write: verdicts and dislikes of listings, saved searches; each as a batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.hashes import record_id
from hearthlake.operators.merge import delete_cascade

# The verdicts that a user may give.
VERDICTS = ["saved", "hidden", "contacted", "not_a_fit", "maybe", "toured", "applied", "rented_elsewhere", "suspicious"]


def verdict_outcomes(requests: DataFrame, listings: DataFrame) -> DataFrame:
    """``requests`` (pos, listing_id, status, note) with ``error``: null where the request is carried out."""
    known = listings.select("listing_id", F.lit(True).alias("__known")).distinct()
    met = requests.join(known, "listing_id", "left")
    wrong = F.when(F.col("__known").isNull(), "listing not found").when(F.col("status").isNotNull() & ~F.col("status").isin(VERDICTS), F.concat(F.lit("invalid status: "), "status"))
    return met.withColumn("error", wrong).drop("__known")


def write_verdicts(states: DataFrame, requests: DataFrame, listings: DataFrame, now: Column) -> DataFrame:
    """States (listing_id, status, note, updated_at) after the requests: the last one of a listing counts, a null status takes its state away.

    Of requests at one position the one with the greater status and note counts, null before all others.
    """
    good = verdict_outcomes(requests, listings).filter("error is null")
    last = good.groupBy("listing_id").agg(F.max(F.struct("pos", "status", "note")).alias("r")).select("listing_id", "r.status", "r.note")
    kept = states.join(last.select("listing_id"), "listing_id", "left_anti")
    return kept.unionByName(last.filter("status is not null").withColumn("updated_at", now).select(*states.columns))


def dislikes_as_verdicts(requests: DataFrame) -> DataFrame:
    """Requests (pos, listing_id, disliked) as verdicts: a dislike is "not a fit", taking it back takes the state away."""
    status = F.when(F.coalesce("disliked", F.lit(True)), "not_a_fit")
    return requests.select("pos", "listing_id", status.alias("status"), F.lit(None).cast("string").alias("note"))


def write_memory(notes: DataFrame, requests: DataFrame, written: DataFrame) -> DataFrame:
    """Notes (listing_id, note) after dislikes (pos, listing_id, disliked); ``written``: the note of each listing."""
    last = requests.groupBy("listing_id").agg(F.max(F.struct("pos", F.coalesce("disliked", F.lit(True)).alias("disliked"))).alias("r")).select("listing_id", "r.disliked")
    kept = notes.join(last.select("listing_id"), "listing_id", "left_anti")
    return kept.unionByName(last.filter("disliked").join(written, "listing_id").select(*notes.columns))


def new_searches(requests: DataFrame, now: Column) -> DataFrame:
    """Saved searches of requests (pos, owner, query, name, has_criteria), with ``error`` where there is nothing to search for."""
    query, name = F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce("name", F.lit("")))
    wrong = F.when((query == "") & ~F.coalesce("has_criteria", F.lit(False)), "a query or criteria is required")
    title = F.coalesce(F.nullif(name, F.lit("")), F.nullif(query, F.lit("")), F.lit("Saved search"))
    return requests.select(record_id("srch", F.col("owner"), F.col("pos").cast("string")).alias("search_id"), "pos", title.alias("name"), F.nullif(query, F.lit("")).alias("query"), F.lit(True).alias("enabled"), now.alias("created_at"), now.alias("updated_at"), wrong.alias("error"))


def delete_searches(searches: DataFrame, matches: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches and their matches without the search ids in ``gone``."""
    return delete_cascade(searches, matches, gone, "search_id", "search_id")
