"""Preferences learned from dislikes, relevance ranking, and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.scalars import compact

LEAST_DISLIKES, RECURRING, STRONG = 3, 0.4, 0.6
# Words of a search that say nothing about a candidate.
SEARCH_FILLERS = [
    "the", "and", "with", "within", "near", "for", "from", "into", "onto", "that", "this", "are", "apartment", "apartments", "apt", "min", "mins", "minute", "minutes", "walk", "want", "need",
    "looking", "place", "home", "unit",
]


def aversions(disliked: DataFrame, tags: str = "tags") -> DataFrame:
    """Tags (tag, count, total, strength) that recur among the disliked; none while these are few."""
    total = disliked.agg(F.count(F.lit(1)).alias("total"))
    counts = disliked.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").count()
    met = counts.join(F.broadcast(total), F.lit(True))  # one row
    enough = (F.col("total") >= LEAST_DISLIKES) & (F.col("count") >= F.greatest(F.lit(2), F.ceil(F.col("total") * F.lit(RECURRING))))
    return met.filter(enough).select("tag", "count", "total", (F.col("count") / F.col("total")).alias("strength"))


def curate(matches: DataFrame, found: DataFrame, group: str, position: str, tags: str = "tags") -> DataFrame:
    """``matches`` ranked within their group by how many aversions they share, then by position.

    Those that share a strong one go, unless that would leave nothing of the
    group. The aversions are few by construction (each holds for 40 % of the
    disliked) and travel as one row.
    """
    table = found.agg(F.map_from_entries(F.collect_list(F.struct("tag", "strength"))).alias("__table"))
    met = matches.join(F.broadcast(table), F.lit(True))
    shared = F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.map_contains_key(F.col("__table"), t))
    met = met.withColumn("shared", F.size(shared)).withColumn("strong", F.exists(shared, lambda t: F.element_at(F.col("__table"), t) >= STRONG)).drop("__table")
    all_strong = F.min(F.col("strong").cast("int")).over(Window.partitionBy(group)) == 1
    kept = met.withColumn("__all", all_strong).filter(~F.col("strong") | F.col("__all")).drop("__all")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("shared", position)))


def query_tokens(query: str) -> list[str]:
    """Distinct words of a search of three letters or more, without fillers."""
    import re

    words = re.sub(r"[^a-z0-9\s]", " ", query.lower()).split()
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in SEARCH_FILLERS))


def prerank(candidates: DataFrame, query: str, text: Column, position: str, cap: int = 24) -> DataFrame:
    """The ``cap`` candidates whose text contains the most words of the query; ties and few candidates keep their order."""
    tokens = query_tokens(query)
    hits = sum((F.contains(text, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    few = F.broadcast(candidates.limit(cap + 1).agg((F.count(F.lit(1)) <= cap).alias("__few")))  # one row
    scored = candidates.join(few, F.lit(True)).withColumn("hits", F.when(F.col("__few"), 0).otherwise(hits)).drop("__few")
    return scored.orderBy(F.col("hits").desc(), position).limit(cap)


def candidate_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def accept_ranking(reply: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers of a ranker (id, score, reason): ids it made up go, scores are clamped to 0..100, best first."""
    known = reply.join(candidates.select("id").distinct(), "id", "left_semi")
    return known.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score")))).orderBy(F.col("score").desc(), "id")


def sort_by_price(df: DataFrame, effective: str, price: str, id_col: str, descending: bool = False) -> DataFrame:
    """By price; a listing without one counts as dearest."""
    key = F.coalesce(F.col(effective), F.col(price), F.lit(9007199254740991.0))
    return df.orderBy(key.desc() if descending else key.asc(), id_col)


def badges(verdict: Column, risk: Column, stale: Column, old_price: Column, new_price: Column, changed_at: Column, first_seen: Column, new_since: Column, group: Column, last_run: Column, now: Column) -> Column:
    """Ordered array of badges; the first one colours the marker."""
    recent = changed_at > now - F.expr("INTERVAL 14 DAYS")
    own = F.when(verdict.isin("saved", "contacted", "maybe", "toured", "applied", "suspicious"), verdict)
    return compact(
        own, F.when(risk.isin("verify_carefully", "watch"), risk), F.when(stale == "likely_unavailable", "likely_unavailable").when(stale.isin("missing_once", "missing_multiple_runs"), "stale"),
        F.when(recent, F.when(new_price < old_price, "price_drop").otherwise("price_increase")), F.when(new_since.isNull() | (first_seen > new_since), "new_today"),
        F.when(F.coalesce(group, F.lit("")) != "", "duplicate"), F.when(last_run.isin("failed", "partial"), "source_uncertain"),
    )


def contact(own: dict[str, Column], inherited: dict[str, Column]) -> Column:
    """Struct of contact fields, each the listing's own or its source's, and whether all are inherited."""
    fields = [F.coalesce(own[k], inherited[k]).alias(k) for k in own]
    none = F.coalesce(*own.values()).isNull() & F.coalesce(*inherited.values()).isNotNull()
    return F.struct(*fields, none.alias("inherited"))


def application_draft(email: Column, phone: Column, title: Column, address: Column, applicant: str, signature: str) -> Column:
    """Struct of channel, recipient, subject and body; the applicant's details are parameters."""
    place = F.coalesce(address, title, F.lit("your listing"))
    channel = F.when(email.isNotNull(), "email").when(phone.isNotNull(), "phone").otherwise("unknown")
    body = F.concat(F.lit("Hello,\n\nI am interested in "), place, F.lit(f". {applicant}\n\n{signature}"))
    return F.struct(channel.alias("channel"), F.coalesce(email, phone).alias("recipient"), F.concat(F.lit("Application: "), place).alias("subject"), body.alias("body"))
