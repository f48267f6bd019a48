"""Reports as rows of text: digests, runs and verifications; a writer keeps each report in a folder of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.scalars import plain_number
from hearthlake.functions.tags import money
from hearthlake.operators import latest
from hearthlake.operators.prefix import running_before

# The headings of a digest's sections, in their order.
SECTIONS = {"new": "New", "price_drop": "Price drops", "dropped_out": "No longer matching"}


def _amount(value: Column) -> Column:
    return F.coalesce(money(value), F.lit("—"))


def digest_item(c: dict[str, Column]) -> Column:
    """Three lines about a listing: price, beds, area, distance, source and what to look out for; its title; its address.

    c: price, effective, beds, area, distance_km, source, title, url, previous, risk, group, stale, unknowns.
    """
    beds = F.when(c["beds"].isNull(), "?bd").when(c["beds"] == 0, "studio").otherwise(F.concat(plain_number(c["beds"]), F.lit("bd")))
    both = c["effective"].isNotNull() & ~c["effective"].eqNullSafe(c["price"])
    price = F.when(both, F.concat(_amount(c["effective"]), F.lit(" eff ("), _amount(c["price"]), F.lit(")"))).otherwise(_amount(c["price"]))
    flags = F.array_compact(
        F.array(
            F.when(c["previous"].isNotNull() & (c["previous"] != 0), F.concat(F.lit("was "), money(c["previous"]))), F.when(c["risk"] == "verify_carefully", "⚠ verify carefully"), F.when(c["group"].isNotNull(), "possible duplicate"),
            F.when(F.startswith(c["stale"], F.lit("missing")), "missing from source"), F.when(F.size(c["unknowns"]) > 0, F.concat(F.lit("verify: "), F.array_join(c["unknowns"], ", "))),
        )
    )
    place = F.concat(F.coalesce(c["area"], F.lit("SF")), F.coalesce(F.concat(F.lit(", "), plain_number(c["distance_km"]), F.lit("km")), F.lit("")))
    head = F.concat(F.lit("- "), F.concat_ws(" · ", price, beds, place, c["source"]), F.when(F.size(flags) > 0, F.concat(F.lit(" — "), F.array_join(flags, "; "))).otherwise(""))
    return F.concat_ws("\n", head, F.concat(F.lit("  "), c["title"]), F.concat(F.lit("  "), c["url"]))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def digest_report(changes: DataFrame, items: DataFrame, searches: DataFrame, live_listings: Column, stamp: Column, most: int = 200) -> DataFrame:
    """A digest as rows (place, search_id, markdown): its head at place 0, then a section for each search by name.

    changes (search_id, listing_id, kind, still_matching), items (listing_id, text),
    searches (search_id, name). A list shows ``most`` listings at most, its
    heading counts all.
    """
    known = changes.join(searches.select("search_id"), "search_id")
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    counts = known.groupBy("search_id").agg(*map(of, SECTIONS), F.count_if("still_matching").alias("matching"))
    shown = latest.top_per_key(known.filter(F.col("kind").isin(*SECTIONS)).join(items, "listing_id", "left"), ["search_id", "kind"], [F.col("listing_id")], most, "turn")
    line = F.struct("turn", F.coalesce("text", F.concat(F.lit("- "), F.col("listing_id").cast("string"))).alias("text"))
    lists = shown.groupBy("search_id").pivot("kind", list(SECTIONS)).agg(F.array_sort(F.collect_list(line))).withColumnsRenamed({k: f"{k}_lines" for k in SECTIONS})
    met = searches.select("search_id", "name").join(counts, "search_id", "left").join(lists, "search_id", "left").fillna(0, [*SECTIONS, "matching"])

    def part(kind: str) -> Column:
        return F.when(F.col(kind) > 0, F.concat(F.lit(f"\n### {SECTIONS[kind]} ("), F.col(kind).cast("string"), F.lit(")\n"), F.array_join(F.transform(f"{kind}_lines", lambda x: x["text"]), "\n")))

    nothing = F.when(sum((F.col(k) for k in SECTIONS), F.lit(0)) == 0, "\n_Nothing new._")
    text = F.concat_ws("\n", F.concat(F.lit("## "), "name"), F.concat(F.lit("_"), _counted(F.col("matching"), "current match", "current matches"), F.lit("_")), *map(part, SECTIONS), nothing)
    total = met.agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in SECTIONS))
    n = {k: F.coalesce(k, F.lit(0)) for k in SECTIONS}
    across = F.concat(_counted(F.col("n"), "saved search", "saved searches"), F.lit(" ("), live_listings.cast("string"), F.lit(" live listings evaluated)."))
    sums = F.concat_ws(", ", _counted(n["new"], "new match", "new matches"), _counted(n["price_drop"], "price drop", "price drops"), F.concat(n["dropped_out"].cast("string"), F.lit(" dropped out")))
    head = F.concat(F.lit("# Digest — "), stamp, F.lit("\n\n"), sums, F.lit(" — across "), across, F.lit("\n\n_Check availability, rent, fees and terms on the original listing; nothing is sent to anyone._"))
    first = total.select(F.lit(0).cast("long").alias("place"), F.lit(None).cast(searches.schema["search_id"].dataType).alias("search_id"), head.alias("markdown"))
    ordered = met.select("search_id", "name", text.alias("markdown"), F.lit(1).alias("one"))
    numbered = running_before(ordered, [], ["name", "search_id"], "one", "before").withColumn("place", F.col("before").cast("long") + 1)
    return first.unionByName(numbered.select("place", "search_id", "markdown"))


def write_report(report: DataFrame, folder: str) -> None:
    """The report as text in the order of its places; a report written again replaces itself."""
    report.coalesce(1).sortWithinPartitions("place").select(F.col("markdown").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(folder)


def run_line(c: dict[str, Column]) -> Column:
    """A line about a run, and one for its error and each warning.

    c: source, status, reason, found, new, changed, unchanged, price_changes, missing, pages, details, pagination, seconds, error, warnings.
    """
    some = lambda name, words: F.when(c[name] > 0, F.concat(c[name].cast("string"), F.lit(f" {words}")))
    number = lambda name, words: F.concat(F.coalesce(c[name], F.lit(0)).cast("string"), F.lit(f" {words}"))
    pages = F.when(c["pagination"], "complete").when(~c["pagination"], "INCOMPLETE").otherwise("unknown")
    parts = F.concat_ws(
        ", ", number("found", "listings found"), number("new", "new"), number("changed", "changed"), number("unchanged", "unchanged"), some("price_changes", "price changes"), some("missing", "newly missing"),
        F.concat(c["pages"].cast("string"), F.lit("p/"), c["details"].cast("string"), F.lit("d")), F.concat(F.lit("pagination "), pages),
    )
    more = F.array_compact(F.array(F.concat(F.lit("    error: "), F.split(c["error"], "\n")[0])))
    warned = F.transform(F.coalesce(c["warnings"], F.array().cast("array<string>")), lambda w: F.concat(F.lit("    warning: "), w))
    ran = F.concat(F.lit("- "), c["source"], F.lit(": "), c["status"], F.lit(", "), parts, F.lit(" ("), c["seconds"].cast("string"), F.lit("s)"))
    return F.when(c["status"] == "skipped", F.concat(F.lit("- "), c["source"], F.lit(": skipped, "), c["reason"])).otherwise(F.array_join(F.concat(F.array(ran), more, warned), "\n"))


def verification_text(source: Column, verdict: Column, total: Column, issues: Column) -> Column:
    """A source's verdict with a line for each issue, errors first as they come."""
    lines = F.transform(issues, lambda i: F.concat(F.lit("  - "), F.regexp_replace(F.regexp_replace(i, "^error:", "ERROR: "), "^warning:", "warning: ")))
    return F.array_join(F.concat(F.array(F.concat(source, F.lit(": "), verdict, F.lit(" ("), total.cast("string"), F.lit(" listings)"))), lines), "\n")
