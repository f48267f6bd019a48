"""Baseline prices and rule-based risk levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.scalars import compact, matches, plain_number, round_half_up
from hearthlake.operators.quantiles import exact_medians

# Monthly rent by bedrooms (four stands for more) where there are too few prices.
CITY_RENT = {0: 2200, 1: 3100, 2: 4300, 3: 5700, 4: 6900}
LOW_SHARE = 0.55
# Wordings that call for care.
OFF_PLATFORM = r"(?i)\b(wire transfer|western union|moneygram|cashier'?s? check|money order first|zelle|venmo|cash ?app|bitcoin|crypto)\b"
PAY_FIRST = r"(?i)\b(deposit|payment|fee|money)\b[^.!\n]{0,60}\b(before|prior to|without)\b[^.!\n]{0,40}\b(viewing|tour|seeing|showing|visit)"
OWNER_AWAY = r"(?i)\b(out of (the )?(country|state|town)|currently (abroad|overseas|traveling)|missionary|on a mission|military deployment|deployed overseas)\b"
URGENCY = r"(?i)\b(act (fast|now|quickly)|first come,? first serve[d]?|won'?t last|send (the )?(deposit|money) (today|now|asap))\b"
SPAMMY = r"([^a-zA-Z0-9\s])\1{4,}|!{3,}|\${3,}"


def baselines(listings: DataFrame, area: str = "neighborhood", beds: str = "bedrooms", price: str = "price", least: int = 8) -> DataFrame:
    """Median price by area and bedrooms, and by bedrooms alone (area null), of groups with enough prices.

    Both levels come from the same counts; rows without an area only count in the second one.
    """
    known = listings.filter(F.col(price).isNotNull() & F.col(beds).isNotNull()).select(F.coalesce(F.nullif(F.col(area), F.lit("")), F.lit("")).alias("area"), F.col(beds).alias("beds"), F.col(price).cast("double").alias("value"))
    counted = known.groupBy("area", "beds", "value").agg(F.count(F.lit(1)).alias("n"))
    # Each count goes into its area's group, if it has one, and into that of all areas.
    levels = F.when(F.col("area") == "", F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    both = counted.withColumn("city", F.explode(levels)).withColumn("area", F.when(F.col("city"), "").otherwise(F.col("area")))
    found = exact_medians(both, ["city", "area", "beds"])
    return found.filter(F.col("n") >= least).select(F.when(~F.col("city"), F.col("area")).alias("area"), "beds", F.col("median").alias("median_price"), "n")


def with_baseline(listings: DataFrame, medians: DataFrame, area: str = "neighborhood", beds: str = "bedrooms") -> DataFrame:
    """``listings`` with ``baseline``: by area, else by bedrooms, else the fixed city rent."""
    local = medians.filter("area is not null").select(F.col("area").alias("__a"), F.col("beds").alias("__b"), F.col("median_price").alias("__local"))
    city = medians.filter("area is null").select(F.col("beds").alias("__c"), F.col("median_price").alias("__city"))
    joined = listings.join(local, (listings[area] == F.col("__a")) & (listings[beds] == F.col("__b")), "left").join(city, listings[beds] == F.col("__c"), "left")
    fixed = F.create_map(*(F.lit(x) for k, v in CITY_RENT.items() for x in (k, float(v))))
    rent = F.try_element_at(fixed, F.least(F.floor(listings[beds] + 0.5).cast("int"), F.lit(max(CITY_RENT))))
    return joined.select(*listings.columns, F.when(listings[beds].isNotNull(), F.coalesce("__local", "__city", rent)).alias("baseline"))


def assess(title: Column, description: Column, price: Column, square_feet: Column, bedrooms: Column, neighborhood: Column, address: Column, latitude: Column, photo_count: Column, baseline: Column, shared_description: Column, price_mismatch: Column) -> Column:
    """Struct of level (none, watch, verify_carefully) and warnings, strong ones first."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    usd = lambda c: F.concat(F.lit("$"), plain_number(c))
    where = F.when(neighborhood != "", F.concat(F.lit(" in "), neighborhood)).otherwise(" citywide")
    far_below = F.concat(F.lit("price_far_below_baseline: "), usd(price), F.lit("/mo vs ~"), usd(round_half_up(baseline)), F.lit(" typical for "), plain_number(bedrooms), F.lit("BR"), where)
    combo = F.concat(F.lit("too_good_size_price_combo: "), plain_number(square_feet), F.lit(" sqft for "), usd(price), F.lit("/mo"))
    strong = compact(
        F.when(price < baseline * F.lit(LOW_SHARE), far_below),
        F.when((square_feet >= 1200) & (price < 2200), combo),
        F.when(matches(text, OFF_PLATFORM), "suspicious_payment_language: mentions wire/app-based payment"),
        F.when(matches(text, PAY_FIRST), "payment_before_viewing_language"),
        F.when(matches(text, OWNER_AWAY), "owner_unavailable_language: classic remote-landlord pattern"),
        F.when(flag(shared_description), "duplicate_description_across_neighborhoods"),
    )
    weak = compact(
        F.when(matches(text, URGENCY), "urgency_pressure_language"),
        F.when(flag(price_mismatch), "inconsistent_card_detail_price"),
        F.when((F.coalesce(address, F.lit("")) == "") & latitude.isNull() & (F.coalesce(neighborhood, F.lit("")) == ""), "no_location_information"),
        F.when(photo_count == 0, "no_photos"),
        F.when(F.coalesce(title.rlike(SPAMMY), F.lit(False)), "spammy_title_symbols"),
    )
    level = F.when((F.size(strong) > 0) | (F.size(weak) >= 2), "verify_carefully").when(F.size(weak) == 1, "watch").otherwise("none")
    return F.struct(level.alias("level"), F.concat(strong, weak).alias("warnings"))


def price_mismatch(card_price: Column, detail_price: Column, detail_fetched: Column) -> Column:
    """Whether card and detail prices of a fetched detail page lie more than a quarter apart."""
    return F.coalesce(detail_fetched & (F.abs(card_price - detail_price) > 0.25 * detail_price), F.lit(False))
