"""Characteristic tags of listings, and texts for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.hashes import slug
from hearthlake.functions.scalars import compact, matches, round_half_up

# Floorings and the words that show them.
FLOORING = {
    "carpet": r"\bcarpet(ed|ing)?\b",
    "hardwood": r"\bhardwood\b",
    "laminate": r"\blaminate\b",
    "tile": r"\btile(d)?\s+floor",
    "vinyl": r"\bvinyl\b",
}


def price_band(price: Column) -> Column:
    """Thousand-wide band of a positive price."""
    low = F.floor(price / 1000).cast("string")
    high = (F.floor(price / 1000) + 1).cast("string")
    return F.when(price < 1000, F.when(price > 0, "price:under-1k")).otherwise(F.concat(F.lit("price:"), low, F.lit("k-"), high, F.lit("k")))


def characteristic_tags(bedrooms: Column, price: Column, neighborhood: Column, parking: Column, laundry: Column, cats: Column, dogs: Column, square_feet: Column, property_type: Column, visual_tags: Column, description: Column) -> Column:
    """Namespaced tags of what is known about a listing, in a fixed order."""
    named = lambda space, c: F.when((c != "") & (c != "unknown"), F.concat(F.lit(space), slug(c)))
    beds = F.when(bedrooms == 0, "beds:studio").otherwise(F.concat(F.lit("beds:"), round_half_up(bedrooms.cast("double")).cast("long").cast("string")))
    text = F.lower(F.concat(F.array_join(F.coalesce(visual_tags, F.array().cast("array<string>")), " "), F.lit(" "), F.coalesce(description, F.lit(""))))
    kind = F.when(property_type != "", F.concat(F.lit("type:"), slug(property_type)))
    hood = F.when(neighborhood != "", F.concat(F.lit("hood:"), slug(neighborhood)))
    size = F.when(square_feet < 600, "size:compact").when(square_feet > 1200, "size:large")
    pets = F.when(~cats & ~dogs, "pets:none")
    floors = [F.when(matches(text, regex), f"flooring:{name}") for name, regex in FLOORING.items()]
    return F.array_distinct(compact(F.when(bedrooms.isNotNull(), beds), price_band(price), hood, named("parking:", parking), named("laundry:", laundry), pets, kind, size, *floors))


def friendly_tag(tag: Column) -> Column:
    """What a tag is called in a sentence."""
    space, value = F.substring_index(tag, ":", 1), F.regexp_replace(tag, "^[^:]*:?", "")
    words = F.replace(value, F.lit("-"), F.lit(" "))
    return (
        F.when(space == "flooring", F.concat(value, F.lit(" flooring")))
        .when(space.isin("parking", "laundry"), F.when(value == "none", F.concat(F.lit("no "), space)).otherwise(F.concat(words, F.lit(" "), space)))
        .when(space == "pets", "no pets allowed")
        .when(space == "beds", F.when(value == "studio", "studio").otherwise(F.concat(value, F.lit(" bed"))))
        .when(space == "price", F.when(value == "under-1k", "under $1k").otherwise(F.concat(F.lit("$"), F.regexp_replace(value, "-", "–"))))
        .when(space == "hood", F.initcap(words))
        .when(space == "size", F.concat(value, F.lit(" size")))
        .otherwise(words)
    )


def snippet(text: Column, length: int = 220) -> Column:
    """One line, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > length, F.concat(F.left(line, F.lit(length)), F.lit("…"))).otherwise(line)


def money(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(round_half_up(amount.cast("double")), 0))


def short_money(amount: Column) -> Column:
    """Thousands with one digit and a k."""
    tenth = round_half_up(amount / 1000, 1)
    text = F.when(tenth == F.floor(tenth), F.floor(tenth).cast("string")).otherwise(tenth.cast("string"))
    return F.when(amount >= 1000, F.concat(F.lit("$"), text, F.lit("k"))).otherwise(F.concat(F.lit("$"), round_half_up(amount).cast("long").cast("string")))


def age_text(then: Column, now: Column) -> Column:
    """Age in minutes, hours, days or months."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes < 60, F.concat(F.greatest(minutes, F.lit(0)).cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 31, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago")))
    )


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_availability(raw: Column, today: Column) -> Column:
    """Date of "now" or of a month and day, in the year in which it is not more than 45 days past.

    Days beyond the end of a month run on into the next one.
    """
    text = F.lower(raw)
    regex = rf"({'|'.join(MONTHS)})[a-z]*\.?\s+(\d{{1,2}})"
    month, day = F.regexp_extract(text, regex, 1), F.regexp_extract(text, regex, 2).try_cast("int")
    number = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int"), F.lit(0))
    in_year = lambda year: F.date_add(F.make_date(year, number, F.lit(1)), day - 1)
    this = in_year(F.year(today))
    later = F.when(this < F.date_sub(today, 45), in_year(F.year(today) + 1)).otherwise(this)
    return F.when(matches(text, r"\bnow\b"), today).otherwise(later)
