"""Texts made of rows: lines for a ranker, fact lists, search texts, notes and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.scalars import plain_number, round_half_up
from hearthlake.functions.tags import friendly_tag

NO_STRINGS = "array<string>"


def _joined(items: Column, most: int, sep: str = ", ") -> Column:
    return F.nullif(F.array_join(F.slice(F.coalesce(items, F.array().cast(NO_STRINGS)), 1, most), sep), F.lit(""))


def _labelled(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(f"{label}: "), value.cast("string")))


def candidate_line(id_col: Column, title: Column, area: Column, beds: Column, price: Column, amenities: Column, features: Column, summary: Column, description: Column) -> Column:
    """One line per candidate with what a ranker needs, each part cut short."""
    return F.concat_ws(
        " | ", id_col, F.left(title, F.lit(90)), area, F.when(beds == 0, "studio").otherwise(F.concat(plain_number(beds), F.lit(" bed"))), F.concat(F.lit("$"), plain_number(price)),
        _joined(amenities, 5), _joined(features, 6), F.left(summary, F.lit(90)), F.left(description, F.lit(80)),
    )


def facts(values: dict[str, Column], description: Column, most: int = 1800) -> Column:
    """Labelled facts, known ones only, and the description up to a length."""
    return F.concat_ws("\n", *(_labelled(k, v) for k, v in values.items()), _labelled("Description", F.left(description, F.lit(most))))


def visual_search_text(features: Column, summary: Column, rooms: Column, condition: Column, notes: Column) -> Column:
    """Lower-case text of what images show; ``rooms``: array of (room, details)."""
    inside = F.array_join(F.transform(F.coalesce(rooms, F.array().cast("array<struct<room:string,details:string>>")), lambda r: F.concat_ws(" ", r["room"], r["details"])), " ")
    text = F.concat_ws(" ", F.array_join(F.coalesce(features, F.array().cast(NO_STRINGS)), " "), summary, inside, condition, notes)
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def dislike_note(title: Column, address: Column, price: Column, beds: Column, area: Column, tags: Column) -> Column:
    """A note on a disliked listing: what it was and which of its traits may matter if they recur."""
    traits = F.array_join(F.transform(tags, friendly_tag), ", ")
    known = F.concat_ws(" · ", F.concat(F.lit("$"), plain_number(round_half_up(price)), F.lit(" a month")), F.when(beds == 0, "studio").otherwise(F.concat(plain_number(round_half_up(beds)), F.lit(" bed"))), area)
    return F.concat_ws("\n", F.concat(F.lit("# Not liked: "), F.coalesce(address, title, F.lit("a listing"))), known, F.concat(F.lit("Traits: "), F.coalesce(F.nullif(traits, F.lit("")), F.lit("none in particular"))), F.lit("A trait counts only if it recurs among several listings."))
