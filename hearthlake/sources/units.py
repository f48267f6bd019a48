"""Paginated result pages of units, the coordinates embedded in them, and the pages of single units.

Only elements are found by the HTML tokenizer, in Arrow batches; what their texts
mean is Column work. Null and empty pages give no cards and no coordinates, and a
unit page of theirs gives one row of nulls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.functions.listing_text import info_parts, parse_bathrooms, parse_bedrooms, parse_price
from hearthlake.functions.scalars import blank_to_null, group, matches
from hearthlake.sources.pages import Elements, _clean

RAW_CARD = "page_id long, pos int, post_id string, href string, heading string, area_raw string, info_raw string, style string, dogs boolean, cats boolean"
RAW_UNIT = "page_id long, body string, description string, amenities array<string>, gallery array<string>, html string"
# Names of classes and fields in the pages.
CARD_CLASS, COVER_CLASS, INFO_CLASS, TEXT_CLASS, AMENITY_CLASS = "searchListingContainer", "imageCover", "apartment-info", "apt-description", "apt-amenities"
MARKERS, MARKER = r"(?s)markers\s*=\s*\[(.*?)\];", r'\[\s*"((?:[^"\\]|\\.)*)"\s*,\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)'
QUOTED_URL, BARE_URL = r"url\(\s*['\"]([^'\"]+)['\"]", r"url\(([^)]+)\)"
AVAILABLE = r"(?i)available\s*(?:on|date)?:?\s*(now|\d{1,2}/\d{1,2}/\d{2,4}|[a-z]{3,9}\.?\s+\d{1,2})"


def _cards(text: str) -> list[tuple]:
    page = Elements(text)
    out = []
    for card in page.by_class(CARD_CLASS):
        post = card["attrs"].get("id", "")
        own = page.inside(card)
        classes = [(x, set(x["attrs"].get("class", "").split())) for x in own]
        href = next((x["attrs"]["href"] for x in own if x["tag"] == "a" and x["attrs"].get("href")), None)
        if not post.startswith("post-") or post == "post-" or not href:
            continue
        first = lambda tag, own=own: next((_clean(x["text"]) for x in own if x["tag"] == tag), None)
        info = next((_clean(x["text"]) for x, c in classes if INFO_CLASS in c), None)
        style = next((x["attrs"].get("style") for x, c in classes if COVER_CLASS in c), None)
        icons = [c for x, c in classes if x["tag"] == "li"]
        out.append((len(out), post[5:], href, first("h2"), first("h3"), info, style, any("dog" in c for c in icons), any("cat" in c for c in icons)))
    return out


def _unit(text: str) -> tuple:
    page = Elements(text)
    part = next((x for tag in ("main", "body") for x in page.found if x["tag"] == tag and x["text"].strip()), None)
    told = next((_clean(x["text"]) for x in page.by_class(TEXT_CLASS)), None)
    items = [_clean(x["text"]) for box in page.by_class(AMENITY_CLASS) for x in page.inside(box) if x["tag"] == "li"]
    shown = []
    for box in page.found:
        if re.search("[Cc]arousel|[Gg]allery", box["attrs"].get("class", "")):
            for x in page.inside(box):
                style = x["attrs"].get("style", "")
                found = re.search(QUOTED_URL, style) or re.search(BARE_URL, style)
                shown += [x["attrs"].get("src") if x["tag"] == "img" else None, found[1] if found else None]
    return part["text"] if part else None, told, list(dict.fromkeys(x for x in items if x)), [x.strip().strip("'\"") for x in shown if x]


def place_key(address: Column) -> Column:
    """An address as cards and coordinates are matched by it."""
    return F.trim(F.regexp_replace(F.lower(address), "[^a-z0-9]+", " "))


def info_fields(raw: Column) -> dict[str, Column]:
    """Texts of bedrooms, bathrooms and price in an info line: of each kind the first part."""
    parts = info_parts(raw)
    beds, baths, price = (lambda p: matches(F.lower(p), "studio|bed")), (lambda p: F.lower(p).contains("bath")), (lambda p: p.contains("$"))
    first = lambda keep: F.try_element_at(F.filter(parts, keep), F.lit(1))
    return {"beds_raw": first(beds), "baths_raw": first(lambda p: baths(p) & ~beds(p)), "price_raw": first(lambda p: price(p) & ~beds(p) & ~baths(p))}


def result_cards(pages: DataFrame, base_url: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cards of all result pages, one row per card."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, *card) for i, t in zip(rows[id_col], rows[html_col], strict=True) for card in _cards(t if isinstance(t, str) else "")]
            yield pd.DataFrame(out, columns=["page_id", "pos", "post_id", "href", "heading", "area_raw", "info_raw", "style", "dogs", "cats"])

    raw = pages.select(id_col, html_col).mapInPandas(run, RAW_CARD)
    numbered = r"^(.*?)\s*#\s*(\S+)$"
    background = r"background-image\s*:\s*"
    fields = info_fields(F.col("info_raw"))
    return raw.select(
        "page_id", "pos", F.col("post_id").alias("source_listing_id"), F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base_url), "href")).alias("original_url"),
        F.coalesce(group(F.col("heading"), numbered), "heading").alias("address_raw"), group(F.col("heading"), numbered, 2).alias("unit_number_public"), "area_raw",
        *(c.alias(n) for n, c in fields.items()), parse_price(fields["price_raw"]).alias("price_monthly"), parse_bedrooms(fields["beds_raw"]).alias("bedrooms"), parse_bathrooms(fields["baths_raw"]).alias("bathrooms"),
        F.coalesce(group(F.col("style"), background + QUOTED_URL), group(F.col("style"), background + BARE_URL)).alias("primary_photo_url"),
        F.when(F.col("dogs"), True).alias("dogs_allowed"), F.when(F.col("cats"), True).alias("cats_allowed"),
    )


def markers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Coordinates by place key; of several for one key the last one, by page and position."""
    entries = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.regexp_extract_all(group(F.col(html_col), MARKERS), F.lit(MARKER), F.lit(0))).alias("pos", "entry"))
    entry = F.col("entry")
    named = entries.select(
        place_key(F.regexp_replace(group(entry, MARKER), r"\\(['\"])", "$1")).alias("place_key"), F.struct("page_id", "pos").alias("at"),
        F.struct(group(entry, MARKER, 2).cast("double").alias("latitude"), group(entry, MARKER, 3).cast("double").alias("longitude")).alias("spot"),
    )
    return named.groupBy("place_key").agg(F.max_by("spot", "at").alias("spot")).select("place_key", "spot.*")


def page_numbers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Which page each one is, of how many, by its hidden fields."""

    def hidden(name: str) -> Column:
        return group(group(F.col(html_col), rf"(<input[^>]*\bname=[\"']?{name}\b[^>]*>)"), r"\bvalue=[\"']?([^\"'\s>]+)").try_cast("int").alias(name)

    return pages.select(id_col, hidden("current_page"), hidden("last_page"))


def unit_listings(pages: DataFrame, base_url: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Cards with the coordinates of their building, where a page names them."""
    cards = result_cards(pages, base_url, id_col, html_col).withColumn("place_key", place_key(F.col("address_raw")))
    met = cards.join(markers(pages, id_col, html_col), "place_key", "left")
    return met.withColumn("geocode_precision", F.when(F.col("latitude").isNotNull(), "building")).drop("place_key")


def unit_details(pages: DataFrame, photos_from: str, id_col: str = "page_id", html_col: str = "html", photos: int = 20) -> DataFrame:
    """Fields of unit pages, one row per page; photos are those under the address ``photos_from``, of the gallery or else of the whole page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, *_unit(t if isinstance(t, str) else ""), t) for i, t in zip(rows[id_col], rows[html_col], strict=True)]
            yield pd.DataFrame(out, columns=["page_id", "body", "description", "amenities", "gallery", "html"])

    raw = pages.select(id_col, html_col).mapInPandas(run, RAW_UNIT)
    ours = lambda urls: F.array_distinct(F.filter(urls, lambda u: F.lower(u).startswith(photos_from.lower())))
    anywhere = ours(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"https?://[^\s\"'<>]+"), F.lit(0)))
    gallery = ours(F.col("gallery"))
    return raw.select(
        "page_id", F.concat(group(F.col("body"), r"(?i)([\d,]{2,6})\s*sq(?:\.?\s*ft|ft)"), F.lit(" sqft")).alias("square_feet_raw"), blank_to_null(F.col("description")).alias("description"), "amenities",
        F.when(F.size(gallery) > 0, gallery).otherwise(F.slice(anywhere, 1, photos)).alias("photos"), group(F.col("body"), AVAILABLE).alias("availability_raw"),
        F.concat(F.lit("$"), group(F.col("body"), r"(?i)deposit:?\s*\$?([\d,]+)")).alias("deposit_raw"),
    )
