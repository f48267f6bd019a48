"""JSON feeds as typed rows: schemas are given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.functions.listing_text import bedrooms_from_unit_type, parse_price, sentinel_to_null, split_amenities
from hearthlake.functions.scalars import group

APARTMENTS = "struct<properties:array<struct<propertyId:string,name:string,address:string,city:string,phone:string>>,apartments:array<struct<apartmentId:string,propertyId:string,unit:string,rent:string,beds:string,baths:string,sqft:string,amenities:string,available:string>>>"
FLOORPLANS = "array<map<string,string>>"
UNITS = "struct<id:string,name:string,general:array<struct<unitType:string,rent:string,count:int>>,reserved:array<struct<unitType:string,rent:string,count:int>>>"
POSTS = "array<struct<id:long,link:string,title:struct<rendered:string>,content:struct<rendered:string>>>"


def apartments(feeds: DataFrame, payload: str = "payload", city: str | None = None) -> DataFrame:
    """Apartments with their property; a missing property leaves its fields null."""
    parsed = feeds.select(F.from_json(payload, APARTMENTS).alias("d"))
    flats = parsed.select(F.explode("d.apartments").alias("a")).select("a.*")
    homes = parsed.select(F.explode("d.properties").alias("p")).select("p.*").dropDuplicates(["propertyId"])
    met = flats.join(homes, "propertyId", "left")
    out = met.select(
        F.col("apartmentId").alias("source_listing_id"), F.col("name").alias("property_name"), F.col("address").alias("address_raw"), "city", F.col("unit").alias("unit_number_public"),
        parse_price(F.col("rent")).alias("price_monthly"), F.col("beds").try_cast("double").alias("bedrooms"), F.col("baths").try_cast("double").alias("bathrooms"),
        F.col("sqft").try_cast("int").alias("square_feet"), split_amenities(F.col("amenities")).alias("amenities_raw"), F.col("phone").alias("contact_phone"),
    )
    return out if city is None else out.filter(F.lower("city") == city.lower())


def floorplans(pages: DataFrame, blob: Column, page_col: str = "page_id") -> DataFrame:
    """Floor plans from a JSON array of maps; words for nothing are null, the first of an id wins."""
    rows = pages.select(page_col, F.posexplode(F.from_json(blob, FLOORPLANS)).alias("pos", "m"))
    value = lambda *names: F.coalesce(*(sentinel_to_null(F.try_element_at("m", F.lit(n))) for n in names))
    out = rows.select(
        page_col, "pos", value("id", "floorplanId").alias("source_listing_id"), value("name", "floorplanName").alias("title"), parse_price(value("minRent", "rent")).alias("price_monthly"),
        value("beds").try_cast("double").alias("bedrooms"), value("baths").try_cast("double").alias("bathrooms"), value("sqft", "minSqft").try_cast("int").alias("square_feet"),
        value("available").try_cast("int").alias("available_units"),
    )
    first = Window.partitionBy("source_listing_id").orderBy(page_col, "pos")
    return out.filter("source_listing_id is not null").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def unit_types(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per listing and unit type; of several the first one, general before reserved."""
    parsed = feeds.select(F.from_json(payload, UNITS).alias("d"))
    empty = F.array().cast("array<struct<unitType:string,rent:string,count:int>>")
    rows = parsed.select("d.id", "d.name", F.posexplode(F.concat(F.coalesce("d.general", empty), F.coalesce("d.reserved", empty))).alias("pos", "u"))
    first = Window.partitionBy("id", "u.unitType").orderBy("pos")
    kept = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return kept.select(F.concat_ws("-", "id", "u.unitType").alias("source_listing_id"), F.col("name").alias("title"), bedrooms_from_unit_type(F.col("u.unitType")).alias("bedrooms"), parse_price(F.col("u.rent")).alias("price_monthly"), F.col("u.count").alias("units"))


def posts(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """Posts of a content system, with facts from their prose."""
    from hearthlake.functions.listing_text import html_to_text, parse_bathrooms, parse_bedrooms, parse_square_feet

    rows = feeds.select(F.explode(F.from_json(payload, POSTS)).alias("p"))
    rows = rows.select("p", html_to_text(F.col("p.content.rendered")).alias("text"))  # once for all that is read from it
    prose = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("p.id").cast("string").alias("source_listing_id"), F.col("p.link").alias("original_url"), html_to_text(F.col("p.title.rendered")).alias("title"), F.col("text").alias("description"),
        parse_price(group(prose, r"(\$\s*[\d,]+)")).alias("price_monthly"), parse_bedrooms(prose).alias("bedrooms"), parse_bathrooms(prose).alias("bathrooms"), parse_square_feet(prose).alias("square_feet"),
    )


def json_from_prose(text: Column) -> Column:
    """The JSON object in an answer: a fenced block, else from the first to the last brace."""
    fenced = group(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
    return F.coalesce(fenced, group(text, r"(?s)(\{.*\})", 0))


def validated(text: Column, schema: str, required: list[str], enums: dict[str, list[str]] | None = None) -> Column:
    """The parsed answer, null unless all required fields are there and enumerated ones have a known value."""
    parsed = F.from_json(json_from_prose(text), schema)
    ok = parsed.isNotNull()
    for name in required:
        ok = ok & parsed[name].isNotNull()
    for name, values in (enums or {}).items():
        ok = ok & parsed[name].isin(values)
    return F.when(ok, parsed)


def image_urls(primary: Column, photos: Column, n: int = 6) -> Column:
    """The first n distinct http URLs, the primary one in front."""
    everything = F.concat(F.array(primary), F.coalesce(photos, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(everything, lambda u: F.coalesce(u.startswith("http"), F.lit(False)))), 1, n)


def attribute_lines(attributes: Column, hidden: list[str]) -> Column:
    """``key: value`` of a map but for some keys, by key."""
    return F.array_sort(F.transform(F.map_entries(F.map_filter(attributes, lambda k, v: ~k.isin(hidden))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
