"""Literal cases of the scalar functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import geo, hashes, listing_text, scalars, tags, urls


def values(spark, fn, items, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x"))).collect()]


CASES = [
    (listing_text.parse_price, {"$2,450 / mo": 2450.0, "3000": 3000.0, "99": None, "$150000": None, "call": None, "1,895.50": 1895.0, None: None}),
    (listing_text.parse_bedrooms, {"Studio apt": 0.0, "2br / 1ba": 2.0, "1.5 bedrooms": 1.5, "13 beds": None, "bright": None, "éstudio": 0.0}),
    (listing_text.parse_bathrooms, {"1Ba": 1.0, "2.5 bathrooms": 2.5, "shared bath": None, "0 ba": None, "bad": None}),
    (listing_text.parse_square_feet, {"650ft2": 650, "1,250 sq. ft.": 1250, "70 sqft": None, "900 square feet": 900, "900 ft²": 900}),
    (listing_text.normalize_laundry, {"w/d in unit": "in_unit", "no laundry on site": "none", "laundry on site": "in_building", "W/D hookups": "hookups", "none": None}),
    (listing_text.normalize_parking, {"attached garage": "garage", "carport": "off_street", "street parking": "street", "no parking": "none", "off-street parking": "off_street", "": None}),
    (listing_text.unit_from_title, {"1520 Gough St - 304": "304", "Sunny! Unit #1081C": "1081C", "North Point #305 - view": "305", "2BR - 1050": None, None: None}),
    (listing_text.address_key, {"1520 Gough Street, #3": "1520 gough st 3", "  ": None, "Av. of Avenue": "ave of ave", None: None}),
    (listing_text.html_to_text, {"<p>a&amp;b</p><br/>c  d": "a&b\n\nc d", "<i></i>": None, None: None, "x&nbsp;y &#39;z&apos;": "x y 'z'"}),
    (listing_text.extract_concessions, {"Now 2 months free rent. Call": "2 months free rent", "move-in special: $500!": "move-in special: $500", "nothing": None}),
    (listing_text.lease_term_months, {"12 month lease": 12, "Month-to-month": 1, "48 months": None, "a year": None}),
    (listing_text.street_ordinals, {"Third Street and ninth ave": "3rd Street and 9th ave", "Thirdly": "Thirdly"}),
    (listing_text.geocode_precision, {"house": "exact_address", "suburb": "neighborhood", "odd": "block"}),
    (listing_text.junk_address, {"(google map)": True, "1 Google St": False}),
    (listing_text.bedrooms_from_unit_type, {"Studio": 0, "SRO": 0, "2 BR": 2, "loft": None}),
    (urls.canonical_url, {
        "HTTPS://WWW.X.com:443//a//b/?utm_source=q&b=2&a=1#top": "https://www.x.com/a/b?a=1&b=2", "http://x.com:8080": "http://x.com:8080/", "ftp://x.com/": None, "nonsense": None,
        "https://x.com/?ref=z": "https://x.com/", "https://x.com/p?flag": "https://x.com/p?flag=",
    }),
    (urls.domain_of, {"https://www.A.com/x": "a.com", "mailto:x": None}),
    (hashes.photo_key, {"https://I.x/abc_600x450.jpg": "https://i.x/abc.jpg", "https://i.x/abc_50x50c.jpg": "https://i.x/abc.jpg"}),
    (hashes.slug, {"  The Mission! ": "the-mission", "A--B": "a-b"}),
    (tags.friendly_tag, {"flooring:carpet": "carpet flooring", "parking:none": "no parking", "parking:off_street": "off_street parking", "beds:2": "2 bed", "price:3k-4k": "$3k–4k", "hood:noe-valley": "Noe Valley", "size:large": "large size"}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_strings(spark, fn, cases):
    assert values(spark, fn, list(cases)) == list(cases.values())


def test_numbers_and_money(spark):
    assert values(spark, scalars.plain_number, [3000.0, 2.5, None, 0.0], "double") == ["3000", "2.5", None, "0"]
    assert values(spark, lambda x: scalars.round_half_up(x, 2), [1.005, 2.675, 0.125], "double") == [1.0, 2.68, 0.13]
    assert values(spark, tags.price_band, [999.0, 0.0, 3450.0, None], "double") == ["price:under-1k", None, "price:3k-4k", None]
    assert values(spark, tags.short_money, [950.0, 2450.0, 3000.0], "double") == ["$950", "$2.5k", "$3k"]
    assert values(spark, lambda x: listing_text.price_per_square_foot(x, F.lit(600)), [3000.0, 0.0, None], "double") == [5.0, None, None]
    assert values(spark, lambda x: listing_text.effective_monthly(F.lit(1200.0), x), ["one month free", "6 weeks free", "13 months free", "none"]) == [1100.0, 1062.0, None, None]


def test_pet_policy(spark):
    got = values(spark, listing_text.parse_pet_policy, ["no pets", "pets ok, no dogs", "cats only", "dogs under 25 lbs", "pet friendly; breed restrictions apply.", "quiet"])
    assert [(g.cats_allowed, g.dogs_allowed, g.dog_restrictions_raw) for g in got] == [(False, False, None), (True, False, None), (True, False, None), (None, True, "dogs under 25 lbs"), (True, True, "breed restrictions apply"), (None, None, None)]


def test_description_hash_ignores_case_and_marks(spark):
    a, b, short = values(spark, hashes.description_hash, ["A lovely, bright FLAT with big windows near the park!", "a lovely bright flat -- with big windows near the park", "short"])
    assert a == b and a and short is None


def test_availability(spark):
    today = datetime.date(2024, 3, 10)
    got = values(spark, lambda x: tags.parse_availability(x, F.lit(today)), ["available now", "jan 5", "Feb 20", "apr 1", "feb 30", "soon"])
    assert got == [today, datetime.date(2025, 1, 5), datetime.date(2024, 2, 20), datetime.date(2024, 4, 1), datetime.date(2024, 3, 1), None]


def test_geometry(spark):
    square = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]], [[[10.0, 10.0], [11.0, 10.0], [11.0, 11.0]]]]
    df = spark.createDataFrame([(3.0, 3.0), (1.5, 1.5), (10.8, 10.2), (9.0, 9.0)], "x double, y double").withColumn("c", F.lit(None).cast("array<array<array<array<double>>>>"))
    shape = spark.createDataFrame([(square,)], "c array<array<array<array<double>>>>")
    got = df.drop("c").crossJoin(shape).select("x", geo.in_multipolygon(F.col("x"), F.col("y"), F.col("c"))).collect()
    assert dict(map(tuple, got)) == {3.0: True, 1.5: False, 10.8: True, 9.0: False}
    row = shape.select(geo.bounds(F.col("c")).alias("b"), geo.ring_area(F.col("c")[0][0]).alias("a"), geo.ring_centroid(F.col("c")[0][0]).alias("m")).first()
    assert tuple(row.b) == (0.0, 0.0, 11.0, 11.0) and row.a == 16.0 and row.m == [2.0, 2.0]
    km = spark.range(1).select(geo.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.lit(37.8044), F.lit(-122.2712)).alias("k"), geo.haversine_miles(F.lit(37.7749), F.lit(-122.4194), F.lit(37.8044), F.lit(-122.2712)).alias("m")).first()
    assert abs(km.k - 13.43) < 0.05 and abs(km.m - km.k * 0.621371) < 1e-6


def test_policies_search_each_wording_once_and_only_where_a_fragment_occurs(spark):
    text = F.col("text")
    rows = spark.createDataFrame([("quiet",)], "text string").select(listing_text.parse_pet_policy(text).alias("p"), listing_text.normalize_laundry(text).alias("l"), listing_text.normalize_parking(text).alias("k"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 15 and plan.count("lower(") == 3


def test_fragments_are_in_every_wording_that_matches(spark):
    said = ["no pets", "pets: not allowed", "petnot allowed", "pet-free", "pet free"], ["pet ok", "pets are welcome", "pet are okay", "pets friendly", "pet friendly", "pet-friendly", "pets allowed"]
    for texts, cats in zip(said, (False, True), strict=True):
        assert [x.cats_allowed for x in values(spark, listing_text.parse_pet_policy, texts)] == [cats] * len(texts)
    assert [x.dogs_allowed for x in values(spark, listing_text.parse_pet_policy, ["dog are ok", "dogs welcome", "dog-friendly", "dog friendly", "dogs okay", "hotdogs okay", "dogs okays"])] == [True] * 5 + [None] * 2
    assert [x.cats_allowed for x in values(spark, listing_text.parse_pet_policy, ["cat are ok", "Cats welcome", "cat-friendly", "cat friendly", "cat only", "education only", None])] == [True] * 5 + [None] * 2
    limits = ["small dog", "small dogs only under 20 lb", "dog under 9lbs", "dogs under 10 lb", "one dog max", "breed restriction: large, or so"]
    assert [x.dog_restrictions_raw for x in values(spark, listing_text.parse_pet_policy, limits)] == [*limits[:5], "breed restriction: large"]
    laundry = ["w/d in unit", "washer/dryer in unit", "washer dryer in unit", "in-unit washer", "in unit laundry", "laundry in unit", "laundry in bldg", "laundry on-site", "laundry room", "coin op", "washer / dryer hookup", "laundry hookups", "xno laundry"]
    assert values(spark, listing_text.normalize_laundry, laundry) == ["in_unit"] * 6 + ["in_building"] * 4 + ["hookups"] * 2 + [None]
    parking = ["valet parking", "off street", "driveway", "assigned parking", "parking included", "parking available", "parking spot", "street parking", "no parking", "_garage"]
    assert values(spark, listing_text.normalize_parking, parking) == ["garage"] + ["off_street"] * 6 + ["street", "none", None]


def test_boundary_before_a_letter_or_digit(spark):
    texts = ["no", "a no", "ano", "_no", "9no", "-no", "éno", "No"]
    assert values(spark, lambda t: scalars.matches(t, r"(?i)\bno\b"), texts) == [True, True, False, False, False, True, True, True]
    assert values(spark, lambda t: scalars.matches(t, r"\bn?o\b"), ["o", "no", "xo", "xno"]) == [True, True, False, False]
