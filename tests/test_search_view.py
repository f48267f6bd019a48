"""Search for many searches against one at a time, and what users write."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from hearthlake.operators import user_state
from hearthlake.operators.preference import query_tokens
from hearthlake.plans import search_view as sv

SEARCH = "search_id string, query string, center_lat double, center_lng double, radius_miles double, include_hidden boolean"
LISTING = "listing_id long, price_monthly double, price_effective_monthly double, first_seen_at timestamp, listing_status string, stale_status string, user_status string, title string, neighborhood string, description string, latitude double, longitude double"


def miles(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x))) * 0.621371


def plain(searches, listings, cap, ranked):
    """One search after the other over all listings."""
    out = {}
    for sid, query, lat, lng, radius, hidden in searches:
        found = []
        for i, price, effective, seen, status, stale, mark, title, hood, text, y, x in listings:
            live = status == "active" and stale is not None and stale != "likely_unavailable" and mark not in ("hidden", "not_a_fit", "rented_elsewhere")
            if (price is None and effective is None) or not (live or hidden):
                continue
            centred = lat is not None and radius is not None
            dist = miles(lat, lng, y, x) if centred and y is not None and x is not None else None
            if dist is None or dist <= radius:
                found.append((dist is None, dist or 0.0, -seen.timestamp(), i, " ".join(p for p in (title, hood, text) if p is not None).lower()))
        found = sorted(found)[:cap]
        tokens = query_tokens(query or "")
        hits = [sum(t in f[4] for t in tokens) if len(found) > ranked else 0 for f in found]
        order = sorted(range(len(found)), key=lambda k: (-hits[k], k))[:ranked]
        out[sid] = [(found[k][3], k + 1, hits[k]) for k in order]
    return out


def test_many_searches_equal_one_at_a_time(spark):
    import datetime as dt

    draw = random.Random(3)
    some = draw.choice
    texts = ["red ring", "Blue anvil", "unit near the park", "", None, "hot hot RING", "a-b c"]
    listings = [
        (i, some([None, 100.0]), some([None, 5.0]), dt.datetime(2024, 1, 1 + draw.randrange(20)), some(["active"] * 4 + ["expired"]), some(["active"] * 4 + ["likely_unavailable", None]), some([None, None, "hidden", "saved"]), some(texts), some(["Noe", None]), some(texts), some([None] + [37.7 + draw.gauss(0, 0.3)] * 5), -122.4 + draw.gauss(0, 0.3))
        for i in range(500)
    ]
    listings += [(900, 1.0, None, dt.datetime(2024, 1, 1), "active", "active", None, "far", "x", "y", 0.01, 179.99), (901, 1.0, None, dt.datetime(2024, 1, 1), "active", "active", None, "pole", "x", "y", 89.95, 10.0)]
    searches = [(f"s{i}", some(["ring by the park", "the unit", "", None, "RED anvil ring", "c"]), *some([(None, None, None), (37.7, -122.4, None), (37.7 + draw.gauss(0, 0.2), -122.4, draw.choice([0.01, 3.0, 25.0, 300.0]))]), some([True, False, None])) for i in range(40)]
    searches += [("line", "far", 0.0, -179.99, 20.0, False), ("pole", "x", 89.9, -170.0, 30.0, False), ("all", "x", 0.0, 0.0, 9000.0, False)]
    table, rows = spark.createDataFrame(searches + searches[:2] + [(None, "x", None, None, None, True)], SEARCH), spark.createDataFrame(listings, LISTING)
    for cap, ranked in ((5000, 24), (60, 7)):
        want = plain(searches, listings, cap, ranked)
        shortlist = sv.prerank(sv.candidates(table, rows, cap), rows.select("listing_id", F.lower(F.concat_ws(" ", "title", "neighborhood", "description")).alias("text")), table, ranked)
        got = {}
        for r in shortlist.orderBy("search_id", "turn").collect():
            got.setdefault(r.search_id, []).append((r.listing_id, r.place, r.hits))
        assert got == {k: v for k, v in want.items() if v}
    assert {i for i, *_ in want["line"]} >= {900} and {i for i, *_ in want["pole"]} >= {901}
    assert sv.candidates(table.limit(0), rows).count() == 0 and sv.candidates(table, rows.limit(0)).count() == 0


def test_answers_about_unknown_listings_go(spark):
    shortlist = spark.createDataFrame([("s", 1, 2, 1), ("s", 2, 0, 2), ("t", 1, 1, 1)], "search_id string, listing_id long, hits int, place int")
    replies = spark.createDataFrame([("s", 1, 140.0), ("s", 2, 100.0), ("s", 3, 99.0), ("t", 2, 50.0), ("t", 1, -4.0)], "search_id string, listing_id long, score double")
    assert sorted((r.search_id, r.listing_id, r.score, r["rank"]) for r in sv.accepted(replies, shortlist).collect()) == [("s", 1, 100.0, 1), ("s", 2, 100.0, 2), ("t", 1, 0.0, 1)]


def test_verdicts_dislikes_and_notes(spark):
    listings = spark.createDataFrame([(1,), (2,), (3,)], "listing_id long")
    states = spark.createDataFrame([(1, "saved", "n", "old"), (2, "maybe", None, "old"), (9, "saved", None, "old")], "listing_id long, status string, note string, updated_at string")
    requests = spark.createDataFrame([(1, 1, "hidden", "x"), (2, 1, None, None), (3, 3, "toured", None), (4, 3, "odd", None), (5, 7, "saved", None)], "pos long, listing_id long, status string, note string")
    errors = {r.pos: r.error for r in user_state.verdict_outcomes(requests, listings).collect()}
    assert errors == {1: None, 2: None, 3: None, 4: "invalid status: odd", 5: "listing not found"}
    after = sorted(tuple(r) for r in user_state.write_verdicts(states, requests, listings, F.lit("now")).collect())
    assert after == [(2, "maybe", None, "old"), (3, "toured", None, "now"), (9, "saved", None, "old")]
    dislikes = spark.createDataFrame([(1, 2, None), (2, 3, True), (3, 3, False)], "pos long, listing_id long, disliked boolean")
    after = {r.listing_id: r.status for r in user_state.write_verdicts(states, user_state.dislikes_as_verdicts(dislikes), listings, F.lit("now")).collect()}
    assert after == {1: "saved", 2: "not_a_fit", 9: "saved"}
    notes = spark.createDataFrame([(3, "old"), (9, "kept")], "listing_id long, note string")
    made = spark.createDataFrame([(2, "two"), (3, "three")], "listing_id long, note string")
    assert sorted(tuple(r) for r in user_state.write_memory(notes, dislikes, made).collect()) == [(2, "two"), (9, "kept")]


def test_saved_searches_are_made_and_deleted(spark):
    asked = spark.createDataFrame([(1, "me", " two rooms ", None, False), (2, "me", "", "Named", True), (3, "me", None, " ", False), (4, "me", None, None, None)], "pos long, owner string, query string, name string, has_criteria boolean")
    made = user_state.new_searches(asked, F.lit("now"))
    got = {r.pos: (r.name, r.query, r.error) for r in made.collect()}
    assert got == {1: ("two rooms", "two rooms", None), 2: ("Named", None, None), 3: ("Saved search", None, "a query or criteria is required"), 4: ("Saved search", None, "a query or criteria is required")}
    assert len({r.search_id for r in made.collect()}) == 4 and {r.search_id for r in made.collect()} == {r.search_id for r in user_state.new_searches(asked, F.lit("later")).collect()}
    one = made.filter("pos = 1").select("search_id")
    left, matches = user_state.delete_searches(made, one.withColumn("listing_id", F.lit(5)), one)
    assert left.count() == 3 and matches.count() == 0


def test_answers_are_not_broadcast_by_their_estimated_size(spark):
    replies = spark.range(1).select(F.col("id").alias("listing_id"), F.explode(F.sequence(F.lit(0), F.lit(999))).alias("search_id"), F.lit(1.0).alias("score"))
    shortlist = spark.createDataFrame([(3, 0, 1, 1)], "search_id int, listing_id long, hits int, place int")
    got = sv.accepted(replies, shortlist)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 1
