"""Views over a handful of listings."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from hearthlake.plans import texts, views
from hearthlake.sources.store import SnapshotStore, copy_tables

NOW = datetime.datetime(2024, 1, 20)
LISTING = (
    "listing_id string, source_id string, title string, price_monthly double, price_effective_monthly double, listing_status string, stale_status string, neighborhood string, latitude double, longitude double,"
    " geocode_precision string, description string, first_seen_at timestamp, scam_risk_level string, duplicate_group_id string"
)


def day(n):
    return datetime.datetime(2024, 1, n)


def cards(spark):
    rows = [
        ("a", "s", "A", 3000.0, None, "active", "active", "Noe", 37.75, -122.43, "block", "x", day(18), "none", None),
        ("b", "s", "B", None, 2500.0, "active", "missing_once", "Noe", None, None, None, "y", day(2), "watch", "g"),
        ("c", "t", "C", None, None, "active", "active", None, 37.0, -122.0, "city", "z", day(3), "none", None),
        ("d", "t", "D", 1000.0, None, "active", "active", "Noe", 37.76, -122.42, "city", "z", day(4), "none", None),
    ]
    listings = spark.createDataFrame(rows, LISTING)
    states = spark.createDataFrame([("d", "hidden"), ("a", "saved")], "listing_id string, status string")
    sources = spark.createDataFrame([("s", "Source S")], "id string, name string")
    runs = spark.createDataFrame([("s", day(1), "success"), ("s", day(9), "partial")], "source_id string, started_at timestamp, status string")
    changes = spark.createDataFrame([("a", day(10), 3200.0, 3000.0), ("a", day(5), 3000.0, 3200.0), ("b", day(1), 1.0, 2.0)], "listing_id string, at timestamp, old_price double, new_price double")
    digests = spark.createDataFrame([(day(19),), (day(15),)], "created_at timestamp")
    return views.listing_cards(listings, states, sources, runs, changes, digests, F.lit(NOW))


def test_cards_badges_and_browse(spark):
    made = cards(spark)
    got = {r.listing_id: (r.source_name, r.badges) for r in made.collect()}
    assert got == {"a": ("Source S", ["saved", "price_drop", "new_today", "source_uncertain"]), "b": ("Source S", ["watch", "stale", "duplicate", "source_uncertain"]), "c": ("t", []), "d": ("t", [])}
    assert [r.listing_id for r in views.browse(made).collect()] == ["a", "b"]
    assert [r.listing_id for r in views.browse(made, ["noe"], sort="price_asc").collect()] == ["b", "a"]
    assert [r.listing_id for r in views.search_candidates(made, (37.75, -122.43), 5.0).collect()] == ["a", "b"]
    assert {r.listing_id for r in views.map_points(made, "a").collect()} == {"c", "d"}


def test_detail_has_history_and_peers(spark):
    history = spark.createDataFrame([("a", day(1), 3000.0), ("a", day(5), 3200.0), ("b", day(1), 1.0)], "listing_id string, observed_at timestamp, price double")
    events = spark.createDataFrame([("a", day(1), "first_seen")], "listing_id string, created_at timestamp, event_type string")
    groups = spark.createDataFrame([(["a", "z"], "high", ["same_address_unit"])], "member_ids array<string>, confidence string, reasons array<string>")
    row = views.listing_detail("a", cards(spark), history, events, groups).first()
    assert [p.price for p in row.prices] == [3200.0, 3000.0] and row.peers == ["z"] and row.events[0].event_type == "first_seen"


def test_texts(spark):
    c = F.lit
    row = spark.range(1).select(
        texts.visual_search_text(F.array(c("Bay  Window")), c("Bright"), F.array(F.struct(c("Kitchen").alias("room"), c("Gas range").alias("details"))), c(None).cast("string"), c("new")).alias("v"),
        texts.dislike_note(c("T"), c(None).cast("string"), c(2400.0), c(0.0), c("Noe"), F.array(c("flooring:carpet"))).alias("n"),
        texts.facts({"Beds": c(2), "None": c(None).cast("string")}, c("long text"), 4).alias("f"),
    ).first()
    assert row.v == "bay window bright kitchen gas range new"
    assert "Traits: carpet flooring" in row.n and "$2400 a month · studio · Noe" in row.n
    assert row.f == "Beds: 2\nDescription: long"


def test_store_versions_and_copies(spark, tmp_path):
    a, b = SnapshotStore(spark, str(tmp_path / "a")), SnapshotStore(spark, str(tmp_path / "b"))
    schema = "k string, n long"
    a.write("t", spark.createDataFrame([("x", 1)], schema))
    assert a.write("t", spark.createDataFrame([("x", 2), ("y", 3)], schema)) == 2
    assert sorted(map(tuple, a.read("t", schema).collect())) == [("x", 2), ("y", 3)] and a.read("u", schema).count() == 0
    b.write("t", spark.createDataFrame([("x", 9)], schema))
    copy_tables(a, b, {"t": schema}, {"t": ["k"]})
    assert sorted(map(tuple, b.read("t", schema).collect())) == [("x", 9), ("y", 3)]
