"""Edge cases of unit pages, the registry and geocoding that the queries do not show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthlake.operators import geocoding
from hearthlake.sources import pages, registry, units

CACHE = "address_key string, latitude double, longitude double, precision string"
ROWS = "listing_id long, source_id string, geocode_enabled boolean, address_raw string, neighborhood string, latitude double, longitude double, geocode_precision string"
NO_SHAPES = "name string, ord int, coordinates array<array<array<array<double>>>>"


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>nothing"), (4, "markers = [];")], "page_id long, html string")
    assert units.unit_listings(pages, "http://x").count() == 0
    assert units.markers(pages).count() == 0
    rows = units.unit_details(pages, "https://img/").collect()
    assert len(rows) == 4 and all(r.square_feet_raw is None and r.photos == [] and r.amenities == [] for r in rows)
    assert [(r.current_page, r.last_page) for r in units.page_numbers(pages).collect()] == [(None, None)] * 4


def test_last_marker_of_a_key_counts(spark):
    pages = spark.createDataFrame([(2, 'markers = [["1 A St", 3, 4], ["1 a st!", 5.5, -6]];'), (1, 'markers=[["1 A. St.", 1, 2]];')], "page_id long, html string")
    assert [tuple(r) for r in units.markers(pages).collect()] == [("1 a st", 5.5, -6.0)]


def test_info_line_takes_the_first_of_each_kind(spark):
    df = spark.createDataFrame([("Studio \\\\ 1 Bath // $1,795 // $5",), ("",), (None,), ("bed and bath",)], "raw string")
    rows = df.select(*(c.alias(n) for n, c in units.info_fields(F.col("raw")).items())).collect()
    assert [tuple(r) for r in rows] == [("Studio", "1 Bath", "$1,795"), (None,) * 3, (None,) * 3, ("bed and bath", None, None)]


def resolve(spark, rows, cache=(), answers=(), budget=20):
    centroids = spark.createDataFrame([("Middle", 37.75, -122.45)], "name string, latitude double, longitude double")
    table = lambda x: spark.createDataFrame(list(x), CACHE)
    done, fresh = geocoding.resolve(spark.createDataFrame(rows, ROWS), table(cache), table(answers), centroids, spark.createDataFrame([], NO_SHAPES), budget)
    return {r.listing_id: (r.latitude, r.geocode_precision, r.geocoded) for r in done.collect()}, sorted((r.address_key, r.latitude, r.precision) for r in fresh.collect())


def test_what_an_attempt_costs(spark):
    row = lambda i, address, hood=None, source="s", on=True: (i, source, on, address, hood, None, None, None)
    cache = [("known", 37.7, -122.4, "block"), ("bad", None, None, "unknown"), ("away", 10.0, 10.0, "city")]
    answers = [("new", 37.8, -122.4, "building"), ("late", 37.8, -122.4, "building")]
    rows = [row(1, "known"), row(2, "away"), row(3, "bad"), row(4, "New"), row(5, "new"), row(6, "nowhere"), row(7, "known", "Middle"), row(8, "late", "Middle"), row(9, "late", source="other"), row(10, "known", on=False), row(11, None, "Middle")]
    done, fresh = resolve(spark, rows, cache, answers, budget=3)
    # 3, 4 and 6 cost one each; then nothing is tried, what the cache knows neither.
    assert done == {
        1: (37.7, "block", "cache"), 2: (None, None, None), 3: (None, None, None), 4: (37.8, "building", "network"), 5: (37.8, "building", "cache"), 6: (None, None, None),
        7: (37.75, "neighborhood", "fallback"), 8: (37.75, "neighborhood", "fallback"), 9: (37.8, "building", "network"), 10: (None, None, None), 11: (37.75, "neighborhood", "fallback"),
    }
    assert fresh == [("late", 37.8, "building"), ("new", 37.8, "building"), ("nowhere", None, "unknown")]
    nothing, none = resolve(spark, rows, cache, answers, budget=0)
    assert none == [] and {x[2] for x in nothing.values()} == {None, "fallback"}


def test_rows_with_coordinates_stay(spark):
    done, fresh = resolve(spark, [(1, "s", True, "known", None, 1.0, 2.0, "exact"), (2, "s", True, "", None, 5.0, None, "half")], [("known", 37.7, -122.4, "block")])
    assert done == {1: (1.0, "exact", None), 2: (5.0, "half", None)} and fresh == []


def test_seeding_again_keeps_or_resets_what_was_switched_off(spark):
    columns = "id string, name string, enabled boolean, created_at timestamp, updated_at timestamp"
    table = spark.createDataFrame([("a", "old", False, None, None)], columns)
    seeds = spark.createDataFrame([("a", None, True), ("b", "B", True)], "id string, name string, enabled boolean")
    got = lambda **kw: sorted((r.id, r.name, r.enabled) for r in registry.seed_sources(table, seeds, F.current_timestamp(), **kw).collect())
    assert got() == [("a", None, False), ("b", "B", True)]
    assert got(reset_enabled=True) == [("a", None, True), ("b", "B", True)]


def test_failing_batches_are_written_by_run(spark, tmp_path):
    batch = spark.createDataFrame([("s", 1, "x"), ("t", 2, None), ("u", 3, "z")], "source_id string, n int, title string")
    runs = spark.createDataFrame([("r1", "s", "failed"), ("r2", "t", "partial"), ("r3", "u", "success")], "run_id string, source_id string, status string")
    for _ in range(2):
        registry.write_failed_batches(batch, runs, str(tmp_path / "bad"))
    rows = spark.read.schema("value string, run_id string").text(str(tmp_path / "bad")).collect()
    assert sorted((r.run_id, r.value) for r in rows) == [("r1", '{"source_id":"s","n":1,"title":"x"}'), ("r2", '{"source_id":"t","n":2}')]


def test_a_reader_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(registry, "READERS", dict(registry.READERS))
    registry.reader("plain", lambda df: df.select(F.col("payload").alias("title")))
    sources = spark.createDataFrame([("s", "plain", True), ("t", "plain", False), ("u", "other", True)], "id string, adapter_type string, enabled boolean")
    payloads = spark.createDataFrame([("s", "hello"), ("t", "off"), ("u", "?"), (None, "none")], "source_id string, payload string")
    assert [(r.title, r.adapter_type) for r in registry.read_sources(payloads, sources).collect()] == [("hello", "plain")]
    assert {(r.id, r.reason) for r in registry.skipped_sources(sources).collect()} == {("t", "disabled"), ("u", "no reader for other")}


@pytest.mark.parametrize("budget", [1, 2, 20])
def test_budget_against_a_plain_loop(spark, budget):
    import random

    draw = random.Random(budget)
    cache = {"k0": True, "k1": False}
    answers = {f"k{i}" for i in range(2, 6)}
    rows = [(i, draw.choice("st"), True, f"k{draw.randint(0, 9)}", None, None, None, None) for i in range(80)]
    done, _ = resolve(spark, rows, [("k0", 37.7, -122.4, "b"), ("k1", None, None, "unknown")], [(a, 37.8, -122.4, "b") for a in sorted(answers)], budget)
    left, known, want = {"s": budget, "t": budget}, {s: dict(cache) for s in "st"}, {}
    for i, s, _, key, *_ in rows:
        want[i] = None
        if left[s] <= 0:
            continue
        if key in known[s]:
            want[i] = "cache" if known[s][key] else None
            left[s] -= not known[s][key]
        else:
            known[s][key] = key in answers
            want[i] = "network" if key in answers else None
            left[s] -= 1
    assert {i: x[2] for i, x in done.items()} == want


def test_references_without_a_semicolon_are_text():
    page = pages.Elements('<title>a &amp;&lt;b&gt; c&amp</title><a href="?a=1&copy=2&amp;d=3">x &notit; &#65; & y</a><script>if (a && b &amp;&amp c) {}</script>')
    title, link, script = page.found
    assert title["text"] == "a &<b> c&amp" and link["attrs"]["href"] == "?a=1&copy=2&d=3" and script["text"] == "if (a && b &amp;&amp c) {}"
    assert link["text"].endswith(" A & y")
