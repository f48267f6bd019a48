"""Multi-step scenarios of the listing operators."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthlake.operators import duplicates, incremental, latest, liveness, matching, merge, preference, risk, spatial, subscriptions
from hearthlake.operators.components import connected_components
from hearthlake.plans import views
from hearthlake.sources import feeds, pages, robots

CANDIDATE = (
    "nid long, id string, source_id string, source_listing_id string, original_url string, title string, price_monthly double, bedrooms double, bathrooms double, neighborhood string, address_raw string,"
    " address_normalized string, unit_number_public string, photos array<string>, description_hash string, last_seen_at timestamp, first_seen_at timestamp, detail_fetched_at timestamp, stale_status string, listing_status string"
)


def candidates(spark, *rows):
    base = dict.fromkeys([c.strip().split(" ")[0] for c in CANDIDATE.split(",")]) | {"stale_status": "active", "listing_status": "active", "source_id": "a"}
    made = [base | {"nid": i, "id": f"l{i}", "source_listing_id": f"s{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(m.values()) for m in made], CANDIDATE)


def groups(spark, *rows):
    found = duplicates.duplicate_groups(candidates(spark, *rows), ["nid"]).collect()
    return sorted((tuple(g.member_ids), g.confidence, tuple(g.reasons), g.primary_id) for g in found)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3), (900, 901), (901, 900), (901, 900)]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_few_edges_need_no_rounds_and_many_end_in_few(spark, monkeypatch):
    edges = [((i * 7919) % 3001, ((i + 1) * 7919) % 3001) for i in range(3000)] + [(5000 + i, 5000 + i // 2) for i in range(1, 900)]
    want = {i: 0 for i in range(3001)} | {5000 + i: 5000 for i in range(900)}
    rows = spark.createDataFrame(edges, "src long, dst long")
    context = spark.sparkContext
    context.setJobGroup("components", "a long chain in one task")
    got = connected_components(rows).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    context.setJobGroup("other", "")
    assert {r.id: r.component_id for r in got} == want and len(got) == len(want)
    assert jobs <= 8
    monkeypatch.setattr("hearthlake.operators.components.LAST_EDGES", 500)
    got = connected_components(rows).collect()
    assert {r.id: r.component_id for r in got} == want and len(got) == len(want)


def test_address_and_unit_link_across_sources(spark):
    a = {"address_raw": "100 Main Street", "unit_number_public": "4B"}
    assert groups(spark, a, a | {"source_id": "b", "unit_number_public": "#4-b"}, a | {"unit_number_public": "5"}) == [(("l0", "l1"), "high", ("same_address_unit",), "l0")]


def test_units_and_addresses_guard_content_links(spark):
    photo = {"photos": ["https://x/a_600x450.jpg"], "title": "Nice place"}
    assert groups(spark, photo | {"unit_number_public": "1"}, photo | {"unit_number_public": "2"}) == []
    assert groups(spark, photo, photo | {"source_id": "b"}) == []  # photos are compared within a source
    assert groups(spark, photo, photo)[0][1:3] == ("medium", ("repost_candidate", "same_photo_hash"))
    text = {"description_hash": "h"}
    assert groups(spark, text | {"address_raw": "1 A St"}, text | {"address_raw": "2 B St"}) == []
    assert groups(spark, text | {"source_id": "a"}, text | {"source_id": "b"})[0][2] == ("same_description_hash",)


def test_urls_titles_and_specs(spark):
    url = {"original_url": "https://x.com/l/1?utm_source=a"}
    assert groups(spark, url, url | {"original_url": "https://X.com/l/1/"})[0][1] == "exact"
    assert groups(spark, url | {"unit_number_public": "1"}, url | {"unit_number_public": "2"}) == []
    low = {"title": "Sunny top floor flat", "price_monthly": 3000.0, "neighborhood": "Noe Valley"}
    assert groups(spark, low, low | {"neighborhood": "noe valley"})[0][1] == "low"
    specs = {"address_raw": "9 Oak Ave", "price_monthly": 3000.0, "bedrooms": 1.0, "bathrooms": 1.0}
    got = groups(spark, specs, specs | {"address_raw": "9 Oak Avenue", "stale_status": "missing_once"})
    assert got[0][1] == "high" and "same_address_price_beds_baths" in got[0][2] and got[0][3] == "l0"


DETAIL = ["description"]
SNAPSHOT = (
    "source_id string, source_listing_id string, price_monthly double, price_effective_monthly double, price_raw string, title string, neighborhood string, listing_status string, content_hash string, latitude double,"
    " longitude double, geocode_precision string, photos array<string>, description string, listing_id string, first_seen_at timestamp, last_seen_at timestamp, stale_status string, missing_since timestamp, detail_fetched_at timestamp, run_id string"
)
BATCH = ", ".join(SNAPSHOT.split(", ")[:14]) + ", fetch_depth string, batch_pos int"


def batch(spark, *rows):
    base = dict.fromkeys([c.split(" ")[0] for c in BATCH.split(", ")]) | {"source_id": "s", "listing_status": "active", "title": "T", "fetch_depth": "card"}
    return spark.createDataFrame([tuple((base | {"batch_pos": i} | r).values()) for i, r in enumerate(rows)], BATCH)


def run(spark, snapshot, rows, day):
    now, name = F.lit(pd.Timestamp(f"2024-01-{day:02d}")), F.lit(f"r{day}")
    merged = merge.merge_batch(snapshot, merge.fold_batch(batch(spark, *rows), DETAIL), now, name, DETAIL).persist()
    events = sorted((e.event_type, e.old_value, e.new_value) for e in merge.events_of(merged, now, name).collect())
    table = spark.createDataFrame(merge.snapshot_of(merged).select(*[c.split(" ")[0] for c in SNAPSHOT.split(", ")]).collect(), SNAPSHOT)
    return table, events, merge.price_observations(merged, now, name).count(), merge.run_counters(merged).first()


def test_merge_over_several_runs(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    one = {"source_listing_id": "1", "price_monthly": 3000.0, "description": "long text", "fetch_depth": "detail", "content_hash": "h1", "photos": ["p"]}
    table, events, prices, counts = run(spark, empty, [one], 1)
    assert events == [("first_seen", None, "3000")] and prices == 1 and counts.n_new == 1
    table, events, prices, counts = run(spark, table, [one], 2)
    assert events == [] and prices == 0 and counts.n_unchanged == 1
    card = {"source_listing_id": "1", "price_monthly": 2800.0, "title": ""}
    table, events, prices, _ = run(spark, table, [card], 3)
    row = table.first()
    assert events == [("price_change", "3000", "2800")] and prices == 1
    assert (row.description, row.title, row.photos, row.content_hash) == ("long text", "T", ["p"], "h1")  # a card keeps the details
    table, events, _, _ = run(spark, table, [one | {"price_monthly": None, "content_hash": "h2"}], 4)
    assert events == [("content_change", "h1", "h2")] and table.first().price_monthly == 2800.0
    before = table.withColumn("stale_status", F.lit("missing_once"))
    table, events, _, _ = run(spark, before, [one | {"price_monthly": 2800.0, "content_hash": "h2"}], 5)
    assert events == [("reappeared", "missing_once", "active")] and table.first().stale_status == "active"
    table, events, _, _ = run(spark, table, [{"source_listing_id": "1", "listing_status": "expired"}], 6)
    assert ("listing_status_change", "active", "expired") in events and table.first().stale_status == "likely_unavailable"


def test_rows_of_one_batch_fold_in_order(spark):
    rows = [{"source_listing_id": "1", "price_monthly": 1.0, "fetch_depth": "detail", "description": "d"}, {"source_listing_id": "1", "price_monthly": 2.0, "description": "card text"}]
    got = merge.fold_batch(batch(spark, *rows), DETAIL).first()
    assert (got.price_monthly, got.description, got.fetch_depth, got.batch_rows) == (2.0, "d", "detail", 2)


def test_positions_only_improve(spark):
    near = {"source_listing_id": "1", "latitude": 1.0, "longitude": 1.0, "geocode_precision": "block"}
    table = run(spark, spark.createDataFrame([], SNAPSHOT), [near], 1)[0]
    table = run(spark, table, [near | {"latitude": 2.0, "geocode_precision": "city"}], 2)[0]
    assert table.first().latitude == 1.0
    assert run(spark, table, [near | {"latitude": 3.0, "geocode_precision": "building"}], 3)[0].first().latitude == 3.0


def day(text):
    return pd.Timestamp(text).to_pydatetime()


def test_liveness_moves_only_after_trusted_runs(spark):
    rows = [("s", "a", day("2024-01-01"), "active", None, "active"), ("s", "b", day("2024-01-05"), "active", None, "active"), ("t", "c", day("2024-01-01"), "missing_once", None, "active"), ("u", "d", day("2024-01-01"), "active", None, "active")]
    snapshot = spark.createDataFrame(rows, "source_id string, listing_id string, last_seen_at timestamp, stale_status string, missing_since timestamp, listing_status string")
    runs = spark.createDataFrame([("s", day("2024-01-05"), "success", True), ("t", day("2024-01-05"), "success", None), ("u", day("2024-01-05"), "partial", True)], "source_id string, started_at timestamp, status string, pagination_completed boolean")
    got = {r.listing_id: r.stale_status for r in liveness.advance_missing(snapshot, runs, F.lit(day("2024-01-06"))).collect()}
    assert got == {"a": "missing_once", "b": "active", "c": "missing_once", "d": "active"}
    chain = spark.range(1).select(liveness.advance(liveness.advance(liveness.advance(liveness.advance(F.lit("active"))))).alias("x")).first().x
    assert chain == "likely_unavailable"


def test_digest_tells_once(spark):
    current = spark.createDataFrame([("s", "a", 10.0), ("s", "b", 8.0), ("s", "c", 5.0)], "search_id string, listing_id string, price double")
    prior = spark.createDataFrame([("s", "b", True, "t", 9.0), ("s", "c", False, "t", 5.0), ("s", "d", True, "t", 1.0), ("s", "e", False, "t", 1.0)], "search_id string, listing_id string, still_matching boolean, notified_at string, notified_price double")
    changes = matching.digest(current, prior)
    assert {r.listing_id: r.kind for r in changes.collect()} == {"a": "new", "b": "price_drop", "c": "unchanged", "d": "dropped_out", "e": "gone"}
    state = matching.match_state(changes, prior, F.lit("now"))
    again = matching.digest(current, state)
    assert {r.kind for r in again.filter("still_matching").collect()} == {"unchanged"}
    text = views.digest_sections(changes, spark.createDataFrame([("a", "Flat A")], "listing_id string, title string")).first().markdown
    assert "## New\n- Flat A · $10" in text and "No longer matching" in text


def test_criteria_property_matched_iff_no_failures(spark):
    listings = spark.createDataFrame([("x", 3000.0, None, None), ("y", None, 2.0, True), ("z", 900.0, 0.0, False)], "listing_id string, price_monthly double, bedrooms double, cats_allowed boolean")
    searches = spark.createDataFrame([("s", 2000.0, 1.0, True)], "search_id string, max_price double, min_bedrooms double, require_cats_allowed boolean")
    listings = listings.withColumn("available_date", F.lit(None).cast("date"))
    pairs = listings.select("listing_id", F.lit("s").alias("search_id"))
    for r in subscriptions.explain_pairs(pairs, searches, listings).select("listing_id", "result.*").collect():
        assert r.matched == (r.eligible and not r.failed)
        want = {"x": (["price:above_max($3000)"], ["bedrooms", "cat_policy"]), "y": (["price:unknown"], []), "z": (["bedrooms:below_min", "cats:not_allowed"], [])}[r.listing_id]
        assert (r.failed, r.unknowns) == want


def test_risk_levels(spark):
    df = spark.createDataFrame([("!!! Great $$$ deal", "wire transfer only", 900.0, 1.0), ("Nice", "", 3000.0, 1.0), ("Wow!!!", "ok", 3000.0, 1.0)], "title string, description string, price double, bedrooms double").withColumn("neighborhood", F.lit("Mission"))
    df = risk.with_baseline(df, risk.baselines(df.limit(0).withColumn("price", F.col("price"))))
    c, none = F.col, F.lit(None)
    got = df.select("title", "baseline", risk.assess(c("title"), c("description"), c("price"), none.cast("int"), c("bedrooms"), c("neighborhood"), F.lit("1 A St"), none.cast("double"), F.lit(2), c("baseline"), F.lit(False), F.lit(False)).alias("r")).collect()
    assert [(g.baseline, g.r.level) for g in got] == [(3100.0, "verify_carefully"), (3100.0, "none"), (3100.0, "watch")]
    assert got[0].r.warnings[0] == "price_far_below_baseline: $900/mo vs ~$3100 typical for 1BR in Mission"


def test_areas_by_name_and_alias(spark):
    areas = spark.createDataFrame([("Nob Hill", 0, ["nob"]), ("Lower Nob Hill", 1, []), ("Mission District", 2, ["the mission", "mission"])], "name string, ord int, aliases array<string>")
    rows = spark.createDataFrame([("lower nob hill, San Francisco, CA",), ("(Mission)",), ("near nob",), ("Oakland",), (None,), ("south san francisco",)], "t string")
    got = spatial.match_area(rows, F.col("t"), areas).select("t", "area", spatial.in_city(F.col("t"), F.col("area")).alias("inside")).collect()
    assert [(g.area, g.inside) for g in got] == [("Lower Nob Hill", True), ("Mission District", True), (None, False), (None, False), (None, False), (None, False)]


def test_simplified_shapes_stay_closed(spark):
    ring = [[0.0, 0.0], [1.0, 0.000001], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([("a", [[ring], [[[0.0, 0.0], [0.00001, 0.0], [0.0, 0.0]]]])], "name string, coordinates array<array<array<array<double>>>>")
    assert spatial.simplify(df).first().coordinates == [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]]


def test_curation_never_empties_a_group(spark):
    disliked = spark.createDataFrame([(["a", "b"],), (["a"],), (["a", "c"],)], "tags array<string>")
    found = preference.aversions(disliked)
    assert [(r.tag, r["count"], r.strength) for r in found.collect()] == [("a", 3, 1.0)]
    rows = spark.createDataFrame([("g", 1, ["a"]), ("g", 2, ["x"]), ("h", 3, ["a"])], "grp string, pos int, tags array<string>")
    assert [(r.grp, r.pos) for r in preference.curate(rows, found, "grp", "pos").orderBy("pos").collect()] == [("g", 2), ("h", 3)]
    assert preference.aversions(disliked.limit(2)).count() == 0


def test_keyed_writes(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, note string")
    fresh = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "k string, n int, note string")
    assert sorted(map(tuple, merge.upsert(table, fresh, ["k"]).collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, None)]
    assert sorted(map(tuple, merge.insert_ignore(table, fresh, ["k"]).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)]
    left, below = merge.delete_cascade(table, table, table.filter("k = 'a'").select("k"), "k", "k")
    assert left.count() == below.count() == 1
    kept = merge.replace_set(table, spark.createDataFrame([("b",), ("d",)], "k string"), "k", "note", F.lit("now")).collect()
    assert dict(map(tuple, kept)) == {"b": "y", "d": "now"}


def test_budgeted_fetches_and_caps(spark):
    page = spark.createDataFrame([("s", "new", 0, 1.0), ("s", "moved", 1, 2.0), ("s", "same", 2, 3.0), ("s", "bare", 3, 3.0)], "source_id string, listing_id string, pos int, price double")
    known = spark.createDataFrame([("s", "moved", 9.0, "x", "active"), ("s", "same", 3.0, "x", "active"), ("s", "bare", 3.0, None, "active"), ("s", "off", 3.0, None, "missing_once"), ("s", "dead", 3.0, None, "likely_unavailable")], "source_id string, listing_id string, price double, detail_fetched_at string, stale_status string")
    plan = incremental.plan_fetches(page, known, 4).orderBy("turn").collect()
    assert [r.listing_id for r in plan] == ["new", "bare", "off", "moved"]
    rows = spark.createDataFrame([("k", 1, 3.0), ("k", 2, 3.0), ("k", 3, 3.0)], "k string, pos int, cost double")
    assert [r.runs for r in incremental.within_cap(rows, ["k"], ["pos"], "cost", 5.0).orderBy("pos").collect()] == [True, True, False]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: Lake\nDisallow: /private # no\nAllow: /private/open\nDisallow:\n"
    rules = robots.parse_rules(spark.createDataFrame([("s", text)], "site string, text string"))
    paths = spark.createDataFrame([("s", "/a"), ("s", "/private/x"), ("s", "/private/open/y"), ("t", "/z")], "site string, path string")
    assert {r.path: r.allowed for r in robots.allowed(paths, rules, "lakebot").collect()} == {"/a": True, "/private/x": False, "/private/open/y": True, "/z": True}
    assert {r.path: r.allowed for r in robots.allowed(paths, rules, "other").collect()} == {"/a": False, "/private/x": False, "/private/open/y": False, "/z": True}


def test_html_pages(spark):
    html = """<html><head><title>x</title></head><body><ol><li class="cl-static-search-result" title="One"><a href="https://e/1"><div class="title">One</div><div class="price">$2,000</div><div class="location">Noe</div></a></li></ol>
    <span id="titletextonly">A flat</span><span class="price">$2,100</span><section id="postingbody">Big <b>rooms</b></section><div class="attr"><span class="labl">laundry:</span><span class="valu">in unit</span></div>
    <div class="attr"><span class="valu">cats ok</span></div><div data-latitude="37.7" data-longitude="-122.4"></div><div class="mapaddress">1 A St</div><script>var imgList = [{"url":"https://i/1.jpg"},{"url":"https://i/1.jpg"}];</script></body></html>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in pages.read_cards(df).collect()] == [(1, 0, "One", "https://e/1", "$2,000", "Noe")]
    one, none = sorted(pages.read_details(df).collect())
    assert (one.title, one.description, one.attributes, one.plain_attributes, one.photos, one.latitude, one.address_raw) == ("A flat", "Big rooms", {"laundry": "in unit"}, ["cats ok"], ["https://i/1.jpg"], 37.7, "1 A St")
    assert none.title is None and none.photos == []
    assert pages.json_attribute('<div data-x="[{&quot;a&quot;:1}]">', "data-x") == '[{"a":1}]'


def test_feeds(spark):
    flats = '{"properties":[{"propertyId":"p","name":"Tower","city":"San Francisco"}],"apartments":[{"apartmentId":"1","propertyId":"p","rent":"$3,000","beds":"1","amenities":"gym~roof^"},{"apartmentId":"2","propertyId":"q","rent":"x"}]}'
    rows = feeds.apartments(spark.createDataFrame([(flats,)], "payload string")).orderBy("source_listing_id").collect()
    assert [(r.property_name, r.price_monthly, r.amenities_raw) for r in rows] == [("Tower", 3000.0, ["gym", "roof"]), (None, None, None)]
    plans = '[{"id":"a","name":"None","minRent":"2500","beds":"0"},{"id":"a","name":"second"},{"name":"no id"}]'
    got = feeds.floorplans(spark.createDataFrame([(1, plans)], "page_id long, b string"), F.col("b")).collect()
    assert [(r.source_listing_id, r.title, r.price_monthly) for r in got] == [("a", None, 2500.0)]
    units = '{"id":"x","name":"N","general":[{"unitType":"Studio","rent":"1500","count":2}],"reserved":[{"unitType":"Studio","rent":"900"},{"unitType":"2 BR","rent":"2000"}]}'
    got = feeds.unit_types(spark.createDataFrame([(units,)], "payload string")).orderBy("source_listing_id").collect()
    assert [(r.source_listing_id, r.bedrooms, r.price_monthly) for r in got] == [("x-2 BR", 2, 2000.0), ("x-Studio", 0, 1500.0)]
    posts = '[{"id":5,"link":"l","title":{"rendered":"<b>Flat</b>"},"content":{"rendered":"<p>2 bedroom for $3,500</p>"}}]'
    assert feeds.posts(spark.createDataFrame([(posts,)], "payload string")).select("title", "bedrooms", "price_monthly").first() == ("Flat", 2.0, 3500.0)
    prose = spark.createDataFrame([('Sure: {"level":"low","n":1} ok',), ("```json\n{\"level\":\"odd\",\"n\":1}\n```",), ("nothing",)], "t string")
    got = prose.select(feeds.validated(F.col("t"), "struct<level:string,n:int>", ["level", "n"], {"level": ["low", "high"]}).alias("v")).collect()
    assert [r.v and r.v.level for r in got] == ["low", None, None]


def test_latest_and_trend(spark):
    runs = spark.createDataFrame([("a", 1, 10, "success"), ("a", 2, 14, "success"), ("b", 1, 5, "skipped"), ("b", 2, 6, "failed")], "k string, at int, n int, status string")
    got = {r.k: (r.last_status, r.trend, r.last_success) for r in latest.run_trend(runs, "k", "at", "n", "status").collect()}
    assert got == {"a": ("success", 4, 2), "b": ("failed", None, None)}
    assert [(r.k, r.at) for r in latest.latest_per_key(runs, ["k"], ["at"]).orderBy("k").collect()] == [("a", 2), ("b", 2)]
    assert latest.boundary(runs.limit(1), "at").first().boundary is None


def test_plan_of_latest_per_key_combines_before_the_shuffle(spark):
    plan = latest.latest_per_key(spark.range(10).selectExpr("id % 2 as k", "id as at"), ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 1 and "Window" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_do_not_depend_on_partitions(spark, parts):
    rows = [{"description_hash": f"h{i % 5}", "source_id": f"s{i % 3}"} for i in range(30)]
    found = duplicates.duplicate_groups(candidates(spark, *rows).repartition(parts), ["nid"]).collect()
    assert sorted(g.group_id for g in found) == sorted(duplicates.duplicate_groups(candidates(spark, *rows), ["nid"]).toPandas().group_id)
    assert len(found) == 5
