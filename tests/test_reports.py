"""Reports, times with an offset, and the parts of detail pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthlake.functions import times
from hearthlake.plans import reports
from hearthlake.sources import pages


def test_times_with_an_offset(spark):
    raw = ["2024-03-05T14:20:11-0800", " 2024-03-05T14:20:11+05:30", "2024-03-05T14:20:11Z", "2024-03-05T14:20:11.25", "2024-12-31 23:59-01:00", "5 March", "", None, "2024-13-01T00:00:00Z"]
    read = lambda: [r.t for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string").select("id", times.utc_text(times.instant(F.col("raw"))).alias("t")).orderBy("id").collect()]
    want = ["2024-03-05T22:20:11.000Z", "2024-03-05T08:50:11.000Z", "2024-03-05T14:20:11.000Z", "2024-03-05T14:20:11.250Z", "2025-01-01T00:59:00.000Z", None, None, None, None]
    assert read() == want
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert read() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("address", "want"),
    [("1 A St", ("1 A St", None)), ("1 A St - #4B", ("1 A St", "4B")), ("1 A St – 12", ("1 A St", "12")), ("1 A St — rear", ("1 A St — rear", None)), ("1 A-B St", ("1 A-B St", None)), ("(google map)", (None, None)), ("Google Maps", (None, None)), (None, (None, None)), ("2 Oak - 123456789", ("2 Oak - 123456789", None))],
)
def test_units_behind_an_address(address, want):
    assert pages.split_unit(address) == want


def test_pins_outside_the_city_and_postings_that_are_gone():
    page = lambda lat, lng, more="": f'<body><div id="map" data-latitude="{lat}" data-longitude="{lng}" data-accuracy="10"></div>{more}</body>'
    names = dict(zip([x.strip().split(" ")[0] for x in pages.DETAIL.replace("map<string,string>", "map").split(",")][1:], range(30), strict=False))
    at = lambda html, name: pages.parse_detail(html)[names[name]]
    assert at(page(37.7, -122.4), "latitude") == 37.7 and at(page(37.6, -122.4), "latitude") is None and at(page(37.7, -122.3), "longitude") is None and at(page("x", "nan"), "latitude") is None
    assert at(page(38, -122.4), "map_accuracy") == 10
    gone = page(37.7, -122.4, "This posting has been\nflagged for removal")
    assert at(gone, "listing_status") == "removed_by_source" and at(gone, "latitude") is None and at(gone, "removed") is True
    assert len(pages.parse_detail("")) == len(names) and at("", "listing_status") == "active"


def test_digest_report_counts_all_and_shows_some(spark, tmp_path):
    changes = spark.createDataFrame([("a", f"l{i}", "new", True) for i in range(5)] + [("a", "d", "price_drop", True), ("b", "x", "gone", False), ("zz", "y", "new", True)], "search_id string, listing_id string, kind string, still_matching boolean")
    items = spark.createDataFrame([(f"l{i}", f"- item {i}") for i in range(4)], "listing_id string, text string")
    searches = spark.createDataFrame([("a", "Zeta"), ("b", "Alpha"), ("c", "Alpha")], "search_id string, name string")
    report = reports.digest_report(changes, items, searches, F.lit(9), F.lit("today"), 3)
    rows = {r.place: (r.search_id, r.markdown) for r in report.collect()}
    assert [rows[k][0] for k in range(4)] == [None, "b", "c", "a"]
    assert "5 new matches, 1 price drop, 0 dropped out — across 3 saved searches (9 live listings evaluated)." in rows[0][1]
    assert rows[1][1] == rows[2][1] == "## Alpha\n_0 current matches_\n\n_Nothing new._"
    assert rows[3][1] == "## Zeta\n_6 current matches_\n\n### New (5)\n- item 0\n- item 1\n- item 2\n\n### Price drops (1)\n- d"
    for _ in range(2):
        reports.write_report(report, str(tmp_path / "digest"))
    text = "\n\n".join(p.read_text() for p in sorted((tmp_path / "digest").glob("part-*")))
    assert text.startswith("# Digest — today") and text.index("## Alpha") < text.index("## Zeta") and text.count("## Zeta") == 1


def test_lines_about_runs_and_verifications(spark):
    base = {"source": "s", "status": "success", "reason": None, "found": 3, "new": 1, "changed": 0, "unchanged": None, "price_changes": 2, "missing": 0, "pages": 4, "details": 5, "pagination": None, "seconds": 7, "error": None}
    kinds = "source string, status string, reason string, found int, new int, changed int, unchanged int, price_changes int, missing int, pages int, details int, pagination boolean, seconds int, error string"
    rows = [base, base | {"status": "skipped", "reason": "robots"}, base | {"error": "no\nway", "pagination": False}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds).withColumn("warnings", F.when(F.col("error").isNotNull(), F.array(F.lit("few"))))
    lines = [r[0] for r in df.select(reports.run_line({c: F.col(c) for c in df.columns})).collect()]
    assert lines[0] == "- s: success, 3 listings found, 1 new, 0 changed, 0 unchanged, 2 price changes, 4p/5d, pagination unknown (7s)"
    assert lines[1] == "- s: skipped, robots" and lines[2].endswith("pagination INCOMPLETE (7s)\n    error: no\n    warning: few")
    text = spark.range(1).select(reports.verification_text(F.lit("s"), F.lit("FAIL"), F.lit(2), F.array(F.lit("error:missing_title"), F.lit("warning:low_price_coverage")))).first()[0]
    assert text == "s: FAIL (2 listings)\n  - ERROR: missing_title\n  - warning: low_price_coverage"
