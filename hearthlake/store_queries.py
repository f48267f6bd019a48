"""More registered queries: cards and views, keyed writes, run health, feeds, duplicates, texts; each with its SQL twin.

Orders stand for listings, their customers for sites, and lineitems, grouped by
order, for what was observed of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake.functions import geo, listing_text, tags
from hearthlake.functions.hashes import photo_hash
from hearthlake.functions.scalars import plain_number
from hearthlake.operators import duplicates, latest, liveness, merge, preference, risk, spatial
from hearthlake.operators.prefix import running_before
from hearthlake.plans import texts, views
from hearthlake.queries import PHRASE_SQL, phrase, query, read
from hearthlake.session import spread
from hearthlake.sources import feeds

NOW = "1998-07-01"


def _now():
    return F.lit(NOW).cast("timestamp")


# Cards and views

_CARDS_SQL = f"""st AS (SELECT l_orderkey AS id, CASE max(l_returnflag) WHEN 'R' THEN 'hidden' WHEN 'A' THEN 'saved' END AS user_status FROM lineitem GROUP BY l_orderkey HAVING max(l_returnflag) IN ('R', 'A')),
r AS (SELECT o_orderpriority AS source_id, o_orderdate AS began, CASE max(o_orderstatus) WHEN 'O' THEN 'partial' WHEN 'F' THEN 'failed' ELSE 'success' END AS status FROM orders GROUP BY ALL),
lr AS (SELECT source_id, max_by(status, began) AS last_run FROM r GROUP BY source_id),
pc AS (SELECT l_orderkey AS id, max(l_shipdate) AS changed, max(l_extendedprice) AS old_price, min(l_extendedprice) + max(l_quantity) AS new_price FROM lineitem GROUP BY l_orderkey),
b AS (SELECT o_orderdate AS since FROM (SELECT DISTINCT o_orderdate FROM orders) ORDER BY 1 DESC LIMIT 1 OFFSET 1),
cards AS (SELECT o_orderkey AS listing_id, user_status, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority ELSE 'source ' || o_orderpriority END AS source_name, last_run AS source_last_run, old_price, new_price,
  o_orderdate AS first_seen_at, o_totalprice AS price_monthly, o_orderstatus,
  array_to_string(list_filter([CASE WHEN user_status = 'saved' THEN user_status END, CASE WHEN o_totalprice > 300000 THEN 'verify_carefully' WHEN o_totalprice > 250000 THEN 'watch' END, CASE o_orderstatus WHEN 'F' THEN 'likely_unavailable' WHEN 'P' THEN 'stale' END,
    CASE WHEN changed > TIMESTAMP '{NOW}' - INTERVAL 14 DAYS THEN CASE WHEN new_price < old_price THEN 'price_drop' ELSE 'price_increase' END END, CASE WHEN o_orderdate > since THEN 'new_today' END, CASE WHEN o_totalprice < 50000 THEN 'duplicate' END,
    CASE WHEN last_run IN ('failed', 'partial') THEN 'source_uncertain' END], lambda x: x IS NOT NULL), ' ') AS badges
  FROM orders LEFT JOIN st ON st.id = o_orderkey LEFT JOIN lr ON lr.source_id = o_orderpriority LEFT JOIN pc ON pc.id = o_orderkey, b)"""


def _listings(spark, sf):
    c = F.col
    return read(spark, sf, "orders").select(
        c("o_orderkey").alias("listing_id"), c("o_orderpriority").alias("source_id"), c("o_orderdate").alias("first_seen_at"), c("o_totalprice").alias("price_monthly"), F.lit(None).cast("double").alias("price_effective_monthly"),
        F.when(c("o_totalprice") > 300000, "verify_carefully").when(c("o_totalprice") > 250000, "watch").alias("scam_risk_level"), F.lit("active").alias("listing_status"),
        F.when(c("o_orderstatus") == "F", "likely_unavailable").when(c("o_orderstatus") == "P", "missing_once").otherwise("active").alias("stale_status"),
        F.when(c("o_totalprice") < 50000, "g").alias("duplicate_group_id"), F.when(c("o_custkey") % 3 != 0, F.concat(F.lit("Area "), (c("o_custkey") % 7).cast("string"))).alias("neighborhood"),
        (F.lit(37.6) + (c("o_custkey") % 100) * F.lit(0.003)).alias("latitude"), (F.lit(-122.6) + (c("o_custkey") % 37) * F.lit(0.008)).alias("longitude"),
    )


def _cards(spark, sf, vision=None):
    items, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    states = items.groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.max("l_returnflag").alias("f")).select("listing_id", F.when(F.col("f") == "R", "hidden").when(F.col("f") == "A", "saved").alias("status")).filter("status is not null")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    sources = spark.createDataFrame([(n, f"source {n}") for n in names], "id string, name string")
    runs = orders.groupBy(F.col("o_orderpriority").alias("source_id"), F.col("o_orderdate").alias("started_at")).agg(F.max("o_orderstatus").alias("s"))
    runs = runs.withColumn("status", F.when(F.col("s") == "O", "partial").when(F.col("s") == "F", "failed").otherwise("success"))
    changes = items.groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.max("l_shipdate").alias("at"), F.max("l_extendedprice").alias("old_price"), (F.min("l_extendedprice") + F.max("l_quantity")).alias("new_price"))
    digests = orders.select(F.col("o_orderdate").alias("created_at")).distinct()
    return views.listing_cards(_listings(spark, sf), states, sources, runs, changes, digests, _now(), vision)


@query(f"WITH {_CARDS_SQL} SELECT listing_id, user_status, source_name, source_last_run, old_price, new_price, badges FROM cards")
def listing_cards(spark, sf):
    return _cards(spark, sf).select("listing_id", "user_status", "source_name", "source_last_run", "old_price", "new_price", F.array_join("badges", " ").alias("badges"))


@query(f"""WITH {_CARDS_SQL}, v AS (SELECT l_orderkey, count(*) || ' items' AS summary, list_sort(list_distinct(list(l_linestatus || l_returnflag))) AS features FROM lineitem GROUP BY l_orderkey)
SELECT listing_id, badges, summary AS visual_summary, coalesce(array_to_string(features, ' '), '') AS visual_features FROM cards LEFT JOIN v ON l_orderkey = listing_id""")
def cards_with_vision(spark, sf):
    seen = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.concat(F.count(F.lit(1)), F.lit(" items")).alias("summary"), F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))).alias("features"))
    return _cards(spark, sf, seen).select("listing_id", F.array_join("badges", " ").alias("badges"), "visual_summary", F.array_join("visual_features", " ").alias("visual_features"))


@query(f"WITH {_CARDS_SQL} SELECT listing_id, price_monthly, row_number() OVER (ORDER BY first_seen_at DESC, listing_id) AS place FROM cards WHERE o_orderstatus <> 'F' AND user_status IS DISTINCT FROM 'hidden' AND NOT contains(badges, 'verify_carefully')")
def browse_newest(spark, sf):
    rows = views.browse(_cards(spark, sf), hide_suspicious=True).select("listing_id", "price_monthly", (-F.unix_micros(F.col("first_seen_at").cast("timestamp"))).alias("age"), F.lit(1).alias("one"))
    return running_before(rows, [], ["age", "listing_id"], "one", "place").select("listing_id", "price_monthly", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT o_orderkey AS listing_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def dearest_listings(spark, sf):
    rows = preference.sort_by_price(_listings(spark, sf), "price_effective_monthly", "price_monthly", "listing_id", True).select("listing_id", (-F.col("price_monthly")).alias("cheap"), F.lit(1).alias("one"))
    return running_before(rows, [], ["cheap", "listing_id"], "one", "place").select("listing_id", (F.col("place") + 1).cast("long").alias("place"))


_MILES = "6371.0::DOUBLE * 2 * asin(sqrt(pow(sin(radians(lat - 37.75::DOUBLE) / 2), 2) + cos(radians(37.75::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng + 122.45::DOUBLE) / 2), 2))) * 0.621371::DOUBLE"


@query(f"""SELECT o_orderkey AS listing_id, floor(mi * 100 + 0.5) / 100 AS miles FROM (SELECT o_orderkey, o_orderdate, {_MILES} AS mi FROM
  (SELECT o_orderkey, o_orderdate, 37.6::DOUBLE + (o_custkey % 100) * 0.003::DOUBLE AS lat, -122.6::DOUBLE + (o_custkey % 37) * 0.008::DOUBLE AS lng FROM orders WHERE o_orderstatus <> 'F')) WHERE mi <= 3 ORDER BY mi, o_orderdate DESC, o_orderkey LIMIT 5000""")
def search_within_radius(spark, sf):
    rows = _listings(spark, sf).withColumns({"description": F.lit(""), "user_status": F.lit(None).cast("string")})
    found = views.search_candidates(rows, (37.75, -122.45), 3.0)
    return found.select("listing_id", (F.floor(F.col("distance_mi") * 100 + 0.5) / 100).alias("miles"))


@query("""SELECT o_orderkey AS listing_id, o_custkey % 3 = 0 AS approximate, 37.6::DOUBLE + (o_custkey % 100) * 0.003::DOUBLE AS lat, -122.6::DOUBLE + (o_custkey % 37) * 0.008::DOUBLE AS lng, o_totalprice AS price FROM orders""")
def map_point_features(spark, sf):
    rows = _listings(spark, sf).withColumn("geocode_precision", F.when(F.col("neighborhood").isNull(), "neighborhood").otherwise("building"))
    f = F.from_json("feature", "struct<geometry:struct<coordinates:array<double>>,properties:struct<approximate:boolean,price:double>>")
    return views.map_points(rows).withColumn("f", f).select("listing_id", "f.properties.approximate", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lng"), "f.properties.price")


@query("""SELECT x, y, count(*) AS listings FROM (SELECT CAST(floor((lng + 180) / 360 * (256.0::DOUBLE * 4096 / 50)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793::DOUBLE) / 2 * (256.0::DOUBLE * 4096 / 50)) AS BIGINT) AS y
  FROM (SELECT 37.60013::DOUBLE + (o_custkey % 100) * 0.003::DOUBLE AS lat, -122.60017::DOUBLE + (o_custkey % 37) * 0.008::DOUBLE AS lng FROM orders)) GROUP BY ALL""")
def map_cells(spark, sf):
    rows = _listings(spark, sf).select(geo.map_cell(F.col("latitude") + F.lit(0.00013), F.col("longitude") - F.lit(0.00017), 12).alias("c"))
    return rows.groupBy("c.x", "c.y").agg(F.count(F.lit(1)).alias("listings"))


@query("""SELECT o_orderkey AS listing_id, o_totalprice AS price, (SELECT string_agg(CAST(l AS VARCHAR), ' ' ORDER BY seen DESC) FROM (SELECT max(l_extendedprice) AS l, l_shipdate AS seen FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) GROUP BY l_shipdate ORDER BY seen DESC LIMIT 50)) AS prices FROM orders WHERE o_orderkey = (SELECT min(l_orderkey) FROM lineitem)""")
def listing_detail(spark, sf):
    items = read(spark, sf, "lineitem")
    key = items.agg(F.min("l_orderkey")).first()[0]
    history = items.groupBy(F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").alias("observed_at")).agg(F.max("l_extendedprice").alias("price"))
    events = read(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.col("ts").alias("created_at"), "event_type")
    groups = spark.createDataFrame([], "member_ids array<long>, confidence string, reasons array<string>")
    one = views.listing_detail(key, _listings(spark, sf).select("listing_id", F.col("price_monthly").alias("price")), history, events, groups)
    return one.select("listing_id", "price", F.array_join(F.transform("prices", lambda p: p["price"].cast("string")), " ").alias("prices"))


# Keyed writes

_OLD, _NEW = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1997-01-01'"
_OLD_SQL = f"old AS (SELECT o_orderkey AS id, o_custkey AS site, o_totalprice AS price, o_orderpriority AS note FROM orders WHERE {_OLD}), fresh AS (SELECT o_orderkey AS id, o_totalprice * 2 AS price, CASE WHEN o_orderstatus = 'F' THEN 'done' END AS note FROM orders WHERE {_NEW})"


def _old(spark, sf):
    return read(spark, sf, "orders").filter(_OLD).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"))


def _fresh(spark, sf):
    return read(spark, sf, "orders").filter(_NEW).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 2).alias("price"), F.when(F.col("o_orderstatus") == "F", "done").alias("note"))


@query(f"WITH {_OLD_SQL} SELECT coalesce(old.id, fresh.id) AS id, site, coalesce(fresh.price, old.price) AS price, coalesce(fresh.note, old.note) AS note FROM old FULL JOIN fresh ON old.id = fresh.id")
def upsert_rows(spark, sf):
    return merge.upsert(_old(spark, sf), _fresh(spark, sf), ["id"])


@query(f"WITH {_OLD_SQL} SELECT * FROM old UNION ALL SELECT id, NULL, price, note FROM fresh WHERE id NOT IN (SELECT id FROM old)")
def insert_ignore_rows(spark, sf):
    rows = _fresh(spark, sf).select("id", F.lit(None).cast("long").alias("site"), "price", "note")
    return merge.insert_ignore(_old(spark, sf), rows, ["id"])


@query("SELECT 'order' AS kind, o_orderkey AS id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderkey UNION ALL SELECT 'customer', c_custkey, 1 FROM customer WHERE NOT c_acctbal < 0")
def delete_cascade_rows(spark, sf):
    customers = read(spark, sf, "customer")
    left, orders = merge.delete_cascade(customers, read(spark, sf, "orders"), customers.filter("c_acctbal < 0").select("c_custkey"), "c_custkey", "o_custkey")
    out = orders.groupBy(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(left.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("n")))


@query(f"WITH {_OLD_SQL} SELECT fresh.id, fresh.price, coalesce(o.made, TIMESTAMP '{NOW}') AS created_at FROM fresh LEFT JOIN (SELECT o_orderkey AS id, o_orderdate AS made FROM orders WHERE {_OLD}) o ON o.id = fresh.id")
def replace_set_rows(spark, sf):
    table = read(spark, sf, "orders").filter(_OLD).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"))
    return merge.replace_set(table, _fresh(spark, sf).select("id", "price"), "id", "created_at", _now())


@query(f"SELECT o_custkey AS source_id, o_orderkey AS source_listing_id FROM orders WHERE {_OLD} AND NOT {_NEW} AND o_custkey IN (SELECT o_custkey FROM orders WHERE {_NEW})")
def missing_rows(spark, sf):
    keys = lambda where: read(spark, sf, "orders").filter(where).select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("source_listing_id"))
    return merge.missing_set(keys(_OLD), keys(_NEW))


@query("""WITH ch AS (SELECT l_orderkey AS id, l_shipdate AS seen, min(l_extendedprice) AS o, max(l_extendedprice) + max(l_linenumber) AS n FROM lineitem GROUP BY ALL), h AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
bare AS (SELECT o_orderkey AS id, o_orderdate AS seen, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT id FROM h))
SELECT bare.id AS listing_id, seen AS observed_at, coalesce(x.o, price) AS price FROM bare LEFT JOIN (SELECT id, min_by(o, seen) AS o FROM ch GROUP BY id) x ON x.id = bare.id UNION ALL SELECT id, seen, n FROM ch WHERE id IN (SELECT id FROM bare)""")
def price_history_rebuild(spark, sf):
    orders = read(spark, sf, "orders")
    changes = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").alias("at")).agg(F.min("l_extendedprice").alias("old_price"), (F.max("l_extendedprice") + F.max("l_linenumber")).alias("new_price"))
    listings = orders.select(F.col("o_orderkey").alias("listing_id"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_totalprice").alias("price"))
    return latest.rebuild_price_history(listings, changes, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("listing_id")))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def first_per_key(spark, sf):
    return latest.first_per_key(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


# Runs

_RUN_SQL = """r AS (SELECT l_orderkey AS run, count(*) FILTER (WHERE l_quantity > 25) AS rows, count(*) FILTER (WHERE l_returnflag = 'R') AS contract, count(*) + 3 AS details, count(*) FILTER (WHERE l_linestatus = 'O') AS failures, max(l_linenumber) < 7 AS complete, CASE WHEN min(l_tax) = 0 THEN 'down' END AS fatal, max(l_linenumber) AS photos FROM lineitem GROUP BY l_orderkey)"""


def _run_rows(spark, sf):
    n = lambda cond: F.count_if(F.expr(cond))
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(
        n("l_quantity > 25").alias("rows"), n("l_returnflag = 'R'").alias("contract"), (F.count(F.lit(1)) + 3).alias("details"), n("l_linestatus = 'O'").alias("failures"),
        (F.max("l_linenumber") < 7).alias("complete"), F.when(F.min("l_tax") == 0, "down").alias("fatal"), F.max("l_linenumber").alias("photos"),
    )


@query(f"""WITH {_RUN_SQL}, s AS (SELECT *, CASE WHEN fatal IS NOT NULL THEN 'failed' WHEN rows = 0 OR NOT complete OR contract > 0 OR (details >= 5 AND failures > 0.3 * details) THEN 'partial' ELSE 'success' END AS status FROM r)
SELECT run, status, status = 'success' AND complete AS trusted, array_to_string(list_filter([CASE WHEN details * 3 >= 10 AND rows < 0.4 * (details * 3) THEN 'listing_count_drop' END, CASE WHEN details >= 10 AND photos < 0.2 * details THEN 'photo_loss' END], lambda x: x IS NOT NULL), ' ') AS warnings FROM s""")
def run_status_rules(spark, sf):
    c = F.col
    rows = _run_rows(spark, sf).withColumn("status", liveness.run_status(c("fatal"), c("rows"), c("complete"), c("contract"), c("details"), c("failures")))
    warnings = liveness.health_warnings(c("rows"), c("details") * 3, c("details"), c("photos"))
    return rows.select("run", "status", liveness.may_advance(c("status"), c("complete")).alias("trusted"), F.array_join(warnings, " ").alias("warnings"))


@query("""WITH x AS (SELECT c_nationkey AS nation, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS with_price, count(*) FILTER (WHERE c_acctbal <= 0) AS unparsed FROM customer GROUP BY c_nationkey)
SELECT nation, total, with_price, CASE WHEN with_price < 0.6 * total OR unparsed > 0.1 * total THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM x""")
def batch_verdicts(spark, sf):
    none = F.lit(None)
    batch = read(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), F.concat(F.lit("https://a.example/"), "c_custkey").alias("original_url"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("price_monthly"), F.lit("ask").alias("price_raw"),
        F.col("c_mktsegment").alias("neighborhood"), none.cast("string").alias("address_raw"), none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), F.array().cast("array<string>").alias("photos"),
        none.cast("string").alias("description"), F.lit("card").alias("fetch_depth"), F.col("c_custkey").cast("string").alias("source_listing_id"),
    )
    return views.verification(batch, "nation").select("nation", "total", "with_price", "verdict")


# Feeds


@query("""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS source_listing_id, CASE WHEN l_orderkey % 3 <> 0 THEN 'Home ' || l_orderkey END AS property_name, CAST(n AS VARCHAR) AS unit, CASE WHEN 90 + n * 11 BETWEEN 100 AND 100000 THEN 90.0 + n * 11 END AS price, n / 2.0::DOUBLE AS bathrooms
FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)""")
def feed_apartments(spark, sf):
    flats = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    flat = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("apartmentId"), F.col("l_orderkey").cast("string").alias("propertyId"), F.col("l_linenumber").cast("string").alias("unit"),
        F.concat(F.lit("$"), (F.col("l_linenumber") * 11 + 90).cast("string")).alias("rent"), (F.col("l_linenumber") / 2.0).cast("string").alias("baths"), F.lit("pool~gym").alias("amenities"),
    )
    home = F.when(F.col("l_orderkey") % 3 != 0, F.array(F.struct(F.col("l_orderkey").cast("string").alias("propertyId"), F.concat(F.lit("Home "), "l_orderkey").alias("name"))))
    payload = flats.groupBy("l_orderkey").agg(F.collect_list(flat).alias("apartments")).select(F.to_json(F.struct("apartments", home.alias("properties"))).alias("payload"))
    return feeds.apartments(payload).select("source_listing_id", "property_name", F.col("unit_number_public").alias("unit"), F.col("price_monthly").alias("price"), "bathrooms")


@query("""SELECT id AS source_listing_id, title, price_monthly, bedrooms FROM (SELECT 'f' || p_size AS id, p_name AS title, 1000.0 + p_size * 10 AS price_monthly, CASE WHEN p_size % 5 <> 0 THEN p_size % 5 + 0.0::DOUBLE END AS bedrooms, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part) WHERE n = 1""")
def feed_floorplans(spark, sf):
    plan = F.create_map(
        F.lit("id"), F.concat(F.lit("f"), "p_size"), F.lit("name"), F.col("p_name"), F.lit("minRent"), F.concat(F.lit("$"), F.format_number(F.col("p_size") * 10 + 1000, 0)),
        F.lit("beds"), F.when(F.col("p_size") % 5 == 0, "N/A").otherwise((F.col("p_size") % 5).cast("string")),
    )
    rows = spread(read(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.to_json(F.array(plan)).alias("blob"))
    return feeds.floorplans(rows, F.col("blob")).select("source_listing_id", "title", "price_monthly", "bedrooms")


@query("""SELECT p_partkey || '-' || t AS source_listing_id, b AS bedrooms, r AS price_monthly FROM part, (VALUES ('Studio', 0, 900.0), ('2 BR', 2, 1800.0)) v(t, b, r)""")
def feed_unit_types(spark, sf):
    unit = lambda t, r: F.struct(F.lit(t).alias("unitType"), F.lit(r).alias("rent"), F.lit(1).alias("count"))
    payload = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array(unit("Studio", "$900"), unit("2 BR", "1,800")).alias("general"), F.array(unit("Studio", "$1")).alias("reserved")))
    return feeds.unit_types(spread(read(spark, sf, "part"), "p_partkey").select(payload.alias("payload"))).select("source_listing_id", "bedrooms", "price_monthly")


@query("SELECT CAST(p_partkey AS VARCHAR) AS source_listing_id, 'A & ' || p_name AS title, 100.0 + p_size * 7 AS price_monthly, p_size % 4 + 1.0::DOUBLE AS bedrooms FROM part")
def feed_posts(spark, sf):
    prose = F.concat(F.lit("<p>Rent is $"), F.col("p_size") * 7 + 100, F.lit(", a "), F.col("p_size") % 4 + 1, F.lit(" bedroom home</p>"))
    post = F.struct(F.col("p_partkey").alias("id"), F.lit("https://a.example/").alias("link"), F.struct(F.concat(F.lit("A &amp; "), "p_name").alias("rendered")).alias("title"), F.struct(prose.alias("rendered")).alias("content"))
    return feeds.posts(spread(read(spark, sf, "part"), "p_partkey").select(F.to_json(F.array(post)).alias("payload"))).select("source_listing_id", "title", "price_monthly", "bedrooms")


@query("SELECT p_partkey, 'http://a/' || p_size || CASE WHEN p_size % 2 = 0 THEN ' http://b/' || p_partkey ELSE '' END AS photos, 'beds: ' || p_size || ', brand: ' || p_brand AS facts FROM part")
def feed_details(spark, sf):
    photo = F.concat(F.lit("http://a/"), "p_size")
    photos = F.array(photo, F.lit("data:x"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("http://b/"), "p_partkey")))
    known = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("secret"), F.lit("x"), F.lit("beds"), F.col("p_size").cast("string"))
    return spread(read(spark, sf, "part"), "p_partkey").select("p_partkey", F.array_join(feeds.image_urls(photo, photos), " ").alias("photos"), F.array_join(feeds.attribute_lines(known, ["secret"]), ", ").alias("facts"))


@query("""WITH d AS (SELECT l_orderkey, sum(CAST(l_extendedprice * 100 AS BIGINT)) / 100 AS total FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, coalesce(o_orderstatus = 'F' AND abs(o_totalprice - total) > 0.25 * total, false) AS mismatch FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def price_mismatches(spark, sf):
    """An order's total as the card's price, the sum of its items as that of the detail page."""
    cents = F.bround(F.col("l_extendedprice") * 100).cast("long")
    total = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(cents) / 100).alias("total"))
    return read(spark, sf, "orders").join(total, "o_orderkey", "left").select("o_orderkey", risk.price_mismatch(F.col("o_totalprice"), F.col("total"), F.col("o_orderstatus") == "F").alias("mismatch"))


@query("""SELECT p_partkey, sha256(CASE WHEN p_size % 2 = 0 THEN 'https://a/' || p_size || '.jpg|https://b/' || p_partkey || '.jpg' ELSE 'https://b/' || p_partkey || '.jpg' END) AS photo_hash FROM part""")
def photo_hashes(spark, sf):
    a, b = F.concat(F.lit("https://A/"), "p_size", F.lit("_600x450.jpg")), F.concat(F.lit("https://b/"), "p_partkey", F.lit("_50x50c.JPG"))
    urls = F.array_compact(F.array(b, F.when(F.col("p_size") % 2 == 0, a), F.concat(F.lit("https://B/"), "p_partkey", F.lit(".jpg"))))
    return read(spark, sf, "part").select("p_partkey", photo_hash(urls).alias("photo_hash"))


# Duplicates

_HASH = "CASE WHEN length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) >= 40 THEN sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_HASH} AS h, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 3 AS VARCHAR) END AS unit, doc_id % 2 = 0 AS detail FROM documents),
a AS (SELECT h, arg_min((doc_id, unit), doc_id) AS f FROM d WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
e AS (SELECT a.f[1] AS x, d.doc_id AS y FROM d JOIN a ON d.h = a.h WHERE d.doc_id <> a.f[1] AND NOT coalesce(d.unit <> a.f[2], false)), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, w) AS (SELECT x, x FROM b UNION SELECT r.v, b.y FROM r JOIN b ON r.w = b.x), g AS (SELECT v, min(w) AS c FROM r GROUP BY v),
m AS (SELECT c, v, source, detail, row_number() OVER (PARTITION BY c ORDER BY detail DESC, 'd' || v) AS n FROM g JOIN d ON d.doc_id = g.v),
k AS (SELECT c, max(k) AS k FROM (SELECT c, source, count(DISTINCT v) AS k FROM m GROUP BY c, source) GROUP BY c)
SELECT 'dup_' || substr(sha1(string_agg('d' || v, '|' ORDER BY 'd' || v)), 1, 12) AS group_id, 'medium' AS confidence, CASE WHEN any_value(k.k) > 1 THEN 'repost_candidate same_description_hash' ELSE 'same_description_hash' END AS reasons, string_agg('d' || v, ' ' ORDER BY 'd' || v) AS members, max('d' || v) FILTER (WHERE n = 1) AS primary_id
FROM m JOIN k ON m.c = k.c GROUP BY m.c""")
def duplicate_listings(spark, sf):
    from hearthlake.functions.hashes import description_hash

    none = lambda t: F.lit(None).cast(t)
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").alias("nid"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("source_id"), F.concat(F.lit("d"), "doc_id").alias("source_listing_id"), none("string").alias("original_url"), none("string").alias("title"),
        none("string").alias("address_raw"), none("string").alias("address_normalized"), F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") % 3).cast("string")).alias("unit_number_public"), none("double").alias("price_monthly"),
        none("double").alias("bedrooms"), none("double").alias("bathrooms"), none("string").alias("neighborhood"), description_hash(F.col("text")).alias("description_hash"), none("array<string>").alias("photos"),
        F.lit("active").alias("listing_status"), F.lit("active").alias("stale_status"), none("string").alias("last_seen_at"), F.when(F.col("doc_id") % 2 == 0, "x").alias("detail_fetched_at"), none("string").alias("first_seen_at"),
    )
    found = duplicates.duplicate_groups(docs, ["nid"])
    return found.select("group_id", "confidence", F.array_join("reasons", " ").alias("reasons"), F.array_join("member_ids", " ").alias("members"), "primary_id")


@query(f"""WITH d AS (SELECT doc_id, source, {_HASH} AS h FROM documents), t AS (SELECT h, count(*) AS n, count(DISTINCT source) > 1 AS x FROM d WHERE h IS NOT NULL GROUP BY h) SELECT doc_id AS listing_id, t.h AS group_id, n - 1 AS peers, x AS cross_source FROM d JOIN t ON d.h = t.h""")
def group_peers(spark, sf):
    from hearthlake.functions.hashes import description_hash

    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("listing_id"), F.col("source").alias("source_id"), description_hash(F.col("text")).alias("group_id"))
    return duplicates.same_group(rows)


_FAMILIES_SQL = """c AS (SELECT o_orderkey AS nid, 'l' || o_orderkey AS id, o_custkey AS ck, o_orderkey % 8 AS m, o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS seen, CASE o_orderkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS mark FROM orders),
k AS (SELECT nid, ck, 'same_canonical_url' AS reason, CAST(ck AS VARCHAR) AS key, mark AS unit, NULL AS address FROM c WHERE m IN (0, 7) UNION ALL SELECT nid, ck, 'same_address_unit', ck || '|' || coalesce(mark, ''), mark, ck FROM c WHERE m IN (1, 2)
  UNION ALL SELECT nid, ck, 'same_address_price_beds_baths', CAST(ck AS VARCHAR), mark, ck FROM c WHERE m = 2 UNION ALL SELECT nid, ck, 'similar_title_price_neighborhood', CAST(ck AS VARCHAR), mark, NULL FROM c WHERE m = 4
  UNION ALL SELECT nid, ck, 'same_photo_hash', source || '|' || ck, mark, NULL FROM c WHERE m = 5 UNION ALL SELECT nid, ck, 'same_description_hash', CAST(ck AS VARCHAR), mark, NULL FROM c WHERE m IN (6, 7)),
a AS (SELECT reason, key, min(nid) AS first, arg_min(coalesce(unit, ''), nid) AS first_unit FROM k GROUP BY ALL),
e AS (SELECT DISTINCT first AS x, nid AS y, reason FROM k JOIN a USING (reason, key) WHERE nid <> first AND CASE WHEN reason IN ('same_canonical_url', 'same_address_price_beds_baths', 'same_description_hash') THEN unit IS NULL OR first_unit = '' OR unit = first_unit
  WHEN reason = 'same_photo_hash' THEN coalesce(unit, '') = first_unit ELSE true END)"""


@query(f"""WITH RECURSIVE {_FAMILIES_SQL}, b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(v, w) AS (SELECT x, x FROM b UNION SELECT r.v, b.y FROM r JOIN b ON r.w = b.x), g AS (SELECT v, min(w) AS comp FROM r GROUP BY v),
m AS (SELECT g.comp, c.* FROM g JOIN c ON c.nid = g.v), p AS (SELECT comp, count(*) FILTER (WHERE n > 1) > 0 AS twice FROM (SELECT comp, source, count(*) AS n FROM m GROUP BY ALL) GROUP BY comp),
f AS (SELECT comp, list_sort(list_distinct(list(reason))) AS reasons FROM e JOIN g ON g.v = e.x GROUP BY comp), q AS (SELECT f.comp, CASE WHEN twice AND (list_contains(reasons, 'same_photo_hash') OR list_contains(reasons, 'same_description_hash')) THEN list_sort(list_append(reasons, 'repost_candidate')) ELSE reasons END AS reasons FROM f JOIN p ON f.comp = p.comp),
o AS (SELECT comp, string_agg(id, ' ' ORDER BY id) AS members, arg_min(id, (-epoch(strptime(seen, '%Y-%m-%d')), id)) AS primary_id FROM m GROUP BY comp)
SELECT members, primary_id, array_to_string(reasons, ' ') AS reasons, CASE WHEN list_contains(reasons, 'same_canonical_url') THEN 'exact' WHEN list_contains(reasons, 'same_address_unit') OR list_contains(reasons, 'same_address_price_beds_baths') THEN 'high'
  WHEN list_contains(reasons, 'same_photo_hash') OR list_contains(reasons, 'same_description_hash') THEN 'medium' ELSE 'low' END AS confidence FROM o JOIN q ON o.comp = q.comp""")
def duplicate_families(spark, sf):
    """All six kinds of keys over all orders: each order has one or two of them, shared with others of its customer."""
    k, m, who = F.col("o_orderkey"), F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    has = lambda *kinds: m.isin(*kinds)
    number = lambda value, *kinds: F.when(has(*kinds), value).cast("double")
    orders = spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"), "o_orderkey")
    rows = orders.select(
        k.alias("nid"), F.concat(F.lit("l"), k).alias("id"), F.col("o_orderpriority").alias("source_id"), F.concat(F.lit("s"), k).alias("source_listing_id"), F.when(has(0, 7), F.concat(F.lit("https://Site.com/l/"), who, F.lit("/?utm_source=x&ref=y#top"))).alias("original_url"),
        F.when(has(4), F.concat(F.lit("Sunny corner flat "), who)).alias("title"), F.when(has(1, 2), F.concat(who, F.lit(" Main "), F.when(has(1), "Street").otherwise("St."))).alias("address_raw"), F.lit(None).cast("string").alias("address_normalized"),
        F.when(k % 3 == 0, "#1").when(k % 3 == 1, "2").alias("unit_number_public"), number(F.col("o_custkey") * 10, 2, 4).alias("price_monthly"), number(F.lit(2), 2).alias("bedrooms"), number(F.lit(1), 2).alias("bathrooms"), F.when(has(4), "Noe").alias("neighborhood"),
        F.when(has(6, 7), F.concat(F.lit("h"), who)).alias("description_hash"), F.when(has(5), F.array(F.concat(F.lit("https://img/"), who, F.lit("_600x450.jpg")))).alias("photos"), F.lit("active").alias("listing_status"), F.lit("active").alias("stale_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_seen_at"), F.lit(None).cast("string").alias("detail_fetched_at"), F.lit(None).cast("string").alias("first_seen_at"),
    )
    found = duplicates.duplicate_groups(rows, ["nid"])
    return found.select(F.array_join("member_ids", " ").alias("members"), "primary_id", F.array_join("reasons", " ").alias("reasons"), "confidence")


# Texts and tags


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 4 = 0 THEN 'beds:studio' ELSE 'beds:' || (p_size % 4) END, CASE WHEN price < 1000 THEN 'price:under-1k' ELSE 'price:' || k || 'k-' || (k + 1) || 'k' END, 'hood:' || replace(lower(p_name), ' ', '-'), 'type:' || lower(p_type),
  CASE WHEN p_size * 40 < 600 THEN 'size:compact' WHEN p_size * 40 > 1200 THEN 'size:large' END, CASE WHEN p_size % 3 = 0 THEN 'flooring:hardwood' END], lambda x: x IS NOT NULL), ' ') AS tags FROM (SELECT *, p_retailprice AS price, CAST(floor(p_retailprice / 1000) AS BIGINT) AS k FROM part)""")
def listing_tags(spark, sf):
    c, none = F.col, F.lit(None).cast("string")
    made = tags.characteristic_tags((c("p_size") % 4).cast("double"), c("p_retailprice"), c("p_name"), none, F.lit("unknown"), F.lit(True), F.lit(False), c("p_size") * 40, c("p_type"), F.lit(None).cast("array<string>"), F.when(c("p_size") % 3 == 0, "Hardwood everywhere"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(made, " ").alias("tags"))


@query("""SELECT o_orderkey, CASE WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m // 1440 < 31 THEN (m // 1440) || 'd ago' ELSE (m // 1440 // 30) || 'mo ago' END AS age FROM (SELECT o_orderkey, o_orderkey * 7 AS m FROM orders)""")
def age_texts(spark, sf):
    then = F.timestamp_seconds(F.unix_timestamp(_now()) - F.col("o_orderkey") * 420)
    return read(spark, sf, "orders").select("o_orderkey", tags.age_text(then, _now()).alias("age"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN DATE '1998-07-01' WHEN 1 THEN CASE WHEN DATE '1998-03-01' + CAST(o_orderkey % 28 AS INT) < DATE '1998-05-17' THEN DATE '1999-03-01' + CAST(o_orderkey % 28 AS INT) END ELSE DATE '1998-09-01' + CAST(o_orderkey % 28 AS INT) END AS available FROM orders""")
def availability_dates(spark, sf):
    day = (F.col("o_orderkey") % 28 + 1).cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "Available NOW").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("from March "), day)).otherwise(F.concat(F.lit("Sept. "), day))
    return read(spark, sf, "orders").select("o_orderkey", tags.parse_availability(raw, F.lit(NOW).cast("date")).alias("available"))


@query("""SELECT o_orderkey, o_orderkey || ' | T' || o_custkey || ' | ' || CASE WHEN o_orderkey % 3 = 0 THEN 'studio' ELSE (o_orderkey % 3) || ' bed' END || ' | $' || (o_custkey * 10) || ' | a, b' AS line,
  'Rent: ' || o_custkey || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Status: ' || o_orderstatus || chr(10) ELSE '' END || 'Description: ' || left(o_orderpriority, 5) AS facts, 'bright hall large tub ' || lower(o_orderpriority) AS visual FROM orders""")
def listing_lines(spark, sf):
    c, none = F.col, F.lit(None).cast("string")
    line = texts.candidate_line(c("o_orderkey").cast("string"), F.concat(F.lit("T"), "o_custkey"), none, (c("o_orderkey") % 3).cast("double"), c("o_custkey") * 10, F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), none, none)
    facts = texts.facts({"Rent": c("o_custkey"), "Status": F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus"))}, c("o_orderpriority"), 5)
    rooms = F.array(F.struct(F.lit("Hall").alias("room"), F.lit("Large  tub").alias("details")))
    return read(spark, sf, "orders").select("o_orderkey", line.alias("line"), facts.alias("facts"), texts.visual_search_text(F.array(F.lit("Bright")), none, rooms, c("o_orderpriority"), none).alias("visual"))


@query("""SELECT o_orderkey, '# Not liked: ' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'A' || o_custkey END, 'T') || chr(10) || '$' || o_custkey || ' a month · ' || CASE WHEN o_orderkey % 3 = 0 THEN 'studio' ELSE (o_orderkey % 3) || ' bed' END || chr(10) || 'Traits: carpet flooring, no parking, under $1k' || chr(10) || 'A trait counts only if it recurs among several listings.' AS note FROM orders""")
def dislike_notes(spark, sf):
    c = F.col
    made = texts.dislike_note(F.lit("T"), F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("A"), "o_custkey")), c("o_custkey").cast("double"), (c("o_orderkey") % 3).cast("double"), F.lit(None).cast("string"), F.array(F.lit("flooring:carpet"), F.lit("parking:none"), F.lit("price:under-1k")))
    return read(spark, sf, "orders").select("o_orderkey", made.alias("note"))


@query(f"""WITH t AS (SELECT o_orderkey, {PHRASE_SQL.format("o_orderkey")} AS d FROM orders), u AS (SELECT *, coalesce(nullif(regexp_extract(d, '(?i)(?:#\\s?|\\bunit\\s+#?)([A-Za-z]?\\d{{1,4}}(?:-\\d{{1,4}})?[A-Za-z]{{0,2}})\\b', 1), ''), nullif(regexp_extract(d, '^\\d+\\s+[A-Za-z][^-–#]{{2,40}}[-–]\\s*([A-Za-z]?\\d{{1,4}}(?:-\\d{{1,4}})?[A-Za-z]{{0,2}})\\s*$', 1), '')) AS unit FROM t)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '12b' ELSE nullif(regexp_replace(lower(unit), '[^a-z0-9]', '', 'g'), '') END AS unit, trim(regexp_replace(regexp_replace(lower(d), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS geocode_key,
  CASE o_orderkey % 4 WHEN 0 THEN 'exact_address' WHEN 1 THEN 'city' ELSE 'block' END AS precision, regexp_matches(lower(trim(d)), '^\\(?\\s*google map') AS junk, replace('Fifth ave and 3rd', 'Fifth', '5th') || o_orderkey AS street FROM u""")
def address_parts(spark, sf):
    d, k = phrase(F.col("o_orderkey")), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "house").when(k % 4 == 1, "town").otherwise("unheard of")
    return read(spark, sf, "orders").select(
        "o_orderkey", listing_text.effective_unit(F.when(k % 2 == 0, "#12-B"), d).alias("unit"), listing_text.geocode_key(d).alias("geocode_key"), listing_text.geocode_precision(kind).alias("precision"),
        listing_text.junk_address(d).alias("junk"), listing_text.street_ordinals(F.concat(F.lit("Fifth ave and third"), k)).alias("street"),
    ).withColumn("street", F.replace("street", F.concat(F.lit("third"), "o_orderkey"), F.concat(F.lit("3rd"), "o_orderkey")))


@query("""SELECT o_orderkey, CASE WHEN c_acctbal >= 0 AND o_orderpriority <> '5-LOW' THEN 37.5::DOUBLE + o_custkey END AS lat, o_orderpriority <> '5-LOW' AS cached FROM orders JOIN customer ON o_custkey = c_custkey""")
def geocode_lookup(spark, sf):
    """A cache of all customers' addresses, failures (a negative balance) included; orders of low priority go elsewhere."""
    cache = read(spark, sf, "customer").select(F.concat(F.lit("at "), "c_custkey").alias("address_key"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey") + 37.5).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("block").alias("precision"))
    address = F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "Far, ").otherwise(" At, "), "o_custkey")
    found = spatial.geocode(read(spark, sf, "orders"), cache, listing_text.geocode_key(address))
    return found.select("o_orderkey", F.col("hit_latitude").alias("lat"), "cached")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Nob Hill' WHEN 1 THEN 'Hill Side' WHEN 2 THEN NULL ELSE 'Mission' END AS area, o_orderkey % 4 <> 2 AS inside FROM orders""")
def area_names(spark, sf):
    areas = spark.createDataFrame([("Nob Hill", 0, ["nob"]), ("Hill Side", 1, ["side hills"]), ("Mission", 2, ["the mission"])], "name string, ord int, aliases array<string>")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "(Nob Hill), San Francisco CA").when(k == 1, "near side hills").when(k == 2, "Oakland").otherwise("Inner Mission District")
    rows = spatial.match_area(read(spark, sf, "orders").select("o_orderkey", raw.alias("raw")), F.col("raw"), areas)
    return rows.select("o_orderkey", "area", spatial.in_city(F.col("raw"), F.col("area")).alias("inside"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 100.0 ELSE floor(o_totalprice / 2000) END AS score FROM orders WHERE o_orderstatus = 'O'""")
def accepted_ranking(spark, sf):
    orders = read(spark, sf, "orders")
    reply = orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 2000).cast("double").alias("score"))
    return preference.accept_ranking(reply, orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'email' WHEN c_custkey % 3 = 1 THEN 'phone' ELSE 'unknown' END AS channel, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS recipient, 'Application: ' || c_name AS subject FROM customer""")
def application_drafts(spark, sf):
    k = F.col("c_custkey") % 3
    draft = preference.application_draft(F.when(k == 0, F.col("c_name")), F.when(k == 1, F.col("c_mktsegment")), F.col("c_name"), F.lit(None).cast("string"), "I can move in at once.", "Me")
    return read(spark, sf, "customer").select("c_custkey", draft.alias("d")).select("c_custkey", "d.channel", "d.recipient", "d.subject")


@query("SELECT c_custkey, '$' || printf('%,d', CAST(floor(abs(c_acctbal) + 0.5) AS BIGINT)) AS money, plain || '%' AS share FROM (SELECT c_custkey, c_acctbal, CAST(c_custkey % 50 AS VARCHAR) AS plain FROM customer)".replace("printf('%,d', ", "format('{:,}', "))
def money_texts(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", tags.money(F.abs("c_acctbal")).alias("money"), F.concat(plain_number(F.col("c_custkey") % 50), F.lit("%")).alias("share"))
