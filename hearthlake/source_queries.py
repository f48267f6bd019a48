"""Registered queries of source pages, the registry of sources, and geocoding; each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearthlake.functions import times
from hearthlake.operators import geocoding, merge
from hearthlake.plans import views
from hearthlake.queries import query, read
from hearthlake.session import shared_folder, spread
from hearthlake.sources import pages, payload_source, registry, store, units
from hearthlake.streaming import liveness_state

NOW = "1998-07-01"


def _parts(spark, sf):
    """Parts dealt to tasks before pages are made of them and parsed."""
    return spread(read(spark, sf, "part"), "p_partkey")


# Units


def _result_pages(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    marked = F.when(k % 2 == 0, F.concat(F.lit('<script>var markers = [["'), n, F.lit(' Main \\"St\\".", '), k % 90, F.lit(".5, -122.25, 1]];</script>"))).otherwise("")
    info = F.when(k % 3 == 0, F.lit("Studio \\ 1 Bath \\ $1,795")).otherwise(F.concat(F.lit("2 Beds // $"), n + 900, F.lit(" // 1.5 Baths")))
    html = F.concat(
        F.lit('<html><body><input type="hidden" name="current_page" value="'), n, F.lit("\"><input value='50' name='last_page'>"), marked,
        F.lit('<div class="searchListingContainer wide" id="post-'), k, F.lit('"><div class="imageCover" style="background-image: url(\'http://p/'), k, F.lit('(1).jpg\')"></div><a href="/u/'), k, F.lit('">see</a><h2>'), n,
        F.lit(" Main St  # "), k, F.lit('</h2><h3>North  Side</h3><p class="apartment-info">'), info, F.lit('</p><ul><li class="dog"></li></ul></div>'),
        F.lit('<div class="searchListingContainer" id="post-"><a href="/none">no number</a></div></body></html>'),
    )
    return _parts(spark, sf).select(k.alias("page_id"), html.alias("html"))


@query("""WITH m AS (SELECT p_size, max_by(p_partkey % 90 + 0.5::DOUBLE, p_partkey) AS lat FROM part WHERE p_partkey % 2 = 0 GROUP BY p_size)
SELECT CAST(p_partkey AS VARCHAR) AS source_listing_id, 'http://site/u/' || p_partkey AS original_url, p_size || ' Main St' AS address_raw, CAST(p_partkey AS VARCHAR) AS unit_number_public, 'http://p/' || p_partkey || '(1).jpg' AS primary_photo_url,
  CASE WHEN p_partkey % 3 = 0 THEN 1795.0 ELSE p_size + 900.0 END AS price_monthly, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE 2.0 END AS bedrooms, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 1.5 END AS bathrooms, true AS dogs_allowed, CAST(NULL AS BOOLEAN) AS cats_allowed,
  lat AS latitude, CASE WHEN lat IS NOT NULL THEN 'building' END AS geocode_precision FROM part LEFT JOIN m USING (p_size)""")
def unit_listings(spark, sf):
    rows = units.unit_listings(_result_pages(spark, sf), "http://site")
    number = lambda c: F.col(c).cast("double").alias(c)
    return rows.select("source_listing_id", "original_url", "address_raw", "unit_number_public", "primary_photo_url", number("price_monthly"), number("bedrooms"), number("bathrooms"), "dogs_allowed", "cats_allowed", "latitude", "geocode_precision")


@query("SELECT p_partkey AS page_id, p_size AS current_page, 50 AS last_page FROM part")
def result_page_numbers(spark, sf):
    return units.page_numbers(_result_pages(spark, sf))


@query("""SELECT p_partkey AS page_id, (p_size + 400) || ' sqft' AS square_feet_raw, 'About ' || p_name AS description, 'Pool ' || CASE WHEN p_partkey % 2 = 0 THEN 'Gym' ELSE p_brand END AS amenities,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://img/a(1).jpg https://img/b.jpg' ELSE 'https://img/c.jpg' END AS photos, CASE p_partkey % 3 WHEN 0 THEN 'now' WHEN 1 THEN '7/4/1998' END AS availability_raw, '$' || p_size || ',000' AS deposit_raw FROM part""")
def unit_details(spark, sf):
    k = F.col("p_partkey")
    gallery = F.lit('<div class="top-gallery"><img src="https://img/a(1).jpg"><img src="http://other/x.jpg"><p style="background-image:url( \'https://img/b.jpg\' )"></p><img src="https://img/a(1).jpg"></div>')
    when = F.when(k % 3 == 0, "Available now").when(k % 3 == 1, "available on: 7/4/1998").otherwise("taken")
    html = F.concat(
        F.lit("<body><main><p>"), F.col("p_size") + 400, F.lit(" Sq. Ft</p><div class='apt-description'>About "), "p_name", F.lit("</div><ul class='apt-amenities'><li>Pool</li><li> </li><li>"), F.when(k % 2 == 0, "Gym").otherwise(F.col("p_brand")),
        F.lit("</li><li>Pool</li></ul><p>"), when, F.lit("</p><p>Deposit: $"), "p_size", F.lit(",000</p>"), F.when(k % 2 == 0, gallery).otherwise("<a href='https://img/c.jpg'>photo</a>"), F.lit("</main></body>"),
    )
    rows = units.unit_details(_parts(spark, sf).select(k.alias("page_id"), html.alias("html")), "https://img/")
    return rows.select("page_id", "square_feet_raw", "description", F.array_join("amenities", " ").alias("amenities"), F.array_join("photos", " ").alias("photos"), "availability_raw", "deposit_raw")


# Detail pages


def _postings(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    inside = F.when(k % 3 != 2, F.concat(F.lit("37.7"), n)).otherwise(F.concat(F.lit("38."), n))
    gone = F.when(k % 10 == 0, "<p>This posting has\n expired.</p>").when(k % 10 == 1, "<p>This posting has been deleted by its author.</p>").otherwise("")
    address = F.when(k % 4 == 0, F.concat(n, F.lit(" Main St - #"), n, F.lit("B"))).when(k % 4 == 1, F.concat(n, F.lit(" Main St – rear"))).when(k % 4 == 2, "(google map)").otherwise(F.concat(n, F.lit(" Oak – Elm - "), n))
    link = F.when(k % 2 == 0, F.concat(F.lit('<a href="https://maps.google.com/?q=loc%3A+'), n, F.lit('+Main+San+Francisco+CA+941'), F.lpad((n % 100).cast("string"), 2, "0"), F.lit('">map</a>'))).otherwise('<a href="/x">x</a>')
    photos = F.when(k % 3 == 0, F.lit('var imgList = [{"url":"https://i/1.jpg"},{"u":1},{"url":"https://i/2.jpg"},{"url":"https://i/1.jpg"}];')).when(k % 3 == 1, F.lit("var imgList = [broken];")).otherwise("")
    html = F.concat(
        F.lit("<html><body>"), gone, F.lit('<span id="titletextonly"> A  '), "p_name", F.lit(' </span><span class="price">$'), n, F.lit('</span><span class="housing">'), n % 5, F.lit("br - "), n * 10, F.lit('ft2</span><div class="attrgroup"><span class="attr"><span class="valu">Available '), F.when(k % 2 == 0, "NOW").otherwise("jul 4"),
        F.lit('</span></span></div><div class="attr"><span class="labl">rent period:</span><span class="valu">monthly</span></div><div id="map" data-latitude="'), inside, F.lit('" data-longitude="-122.4" data-accuracy="'), n, F.lit('"></div><div class="mapaddress">'), address, F.lit("</div>"), link,
        F.lit('<section id="postingbody">QR Code Link to This Post Big '), "p_type", F.lit('</section><a class="thumb" href="https://t/'), k, F.lit('.jpg">t</a><p class="postinginfo">post id: '), k + 1000, F.lit('</p><p class="postinginfo">posted: <time datetime="2024-03-05T14:20:11-0800">x</time></p><p class="postinginfo">updated: <time datetime="2024-03-0'), n % 9 + 1,
        F.lit('T01:00:00+0000">y</time></p><script>'), photos, F.lit("</script></body></html>"),
    )
    return _parts(spark, sf).select(k.alias("page_id"), html.alias("html"))


@query("""WITH d AS (SELECT *, p_partkey % 10 > 1 AS here, p_partkey % 4 AS a FROM part)
SELECT p_partkey AS page_id, CASE p_partkey % 10 WHEN 0 THEN 'expired' WHEN 1 THEN 'removed_by_source' ELSE 'active' END AS listing_status, CASE WHEN here THEN 'A ' || p_name END AS title, CASE WHEN here THEN '$' || p_size END AS price_raw, CASE WHEN here THEN 'Big ' || p_type END AS description,
  CASE WHEN here AND p_partkey % 3 <> 2 THEN CAST('37.7' || p_size AS DOUBLE) END AS latitude, CASE WHEN here THEN p_size END AS map_accuracy, CASE WHEN here THEN CASE a WHEN 0 THEN p_size || ' Main St' WHEN 1 THEN p_size || ' Main St – rear' WHEN 3 THEN p_size || ' Oak – Elm' END END AS address_raw,
  CASE WHEN here THEN CASE a WHEN 0 THEN p_size || 'B' WHEN 3 THEN CAST(p_size AS VARCHAR) END END AS unit, CASE WHEN here AND p_partkey % 2 = 0 THEN '941' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') END AS postal_code, CASE WHEN here THEN CAST(p_partkey + 1000 AS VARCHAR) END AS post_id,
  CASE WHEN here THEN '2024-03-05T22:20:11.000Z' END AS posted, CASE WHEN here THEN '2024-03-0' || (p_size % 9 + 1) || 'T01:00:00.000Z' END AS updated, CASE WHEN here THEN (p_size % 5) || 'br - ' || (p_size * 10) || 'ft2' END AS bedrooms_raw, CASE WHEN here THEN CASE WHEN p_partkey % 2 = 0 THEN 'now' ELSE 'jul 4' END END AS availability_raw,
  CASE WHEN NOT here THEN '' WHEN p_partkey % 3 = 0 THEN 'https://i/1.jpg https://i/2.jpg' ELSE 'https://t/' || p_partkey || '.jpg' END AS photos FROM d""")
def posting_details(spark, sf):
    rows = pages.read_details(_postings(spark, sf))
    utc = lambda c: times.utc_text(times.instant(F.col(c)))
    return rows.select(
        "page_id", "listing_status", "title", "price_raw", "description", "latitude", "map_accuracy", "address_raw", F.col("unit_number_public").alias("unit"), "postal_code", "post_id", utc("posted_raw").alias("posted"), utc("updated_raw").alias("updated"),
        "bedrooms_raw", "availability_raw", F.array_join("photos", " ").alias("photos"),
    )


# Registry


def _sources(spark, sf):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "posts_json").when(k % 4 == 1, "unit_types_json").when(k % 4 == 2, "unheard_of")
    return read(spark, sf, "supplier").select(k.alias("id"), kind.alias("adapter_type"), (k % 5 != 0).alias("enabled"))


def _payloads(spark, sf):
    k, name = F.col("s_suppkey"), F.concat(F.lit("T"), "s_suppkey")
    post = F.to_json(F.array(F.struct(k.alias("id"), F.concat(F.lit("http://p/"), k).alias("link"), F.struct(name.alias("rendered")).alias("title"), F.struct(F.lit("<p>home</p>").alias("rendered")).alias("content"))))
    unit = F.to_json(F.struct(k.cast("string").alias("id"), name.alias("name"), F.array(F.struct(F.lit("2 BR").alias("unitType"), F.lit("$900").alias("rent"), F.lit(1).alias("count"))).alias("general")))
    return read(spark, sf, "supplier").select(k.alias("source_id"), F.when(k % 4 == 0, post).otherwise(unit).alias("payload"))


_REGISTERED_SQL = """SELECT CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) ELSE s_suppkey || '-2 BR' END AS source_listing_id, 'T' || s_suppkey AS title, CASE s_suppkey % 4 WHEN 0 THEN 'posts_json' ELSE 'unit_types_json' END AS adapter_type,
  CASE s_suppkey % 4 WHEN 0 THEN 'http://p/' || s_suppkey END AS original_url FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND s_suppkey % 5 <> 0"""


@query(_REGISTERED_SQL)
def registered_sources(spark, sf):
    return registry.read_sources(_payloads(spark, sf), _sources(spark, sf)).select("source_listing_id", "title", "adapter_type", "original_url")


@query(_REGISTERED_SQL)
def landed_sources(spark, sf):
    """The same through a landing folder and the data source that reads it."""
    payload_source.register(spark)
    folder = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    sources = _sources(spark, sf)
    payloads = _payloads(spark, sf).join(sources.select(F.col("id").alias("source_id"), "adapter_type"), "source_id")
    payload_source.write_batch(payloads, folder, 0)
    return payload_source.read_listings(spark, folder, sources).select("source_listing_id", "title", "adapter_type", "original_url")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'disabled' WHEN s_suppkey % 4 = 2 THEN 'no reader for unheard_of' ELSE 'no reader for none' END AS reason FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 4 > 1""")
def skipped_sources(spark, sf):
    return registry.skipped_sources(_sources(spark, sf)).select("id", "reason")


@query(f"""WITH t AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS enabled, s_nationkey AS robots FROM supplier), s AS (SELECT s_suppkey + 4 AS id, 'seed ' || s_suppkey AS name, true AS enabled FROM supplier)
SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN t.id IS NULL THEN s.enabled ELSE t.enabled END AS enabled, robots,
  CASE WHEN t.id IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1997-01-01' END AS created_at, CASE WHEN s.id IS NULL THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '{NOW}' END AS updated_at FROM t FULL JOIN s ON s.id = t.id""")
def seeded_sources(spark, sf):
    suppliers, then = read(spark, sf, "supplier"), F.lit("1997-01-01").cast("timestamp")
    id = F.col("s_suppkey").alias("id")
    table = suppliers.select(id, F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("s_nationkey").alias("robots"), then.alias("created_at"), then.alias("updated_at"))
    seeds = suppliers.select((F.col("s_suppkey") + 4).alias("id"), F.concat(F.lit("seed "), "s_suppkey").alias("name"), F.lit(True).alias("enabled"))
    return registry.seed_sources(table, seeds, F.lit(NOW).cast("timestamp"))


@query("""SELECT 'run ' || n_nationkey AS run_id, CASE n_regionkey WHEN 0 THEN 'failed' ELSE 'partial' END AS status, '{"source_id":' || c_nationkey || ',"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS record
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1)""")
def failed_batches(spark, sf):
    region = F.col("n_regionkey")
    status = F.when(region == 0, "failed").when(region == 1, "partial").otherwise("success")
    runs = read(spark, sf, "nation").select(F.concat(F.lit("run "), "n_nationkey").alias("run_id"), F.col("n_nationkey").alias("source_id"), status.alias("status"))
    return registry.failed_batches(read(spark, sf, "customer").select(F.col("c_nationkey").alias("source_id"), "c_custkey", "c_name"), runs)


# Geocoding and results

_PLACE_LAT, _PLACE_LNG = "37.6::DOUBLE + (k % 100) * 0.003::DOUBLE", "-122.6::DOUBLE + (k % 37) * 0.008::DOUBLE"
_GEO_SQL = f"""WITH r AS (SELECT o_orderkey AS listing_id, o_orderpriority AS s, o_custkey AS k, CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Middle' ELSE 'Far' END AS hood, o_orderstatus = 'F' AS had FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY listing_id) AS n FROM r WHERE NOT had AND s <> '5-LOW' AND k % 7 <> 0),
c AS (SELECT *, coalesce(sum(CASE WHEN k % 10 = 0 OR k % 5 IN (1, 2) AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 AS turn FROM a),
h AS (SELECT listing_id, k, k % 10 = 0 OR n > 1 AS cached, turn AND (k % 10 = 0 OR k % 5 IN (1, 2)) AND {_PLACE_LAT} BETWEEN 37.69 AND 37.85 AND {_PLACE_LNG} BETWEEN -122.55 AND -122.33 AS hit, turn AND k % 5 <> 0 AS called FROM c)"""


def _geocoded(spark, sf):
    k = F.col("o_custkey")
    rows = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("listing_id"), F.col("o_orderpriority").alias("source_id"), (F.col("o_orderpriority") != "5-LOW").alias("geocode_enabled"), F.when(k % 7 != 0, F.concat(F.lit("At, "), k)).alias("address_raw"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "Middle").otherwise("Far").alias("neighborhood"), *(F.when(F.col("o_orderstatus") == "F", 1.0).alias(c) for c in ("latitude", "longitude")), F.lit(None).cast("string").alias("geocode_precision"),
    )
    c = F.col("c_custkey")
    lat, lng = F.lit(37.6) + (c % 100) * F.lit(0.003), F.lit(-122.6) + (c % 37) * F.lit(0.008)
    place = lambda there: [F.concat(F.lit("at "), c).alias("address_key"), F.when(there, lat).alias("latitude"), F.when(there, lng).alias("longitude"), F.when(there, "block").otherwise("unknown").alias("precision")]
    customers = read(spark, sf, "customer")
    cache, answers = customers.filter("c_custkey % 5 = 0").select(*place(c % 10 == 0)), customers.filter("c_custkey % 5 <> 0").select(*place((c % 5).isin(1, 2)))  # the others are called for and not found
    centroids = spark.createDataFrame([("Middle", 37.75, -122.45)], "name string, latitude double, longitude double")
    west = [[[[-122.5003, 37.6], [-122.4003, 37.6], [-122.4003, 37.9], [-122.5003, 37.9], [-122.5003, 37.6]]]]
    shapes = spark.createDataFrame([("West", 0, west)], "name string, ord int, coordinates array<array<array<array<double>>>>")
    return geocoding.resolve(rows, cache, answers, centroids, shapes)


@query(f"""{_GEO_SQL} SELECT r.listing_id, CASE WHEN had THEN 1.0 WHEN hit THEN {_PLACE_LAT.replace('k %', 'r.k %')} WHEN hood = 'Middle' THEN 37.75 END AS latitude, CASE WHEN had THEN NULL WHEN hit THEN 'block' WHEN hood = 'Middle' THEN 'neighborhood' END AS geocode_precision,
  CASE WHEN had THEN NULL WHEN hit THEN CASE WHEN cached THEN 'cache' ELSE 'network' END WHEN hood = 'Middle' THEN 'fallback' END AS geocoded,
  CASE WHEN hood = '' AND hit AND {_PLACE_LNG.replace('k %', 'r.k %')} BETWEEN -122.5003 AND -122.4003 THEN 'West' ELSE hood END AS neighborhood FROM r LEFT JOIN h ON h.listing_id = r.listing_id""")
def geocode_resolved(spark, sf):
    return _geocoded(spark, sf)[0].select("listing_id", "latitude", "geocode_precision", "geocoded", "neighborhood")


@query(f"{_GEO_SQL} SELECT DISTINCT 'at ' || k AS address_key, CASE WHEN k % 5 IN (1, 2) THEN {_PLACE_LAT} END AS latitude, CASE WHEN k % 5 IN (1, 2) THEN 'block' ELSE 'unknown' END AS precision FROM h WHERE called")
def geocode_cache_writes(spark, sf):
    return _geocoded(spark, sf)[1].select("address_key", "latitude", "precision")


@query("""SELECT l_suppkey AS search_id, CAST(place - 1 AS INT) AS place, o_orderkey AS listing_id, o_totalprice AS price FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem)
JOIN orders ON o_orderkey = l_orderkey WHERE place <= 24 AND o_orderstatus <> 'P'""")
def search_result_summaries(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    top = read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", F.row_number().over(order).alias("n")).filter("n <= 24")
    results = top.groupBy(F.col("l_suppkey").alias("search_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_orderkey"))), lambda x: x["l_orderkey"]).alias("ids"))
    listings = read(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("listing_id"), F.col("o_totalprice").alias("price"))
    return views.result_summaries(results, listings, ["price"])


# Result cards, copied tables, liveness as a stream, photos of merged listings


@query("""SELECT p_partkey AS page_id, i AS pos, CASE i WHEN 0 THEN 'Flat ' || p_name ELSE 'By title' END AS title, 'https://e/' || p_partkey || '/' || i AS url, CASE i WHEN 0 THEN '$' || p_size || ',000' END AS price_raw, CASE i WHEN 0 THEN p_brand END AS location_raw
FROM part, (VALUES (0), (1)) v(i)""")
def result_cards(spark, sf):
    k = F.col("p_partkey")
    link = lambda i: F.concat(F.lit('<a href="https://e/'), k, F.lit(f'/{i}">'))
    html = F.concat(
        F.lit('<ol><li class="cl-static-search-result" title="x">'), link(0), F.lit('<div class="title">Flat  '), "p_name", F.lit('</div><div class="price">$'), "p_size", F.lit(',000</div><div class="location"> '), "p_brand", F.lit("</div></a></li>"),
        F.lit('<li class="result" title="By title">'), link(1), F.lit('x</a></li><li class="result"><b>no link</b></li></ol>'),
    )
    return pages.read_cards(_parts(spark, sf).select(k.alias("page_id"), html.alias("html")))


@query("""SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'verdict', s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'kept' ELSE s_name END FROM supplier""")
def copied_tables(spark, sf):
    """Nations as they are; of suppliers the target has some already, and keeps what it has."""
    root = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    source, target = store.SnapshotStore(spark, f"{root}/a"), store.SnapshotStore(spark, f"{root}/b")
    suppliers = read(spark, sf, "supplier")
    nations = read(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    verdicts = suppliers.select(F.lit("verdict").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    source.write("nations", nations)
    source.write("verdicts", verdicts)
    target.write("verdicts", verdicts.join(suppliers.filter("s_acctbal < 5000").select(F.col("s_suppkey").alias("id")), "id").select("kind", "id", F.lit("kept").alias("name")))
    schema = "kind string, id long, name string"
    store.copy_tables(source, target, {"nations": schema, "verdicts": schema}, {"verdicts": ["id"]})
    return target.read("nations", schema).unionByName(target.read("verdicts", schema))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), l AS (SELECT user_id, max(CAST(ts AS DATE)) AS last FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS listing_id, CASE LEAST((SELECT count(*) FROM d WHERE day > last), 3) WHEN 0 THEN 'active' WHEN 1 THEN 'missing_once' WHEN 2 THEN 'missing_multiple_runs' ELSE 'likely_unavailable' END AS status FROM l""")
def liveness_by_stream(spark, sf):
    """Every day a run that saw its users, as a stream in three batches."""
    root = f"{shared_folder(spark)}/liveness-{uuid.uuid4().hex}"
    days = read(spark, sf, "events").select(F.lit("s").alias("source_id"), F.col("user_id").cast("string").alias("listing_id"), F.datediff(F.to_date("ts"), F.lit("2000-01-01")).cast("long").alias("run_no")).distinct()
    ends = days.select("source_id", F.lit(None).cast("string").alias("listing_id"), "run_no").distinct().withColumn("trusted", F.lit(True))
    rows = days.withColumn("trusted", F.lit(None).cast("boolean")).unionByName(ends)
    rows.repartitionByRange(3, "run_no").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def keep(changes, batch_id: int) -> None:
        changes.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    liveness_state.liveness_stream(stream, buckets=4).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return liveness_state.statuses(spark.read.parquet(f"{root}/out")).select("listing_id", "status")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source_listing_id, CASE p_partkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'old a' WHEN 2 THEN 'new' ELSE 'old a' END AS photos FROM part""")
def merge_photos(spark, sf):
    """Photos after a batch: details with photos replace what is stored, cards fill only what is empty, empty lists change nothing."""
    k, none, text = F.col("p_partkey") % 4, F.lit(None), "array<string>"
    base = lambda *more: read(spark, sf, "part").select(
        F.lit("s").alias("source_id"), F.col("p_partkey").cast("string").alias("source_listing_id"), F.col("p_retailprice").alias("price_monthly"), none.cast("double").alias("price_effective_monthly"), none.cast("string").alias("price_raw"), F.col("p_name").alias("title"),
        none.cast("string").alias("neighborhood"), F.lit("active").alias("listing_status"), F.lit("h").alias("content_hash"), none.cast("double").alias("latitude"), none.cast("double").alias("longitude"), none.cast("string").alias("geocode_precision"), F.col("p_type").alias("description"), *more,
    )
    at = F.lit("2024-01-01").cast("timestamp")
    stored = F.when(k == 2, F.array().cast(text)).otherwise(F.array(F.lit("old"), F.lit("a"))).alias("photos")
    snapshot = base(stored, F.col("p_partkey").cast("string").alias("listing_id"), at.alias("first_seen_at"), at.alias("last_seen_at"), F.lit("active").alias("stale_status"), none.cast("timestamp").alias("missing_since"), at.alias("detail_fetched_at"), F.lit("r1").alias("run_id"))
    batch = base(F.when(k == 3, F.array().cast(text)).otherwise(F.array(F.lit("new"))).alias("photos"), F.when(k.isin(0, 3), "detail").otherwise("card").alias("fetch_depth"), F.lit(0).alias("batch_pos"))
    merged = merge.merge_batch(snapshot, merge.fold_batch(batch, ["description"]), at, F.lit("r2"), ["description"])
    return merged.select("source_listing_id", F.array_join("photos", " ").alias("photos"))
