"""Registered queries over the driver's tables, each with its SQL twin.

A query gets its raw text from the tables; where these hold no listing text, a
phrase from a fixed list is chosen by the row's key, on both sides alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthlake.functions import geo, hashes, listing_text, tags, urls
from hearthlake.functions.scalars import group, plain_number, round_half_up
from hearthlake.operators import dictionary, duplicates, incremental, latest, liveness, matching, merge, preference, quality, risk, spatial, subscriptions
from hearthlake.operators.components import connected_components
from hearthlake.operators.map_clusters import cluster_points as map_cluster_points
from hearthlake.plans import views
from hearthlake.session import materialize, shared_folder, spread
from hearthlake.sources import feeds, pages, robots
from hearthlake.sources.merge_table import MergeTable
from hearthlake.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PHRASES = [
    "Sunny 1BR / 1Ba 650ft2 near park, $2,450 a month. Laundry in building, street parking. Cats ok.", "Studio, 1.5 bath, 400 sq ft - $1,895! Washer/dryer in unit; attached garage; no pets",
    "3 bedroom 2 baths 1,250 sqft, $4200.00, w/d hookups, carport, pet friendly but breed restrictions apply", "2bd/shared bath, no laundry, no parking, dogs under 25 lbs",
    "1520 Gough St - 304", "Big loft Unit #1081C, 6 weeks free rent! one month free", "4.5 beds 13 ba 90000 square feet $99", "1690 North Point #305 - Stunning views, cats only, valet parking",
    "2 months free rent on a 12 month lease. $500 off first month", "Month-to-month, coin-op laundry, off-street parking, no dogs, one dog max", "",
    "Move-in special: act now! Send deposit before viewing, owner is out of the country, wire transfer only!!!",
]


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def phrase(key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (key % len(PHRASES) + 1).cast("int"))


PHRASE_SQL = f"{_sql_list(PHRASES)}[CAST({{}} % {len(PHRASES)} AS INT) + 1]"


# Pages


@query(r"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '</(p|div|li|h[1-6])>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#0?39;|&apos;', '''', 'g'), '&nbsp;', ' '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS text FROM pages""")
def pages_html_to_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", listing_text.html_to_text(F.col("html")).alias("text"))


_URL_SQL = r"""SELECT page_id, url,
    CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || host || CASE WHEN port = '' OR port = CASE WHEN scheme = 'https' THEN '443' ELSE '80' END THEN '' ELSE ':' || port END
      || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url
  FROM (SELECT page_id, url, lower(p[1]) AS scheme, lower(p[2]) AS host, p[3] AS port, regexp_replace(p[4], '/{2,}', '/', 'g') AS path,
      coalesce((SELECT string_agg(CASE WHEN contains(q, '=') THEN q ELSE q || '=' END, '&' ORDER BY split_part(q, '=', 1), i) FROM (SELECT unnest(string_split(p[5], '&')) AS q, unnest(range(len(string_split(p[5], '&')))) AS i)
        WHERE q <> '' AND NOT starts_with(lower(split_part(q, '=', 1)), 'utm_') AND lower(split_part(q, '=', 1)) NOT IN ('fbclid', 'gclid', 'gclsrc', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'ref', 'ref_src', 'referrer', 'spm', 'cmpid', 'campaign_id', 'share_id', 'vgo_ee')), '') AS query
    FROM (SELECT page_id, url, [regexp_extract(trim(url), r, 1), regexp_extract(trim(url), r, 2), regexp_extract(trim(url), r, 3), regexp_extract(trim(url), r, 4), regexp_extract(trim(url), r, 5)] AS p
      FROM (SELECT page_id, url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$' AS r FROM pages)))"""
_URL_SQL = _URL_SQL.replace("regexp_extract(trim(url), r,", "regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\\d*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$',")


@query(f"SELECT page_id, canonical_url FROM ({_URL_SQL})")
def pages_canonical_url(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT canonical_url, count(*) AS pages, min(page_id) AS first_page FROM ({_URL_SQL}) GROUP BY canonical_url")
def pages_url_groups(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    return rows.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(r"""SELECT page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS domain,
  right(regexp_replace(url, '[^A-Za-z0-9]', '', 'g'), 10) AS slug FROM pages""")
def pages_domain(spark, sf):
    return read(spark, sf, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"), urls.url_slug(F.col("url")).alias("slug"))


ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/8\nDisallow: /de/1\n\nUser-agent: lake\nUser-agent: other # two agents\nDisallow: /en/1\nAllow: /en/1\nDisallow: /es\n"


@query(r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT page_id, path, CASE WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/es') THEN false ELSE true END AS allowed FROM p""")
def pages_robots_rules(spark, sf):
    path = F.coalesce(group(F.col("url"), r"^[^:]*://[^/?#]*([^?#]*)"), F.lit("/"))
    paths = read(spark, sf, "pages").select("page_id", path.alias("path"), F.lit("s").alias("site"))
    rules = robots.parse_rules(spark.range(1).select(F.lit("s").alias("site"), F.lit(ROBOTS).alias("text")))
    return robots.allowed(paths, rules, "Hearthlake/1.0").select("page_id", "path", "allowed")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
  CAST(NULL AS INT) AS description_chars, 0 AS photos, regexp_matches(lower(regexp_replace(regexp_extract(html, '(?s)<body.*', 0), '\s+', ' ', 'g')), 'this posting has (been deleted by its author|been flagged for removal|expired)') AS removed FROM pages""")
def pages_details(spark, sf):
    return pages.read_details(read(spark, sf, "pages")).select("page_id", "title", F.length("description").alias("description_chars"), F.size("photos").alias("photos"), "removed")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]{9,}[.]html') THEN regexp_extract(url, '([0-9]{9,})[.]html', 1) ELSE nullif(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '') END AS listing_id FROM pages""")
def pages_listing_ids(spark, sf):
    return read(spark, sf, "pages").select("page_id", listing_text.listing_id_from_url(F.col("url")).alias("listing_id"))


# Documents


_DESC = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_DHASH = f"CASE WHEN length({_DESC}) >= 40 THEN sha256({_DESC}) END"


@query(f"SELECT doc_id, {_DHASH} AS description_hash FROM documents")
def docs_description_hash(spark, sf):
    return read(spark, sf, "documents").select("doc_id", hashes.description_hash(F.col("text")).alias("description_hash"))


@query(f"SELECT h AS description_hash, count(*) AS docs, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM (SELECT doc_id, source, {_DHASH} AS h FROM documents) WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1")
def docs_hash_groups(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "source", hashes.description_hash(F.col("text")).alias("description_hash")).filter("description_hash is not null")
    return rows.groupBy("description_hash").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).filter("docs > 1")


@query(f"SELECT h AS description_hash, count(DISTINCT lower(source)) AS areas FROM (SELECT source, {_DHASH} AS h FROM documents) WHERE h IS NOT NULL AND source <> '' GROUP BY h HAVING count(DISTINCT lower(source)) > 1")
def docs_cross_source_reuse(spark, sf):
    rows = read(spark, sf, "documents").select("source", hashes.description_hash(F.col("text")).alias("description_hash"))
    return duplicates.shared_across(rows, "description_hash", "source")


_KEYS_SQL = f"SELECT doc_id, 'h' AS reason, {_DHASH} AS key FROM documents UNION ALL SELECT doc_id, 'p', source || '|' || sha256(lower(text)) FROM documents"


@query(f"""WITH RECURSIVE k AS ({_KEYS_SQL}), a AS (SELECT reason, key, min(doc_id) AS first_doc FROM k WHERE key IS NOT NULL GROUP BY reason, key),
e AS (SELECT DISTINCT a.first_doc AS x, k.doc_id AS y FROM k JOIN a USING (reason, key) WHERE k.doc_id <> a.first_doc), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(v, w) AS (SELECT x, x FROM b UNION SELECT r.v, b.y FROM r JOIN b ON r.w = b.x)
SELECT v AS doc_id, min(w) AS component_id FROM r GROUP BY v""")
def docs_components(spark, sf):
    # Texts are hashed once; what follows reads the hashes.
    docs = materialize(read(spark, sf, "documents").select("doc_id", "source", hashes.description_hash(F.col("text")).alias("h"), F.sha2(F.lower("text"), 256).alias("t")))
    keys = F.array(F.struct(F.lit("h").alias("reason"), F.col("h").alias("key")), F.struct(F.lit("p").alias("reason"), F.concat("source", F.lit("|"), "t").alias("key")))
    rows = docs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.*").filter("key is not null")
    first = rows.groupBy("reason", "key").agg(F.min("doc_id").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = rows.join(first, ["reason", "key"]).select("src", F.col("doc_id").alias("dst"))
    return connected_components(edges).withColumnRenamed("id", "doc_id")


@query(f"""SELECT h AS description_hash, doc_id AS primary_doc FROM (
  SELECT h, d.doc_id, row_number() OVER (PARTITION BY h ORDER BY coalesce(quality, -1) DESC, n_chars DESC, d.doc_id) AS n
  FROM (SELECT doc_id, n_chars, {_DHASH} AS h FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE h IS NOT NULL) WHERE n = 1""")
def docs_primary_pick(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "n_chars", hashes.description_hash(F.col("text")).alias("description_hash")).filter("description_hash is not null")
    met = docs.join(read(spark, sf, "labels"), "doc_id", "left")
    best = F.max_by("doc_id", F.struct(F.coalesce("quality", F.lit(-1)), "n_chars", -F.col("doc_id")))
    return met.groupBy("description_hash").agg(best.alias("primary_doc"))


@query(f"""WITH t AS (SELECT o_orderkey, {PHRASE_SQL.format("o_orderkey")} AS d, o_totalprice FROM orders),
f AS (SELECT o_orderkey,
  regexp_matches(d, '(?i)\\b(wire transfer|western union|moneygram|cashier''?s? check|money order first|zelle|venmo|cash ?app|bitcoin|crypto)\\b') AS a,
  regexp_matches(d, '(?i)\\b(deposit|payment|fee|money)\\b[^.!\\n]{{0,60}}\\b(before|prior to|without)\\b[^.!\\n]{{0,40}}\\b(viewing|tour|seeing|showing|visit)') AS b,
  regexp_matches(d, '(?i)\\b(out of (the )?(country|state|town)|currently (abroad|overseas|traveling)|missionary|on a mission|military deployment|deployed overseas)\\b') AS c,
  regexp_matches(d, '(?i)\\b(act (fast|now|quickly)|first come,? first serve[d]?|won''?t last|send (the )?(deposit|money) (today|now|asap))\\b') AS u, o_totalprice < 1000 AS np FROM t)
SELECT o_orderkey, CASE WHEN a OR b OR c OR (CAST(u AS INT) + CAST(np AS INT)) >= 2 THEN 'verify_carefully' WHEN u OR np THEN 'watch' ELSE 'none' END AS level,
  array_to_string(list_filter([CASE WHEN a THEN 'suspicious_payment_language: mentions wire/app-based payment' END, CASE WHEN b THEN 'payment_before_viewing_language' END,
    CASE WHEN c THEN 'owner_unavailable_language: classic remote-landlord pattern' END, CASE WHEN u THEN 'urgency_pressure_language' END, CASE WHEN np THEN 'no_photos' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM f""")
def order_risk_rules(spark, sf):
    none = F.lit(None).cast("string")
    verdict = risk.assess(none, phrase(F.col("o_orderkey")), F.lit(None).cast("double"), none.cast("int"), none.cast("double"), none, F.lit("somewhere"), none.cast("double"), F.when(F.col("o_totalprice") < 1000, 0).otherwise(3), none.cast("double"), F.lit(False), F.lit(False))
    return read(spark, sf, "orders").withColumn("r", verdict).select("o_orderkey", "r.level", F.array_join("r.warnings", "; ").alias("warnings"))


@query("SELECT doc_id, CASE WHEN length(t) > 220 THEN left(t, 220) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)".replace("\\\\", "\\"))
def docs_snippet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tags.snippet(F.col("text")).alias("snippet"))


@query("""SELECT doc_id, item_id, CAST(position(lower(b.text) IN lower(d.text)) - 1 AS INT) AS at FROM documents d JOIN benchmark b ON b.text <> '' AND contains(lower(d.text), lower(b.text))""")
def bench_contained_in_docs(spark, sf):
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("entry"), F.lower("text").alias("key"))
    pairs = dictionary.contained_pairs(read(spark, sf, "documents").select("doc_id", F.lower("text").alias("low")), F.col("low"), items)
    return pairs.select("doc_id", F.col("entry").alias("item_id"), "at")


@query(f"""SELECT item_id, array_to_string(list(w ORDER BY i), ' ') AS keywords, count(*) AS n FROM (
  SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT item_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') AS ws FROM benchmark))
  WHERE length(w) >= 3 AND w NOT IN {tuple(matching.FILLERS)} GROUP BY item_id, w) GROUP BY item_id""")
def bench_keywords(spark, sf):
    rows = read(spark, sf, "benchmark").select("item_id", matching.keywords(F.col("text")).alias("k"))
    return rows.filter(F.size("k") > 0).select("item_id", F.array_join("k", " ").alias("keywords"), F.size("k").cast("long").alias("n"))


@query("""SELECT doc_id, CAST(contains(lower(text), 'erst') AS INT) + CAST(contains(lower(text), 'moron') AS INT) AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 24""")
def docs_prerank_topk(spark, sf):
    return preference.prerank(read(spark, sf, "documents").select("doc_id", "text"), "Erst, that: moron in the unit", F.lower("text"), "doc_id").select("doc_id", "hits")


@query("""WITH x AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE trim(lang) <> '') AS with_title, count(*) FILTER (WHERE d.doc_id % 3 <> 0) AS with_price, count(*) FILTER (WHERE d.doc_id % 3 = 0) AS price_unparsed,
  count(*) FILTER (WHERE quality = 1) AS with_location, count(*) FILTER (WHERE toxic IS NOT NULL) AS detail_depth FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source),
s AS (SELECT source, sum(n - 1) AS duplicate_ids FROM (SELECT source, sha256(lower(text)) AS k, count(*) AS n FROM documents GROUP BY ALL) WHERE k <> '' GROUP BY source)
SELECT x.source, total, with_price, price_unparsed, with_location, detail_depth, total - detail_depth AS card_depth, CAST(duplicate_ids AS BIGINT) AS duplicate_ids,
  array_to_string(list_filter(['error:missing_original_url', CASE WHEN with_title < total THEN 'error:missing_title' END, CASE WHEN duplicate_ids > 0 THEN 'error:duplicate_source_listing_id' END, CASE WHEN with_price < 0.6 * total THEN 'warning:low_price_coverage' END,
    CASE WHEN price_unparsed > 0.1 * total THEN 'warning:price_parse_failures' END, CASE WHEN with_location < 0.6 * total THEN 'warning:low_location_coverage' END, CASE WHEN detail_depth >= 10 THEN 'warning:low_photo_coverage' END], lambda c: c IS NOT NULL), ' ') AS issues
FROM x JOIN s ON x.source = s.source""")
def docs_coverage_contract(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None)
    batch = rows.select(
        "source", none.cast("string").alias("original_url"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("double")).alias("price_monthly"), F.lit("ask").alias("price_raw"),
        F.when(F.col("quality") == 1, "somewhere").alias("neighborhood"), none.cast("string").alias("address_raw"), none.cast("double").alias("latitude"), none.cast("double").alias("longitude"),
        F.array().cast("array<string>").alias("photos"), F.col("text").alias("description"), F.when(F.col("toxic").isNotNull(), "detail").otherwise("card").alias("fetch_depth"), F.sha2(F.lower("text"), 256).alias("source_listing_id"),
    )
    found = quality.profile(batch, ["source"])
    return found.select("source", "total", "with_price", "price_unparsed", "with_location", "detail_depth", "card_depth", "duplicate_ids", F.array_join(quality.issues(), " ").alias("issues"))


@query("""SELECT d.doc_id, l.doc_id IS NULL OR toxic = 1 OR quality = 0 OR n_chars % 2 = 0 AS need FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def docs_incremental_needed(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("h"), F.col("n_chars")).alias("content_hash"), "n_chars")
    labels = read(spark, sf, "labels").join(docs.select("doc_id", "n_chars"), "doc_id", "left")
    prior = labels.select("doc_id", F.when(F.col("n_chars") % 2 == 1, F.concat(F.lit("h"), "n_chars")).otherwise("old").alias("content_hash"), F.when(F.col("quality") == 0, 1).otherwise(2).alias("version"), F.when(F.col("toxic") == 1, "failed").alias("error"))
    return incremental.needs_work(docs, prior, "doc_id", "content_hash", 2).select("doc_id", "need")


# Text parsers


_P = PHRASE_SQL.format("o_orderkey")
_NUM = r"CASE WHEN {0} BETWEEN {1} AND {2} THEN {0} END"


def _between(e: str, low: float, high: float) -> str:
    return f"CASE WHEN {e} BETWEEN {low} AND {high} THEN {e} END"


_EXTRACT = lambda e, r, t: f"TRY_CAST(nullif(regexp_extract({e}, '{r}', 1), '') AS {t})"


@query(f"""WITH t AS (SELECT o_orderkey, {_P} AS d FROM orders)
SELECT o_orderkey, {_between(_EXTRACT("replace(d, ',', '')", r"\$?\s*(\d{3,6})(?:\.\d{1,2})?", "DOUBLE"), 100, 100000)} AS price,
  CASE WHEN regexp_matches(lower(d), '\\bstudio\\b') THEN 0 ELSE {_between(_EXTRACT("lower(d)", r"(\d+(?:\.\d+)?)\s*(?:br|bd|bed(?:room)?s?)\b", "DOUBLE"), 0, 12)} END AS bedrooms,
  CASE WHEN NOT regexp_matches(lower(d), '\\b(shared|split)\\s*ba') THEN {_between(_EXTRACT("lower(d)", r"(\d+(?:\.\d+)?)\s*(?:ba(?:th(?:room)?s?)?)\b", "DOUBLE"), 0.001, 12)} END AS bathrooms,
  {_between(_EXTRACT("replace(d, ',', '')", r"(?i)(\d{2,5})\s*(?:ft2|ft²|sq\.?\s*ft\.?|sqft|square\s*feet)", "INTEGER"), 80, 20000)} AS square_feet,
  CASE WHEN regexp_matches(lower(d), 'month[- ]to[- ]month') THEN 1 ELSE {_between(_EXTRACT("lower(d)", r"(\d{1,2})\s*[- ]?months?", "INTEGER"), 1, 36)} END AS lease_months FROM t""")
def parse_numbers(spark, sf):
    d = phrase(F.col("o_orderkey"))
    return read(spark, sf, "orders").select(
        "o_orderkey", listing_text.parse_price(d).alias("price"), listing_text.parse_bedrooms(d).alias("bedrooms"), listing_text.parse_bathrooms(d).alias("bathrooms"),
        listing_text.parse_square_feet(d).alias("square_feet"), listing_text.lease_term_months(d).alias("lease_months"),
    )


_M = lambda r: f"regexp_matches(d, '{r}')"
_OK = r" (are )?(ok|okay|welcome|allowed"


@query(rf"""WITH t AS (SELECT o_orderkey, lower({_P}) AS d FROM orders),
p AS (SELECT *, {_M(r"\bno pets\b|\bpets?[^a-z]{0,3}not allowed\b|\bpet[- ]free\b")} AS refused, {_M(r"\bpets?" + _OK + r"|friendly)\b|\bpet[- ]friendly\b")} AS pets, {_M(r"\bcats?" + _OK + r")\b|\bcat[- ]friendly\b")} AS cats,
  {_M(r"\bdogs?" + _OK + r")\b|\bdog[- ]friendly\b")} AS dogs, {_M(r"\bcats? only\b")} AS only_cats, {_M(r"\bno dogs\b")} AS no_dogs, {_M(r"\bno cats\b")} AS no_cats,
  nullif(trim(regexp_extract(d, '\b(small dogs?( only)?( under \d+ ?lbs?)?|dogs? under \d+ ?lbs?|one dog max|breed restrictions?[^.,;]*)', 1)), '') AS lim FROM t)
SELECT o_orderkey, CASE WHEN refused THEN false WHEN only_cats THEN true WHEN no_cats THEN false WHEN cats OR pets THEN true END AS cats_allowed,
  CASE WHEN refused THEN false WHEN only_cats THEN false WHEN no_dogs THEN false WHEN dogs OR pets THEN true WHEN lim IS NOT NULL THEN true END AS dogs_allowed, CASE WHEN NOT refused THEN lim END AS dog_restrictions_raw,
  CASE WHEN {_M(r"\bno laundry\b")} THEN 'none' WHEN {_M(r"\b(w/d in unit|washer\s*/?\s*dryer in unit|in[- ]unit (laundry|washer)|laundry in unit)\b")} THEN 'in_unit'
    WHEN {_M(r"\b(laundry (in bldg|in building|on site|on-site|room)|shared laundry|coin[- ]op|laundry facilities)\b")} THEN 'in_building' WHEN {_M(r"\b(w/d hookups?|washer\s*/?\s*dryer hookups?|laundry hookups?)\b")} THEN 'hookups' END AS laundry,
  CASE WHEN {_M(r"\b(garage|valet parking)\b")} THEN 'garage' WHEN {_M(r"\b(off[- ]street|carport|driveway|assigned parking|parking included|parking available|parking spot)\b")} THEN 'off_street'
    WHEN {_M(r"\bstreet parking\b")} THEN 'street' WHEN {_M(r"\bno parking\b")} THEN 'none' END AS parking FROM p""")
def parse_policies(spark, sf):
    d = phrase(F.col("o_orderkey"))
    rows = read(spark, sf, "orders").select("o_orderkey", listing_text.parse_pet_policy(d).alias("p"), listing_text.normalize_laundry(d).alias("laundry"), listing_text.normalize_parking(d).alias("parking"))
    return rows.select("o_orderkey", "p.*", "laundry", "parking")


@query(rf"""WITH t AS (SELECT o_orderkey, o_totalprice, {_P} AS d FROM orders),
w AS (SELECT *, nullif(trim(regexp_extract(d, '(?i)(\d+(?:\.\d+)?\s*(?:months?|weeks?)\s+free(?:\s+rent)?[^.!\n]*|move[- ]in special[^.!\n]*|\$\d[\d,]*\s+off[^.!\n]*)', 0)), '') AS concession,
  nullif(regexp_extract(lower(d), '(\d+(?:\.\d+)?|one|two|three|four|six)\s*months? free', 1), '') AS m, nullif(regexp_extract(lower(d), '(\d+(?:\.\d+)?|one|two|three|four|six)\s*weeks? free', 1), '') AS k FROM t),
n AS (SELECT *, coalesce(CASE m WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'six' THEN 6 ELSE TRY_CAST(m AS DOUBLE) END, CASE k WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'six' THEN 6 ELSE TRY_CAST(k AS DOUBLE) END / 4.345::DOUBLE) AS free FROM w)
SELECT o_orderkey, concession, CASE WHEN o_totalprice <> 0 AND free > 0 AND free < 12 THEN floor(o_totalprice * (12 - free) / 12 + 0.5) END AS effective,
  coalesce(nullif(regexp_extract(d, '(?i)(?:#\s?|\bunit\s+#?)([A-Za-z]?\d{{1,4}}(?:-\d{{1,4}})?[A-Za-z]{{0,2}})\b', 1), ''), nullif(regexp_extract(d, '^\d+\s+[A-Za-z][^-–#]{{2,40}}[-–]\s*([A-Za-z]?\d{{1,4}}(?:-\d{{1,4}})?[A-Za-z]{{0,2}})\s*$', 1), '')) AS unit FROM n""")
def effective_price(spark, sf):
    d = phrase(F.col("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", listing_text.extract_concessions(d).alias("concession"), listing_text.effective_monthly(F.col("o_totalprice"), d).alias("effective"), listing_text.unit_from_title(d).alias("unit"))


# The parsers over whole documents, each with one of the phrases in front of it.

_DOC = PHRASE_SQL.format("doc_id") + " || chr(10) || coalesce(text, '')"


def _texts(spark, sf):
    return read(spark, sf, "documents").withColumn("d", F.concat(phrase(F.col("doc_id")), F.lit("\n"), F.coalesce("text", F.lit(""))))


def _over_documents(name: str) -> str:
    """The SQL of a query over phrases, over documents."""
    sql = ORACLE[name].replace(_P, _DOC).replace("o_orderkey", "doc_id").replace("o_totalprice", "n_chars")
    return sql.replace("FROM orders", "FROM documents")


@query(_over_documents("parse_numbers"))
def docs_parse_numbers(spark, sf):
    d = F.col("d")
    return _texts(spark, sf).select("doc_id", listing_text.parse_price(d).alias("price"), listing_text.parse_bedrooms(d).alias("bedrooms"), listing_text.parse_bathrooms(d).alias("bathrooms"), listing_text.parse_square_feet(d).alias("square_feet"), listing_text.lease_term_months(d).alias("lease_months"))


@query(_over_documents("parse_policies"))
def docs_parse_policies(spark, sf):
    d = F.col("d")
    rows = _texts(spark, sf).select("doc_id", listing_text.parse_pet_policy(d).alias("p"), listing_text.normalize_laundry(d).alias("laundry"), listing_text.normalize_parking(d).alias("parking"))
    return rows.select("doc_id", "p.*", "laundry", "parking")


@query(_over_documents("effective_price"))
def docs_effective_price(spark, sf):
    d = F.col("d")
    return _texts(spark, sf).select("doc_id", listing_text.extract_concessions(d).alias("concession"), listing_text.effective_monthly(F.col("n_chars").cast("double"), d).alias("effective"), listing_text.unit_from_title(d).alias("unit"))


@query(_over_documents("order_risk_rules"))
def docs_risk_rules(spark, sf):
    none = F.lit(None).cast("string")
    verdict = risk.assess(none, F.col("d"), F.lit(None).cast("double"), none.cast("int"), none.cast("double"), none, F.lit("somewhere"), none.cast("double"), F.when(F.col("n_chars") < 1000, 0).otherwise(3), none.cast("double"), F.lit(False), F.lit(False))
    return _texts(spark, sf).withColumn("r", verdict).select("doc_id", "r.level", F.array_join("r.warnings", "; ").alias("warnings"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <> 0 AND l_quantity > 0 THEN floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 END AS per_unit FROM lineitem")
def price_per_unit(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", listing_text.price_per_square_foot(F.col("l_extendedprice"), F.col("l_quantity")).alias("per_unit"))


_STREETS = ["Street", "Av.", "Boulevard", "North Point", "Third Terrace", "ninth Avenue"]


@query(f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(a), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '\\b(street)\\b', 'st'), '\\b(avenue|av)\\b', 'ave'))
    .regexp_replace('\\bboulevard\\b', 'blvd').regexp_replace('\\bterrace\\b', 'ter') || CASE WHEN c_custkey % 3 = 0 THEN '|' || regexp_replace(lower('#' || c_custkey || '-B'), '[^a-z0-9]', '', 'g') ELSE '' END AS address_key,
  regexp_replace(regexp_replace(a, '(?i)\\bthird\\b', '3rd', 'g'), '(?i)\\bninth\\b', '9th', 'g') AS geocoder_text
FROM (SELECT c_custkey, c_custkey || ' ' || c_name || ', ' || {_sql_list(_STREETS)}[CAST(c_custkey % 6 AS INT) + 1] AS a FROM customer)""")
def address_keys(spark, sf):
    street = F.element_at(F.array(*map(F.lit, _STREETS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    address = F.concat_ws("", F.col("c_custkey").cast("string"), F.lit(" "), "c_name", F.lit(", "), street)
    unit = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("#"), F.col("c_custkey").cast("string"), F.lit("-B")))
    return read(spark, sf, "customer").select("c_custkey", listing_text.address_key(address, unit).alias("address_key"), listing_text.street_ordinals(address).alias("geocoder_text"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN p_retailprice < 1000 THEN CASE WHEN p_retailprice > 0 THEN 'price:under-1k' END ELSE 'price:' || CAST(floor(p_retailprice / 1000) AS BIGINT) || 'k-' || (CAST(floor(p_retailprice / 1000) AS BIGINT) + 1) || 'k' END AS band FROM part""")
def slug_and_band(spark, sf):
    return read(spark, sf, "part").select("p_partkey", hashes.slug(F.col("p_type")).alias("slug"), tags.price_band(F.col("p_retailprice")).alias("band"))


# Baselines, matching and digests


@query("""SELECT p_brand AS area, p_size AS beds, median(p_retailprice) AS median_price, count(*) AS n FROM part GROUP BY p_brand, p_size HAVING count(*) >= 8
UNION ALL SELECT NULL, p_size, median(p_retailprice), count(*) FROM part GROUP BY p_size HAVING count(*) >= 8""")
def baseline_median(spark, sf):
    return risk.baselines(read(spark, sf, "part"), "p_brand", "p_size", "p_retailprice")


@query("""WITH b AS (SELECT p_brand, p_type, median(p_retailprice) AS m, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 8), c AS (SELECT p_type, median(p_retailprice) AS m FROM part GROUP BY p_type HAVING count(*) >= 8)
SELECT p_partkey, coalesce(b.m, c.m) AS baseline, p_retailprice < 0.95::DOUBLE * coalesce(b.m, c.m) AS low FROM part p LEFT JOIN b ON p.p_brand = b.p_brand AND p.p_type = b.p_type LEFT JOIN c ON p.p_type = c.p_type""")
def price_below_baseline(spark, sf):
    parts = read(spark, sf, "part")
    medians = risk.baselines(parts, "p_brand", "p_type", "p_retailprice")
    local, city = medians.filter("area is not null"), medians.filter("area is null").select(F.col("beds").alias("p_type"), F.col("median_price").alias("city"))
    met = parts.join(local.select(F.col("area").alias("p_brand"), F.col("beds").alias("p_type"), "median_price"), ["p_brand", "p_type"], "left").join(city, "p_type", "left")
    return met.withColumn("baseline", F.coalesce("median_price", "city")).select("p_partkey", "baseline", (F.col("p_retailprice") < 0.95 * F.col("baseline")).alias("low"))


def _listings(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return parts.select(
        k.cast("string").alias("listing_id"), F.when(k % 7 != 0, F.col("p_retailprice")).alias("price_monthly"), F.lit(None).cast("double").alias("price_effective_monthly"),
        F.when(k % 5 != 0, (k % 4).cast("double")).alias("bedrooms"), F.when(k % 11 != 0, F.col("p_brand")).alias("neighborhood"), F.when(k % 3 == 0, k % 2 == 0).alias("cats_allowed"),
        F.element_at(F.array(F.lit("in_unit"), F.lit("none"), F.lit("unknown")), (k % 3 + 1).cast("int")).alias("laundry_normalized"), F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.when(k % 9 == 0, "hidden").alias("user_status"), F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("first_seen_at"),
    )


def _searches(spark: SparkSession) -> DataFrame:
    rows = [("s1", 900.0, 1400.0, 1.0, ["Brand#1", "brand#2"], None, None, None), ("s2", None, 1200.0, None, None, True, ["in_unit"], None), ("s3", None, None, 2.0, None, None, None, "part with 12, please")]
    return spark.createDataFrame(rows, "search_id string, min_price double, max_price double, min_bedrooms double, neighborhoods array<string>, require_cats_allowed boolean, laundry array<string>, query string")


_EVAL_SQL = """WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 4 AS DOUBLE) END AS beds, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS hood,
    CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS cats, ['in_unit', 'none', 'unknown'][CAST(p_partkey % 3 AS INT) + 1] AS laundry, lower(p_name || chr(10) || p_type) AS t, p_partkey % 9 = 0 AS hidden FROM part),
s AS (SELECT * FROM (VALUES ('s1', 900.0::DOUBLE, 1400.0::DOUBLE, 1.0::DOUBLE, ['brand#1', 'brand#2'], false, false, NULL), ('s2', NULL, 1200.0, NULL, NULL, true, true, NULL), ('s3', NULL, NULL, 2.0, NULL, false, false, ['part', '12'])) v(search_id, lo, hi, minbeds, hoods, cat, lau, words)),
n AS (SELECT *, CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS ptext FROM l),
e AS (SELECT s.search_id, CAST(k AS VARCHAR) AS listing_id, NOT hidden AS eligible,
  list_filter([CASE WHEN (lo IS NOT NULL OR hi IS NOT NULL) AND price IS NULL THEN 'price:unknown' END, CASE WHEN price < lo THEN 'price:below_min($' || ptext || ')' END, CASE WHEN price > hi THEN 'price:above_max($' || ptext || ')' END,
    CASE WHEN beds < minbeds THEN 'bedrooms:below_min' END, CASE WHEN hoods IS NOT NULL AND hood IS NOT NULL AND NOT list_contains(hoods, lower(hood)) THEN 'neighborhood:' || hood END, CASE WHEN cat AND NOT cats THEN 'cats:not_allowed' END,
    CASE WHEN lau AND laundry = 'none' THEN 'laundry:none' END, CASE WHEN words IS NOT NULL AND NOT contains(t, 'part') THEN 'missing_keyword:part' END], lambda x: x IS NOT NULL) AS failed,
  list_filter([CASE WHEN minbeds IS NOT NULL AND beds IS NULL THEN 'bedrooms' END, CASE WHEN hoods IS NOT NULL AND hood IS NULL THEN 'neighborhood' END, CASE WHEN cat AND cats IS NULL THEN 'cat_policy' END, CASE WHEN lau AND laundry = 'unknown' THEN 'laundry' END], lambda x: x IS NOT NULL) AS unknowns
  FROM n CROSS JOIN s)"""


@query(_EVAL_SQL + " SELECT search_id, listing_id, eligible, eligible AND len(failed) = 0 AS matched, array_to_string(failed, ' ') AS failed, array_to_string(unknowns, ' ') AS unknowns FROM e")
def criteria_eval(spark, sf):
    searches, listings = _searches(spark), _listings(read(spark, sf, "part"))
    wanted = listings.select("listing_id", F.explode(F.array(*map(F.lit, ("s1", "s2", "s3")))).alias("search_id"))
    rows = subscriptions.explain_pairs(wanted, searches, listings).select("search_id", "listing_id", "result.*")
    return rows.select("search_id", "listing_id", "eligible", "matched", F.array_join("failed", " ").alias("failed"), F.array_join("unknowns", " ").alias("unknowns"))


@query(_EVAL_SQL + " SELECT search_id, count(*) FILTER (WHERE eligible AND len(failed) = 0 AND NOT list_contains(unknowns, 'neighborhood')) AS matches FROM e GROUP BY search_id")
def watched_counts(spark, sf):
    return views.watched_searches(_searches(spark), _listings(read(spark, sf, "part")), F.lit("2024-01-01").cast("timestamp")).select("search_id", "matches")


def _customer_searches(spark, sf):
    """A saved search of each customer, with criteria of its own."""
    k, low = F.col("c_custkey"), F.lit(900.0) + F.abs("c_acctbal") / 100
    brand = lambda n: F.concat(F.lit("brand#"), (F.col("c_nationkey") + n).cast("string"))
    return read(spark, sf, "customer").select(
        k.cast("string").alias("search_id"), F.when(F.col("c_acctbal") > 0, low).alias("min_price"), F.when(F.col("c_mktsegment") != "FURNITURE", low + 8).alias("max_price"),
        F.when(k % 3 == 0, (k % 4).cast("double")).alias("min_bedrooms"), F.when(k % 5 == 0, 2.0).alias("max_bedrooms"), F.when(F.col("c_mktsegment") != "BUILDING", F.array(brand(0), brand(1), brand(2))).alias("neighborhoods"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("require_cats_allowed"), F.when(k % 2 == 0, F.array(F.lit("in_unit"))).alias("laundry"), F.when(k % 7 == 0, F.array(F.lit("RED"))).alias("exclude_keywords"),
    )


@query("""WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 4 AS DOUBLE) END AS beds, CASE WHEN p_partkey % 11 <> 0 THEN lower(p_brand) END AS hood,
    CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS cats, ['in_unit', 'none', 'unknown'][CAST(p_partkey % 3 AS INT) + 1] AS laundry, lower(p_name || chr(10) || p_type) AS t, p_partkey % 9 = 0 AS hidden FROM part),
c AS (SELECT c_custkey, 900.0::DOUBLE + abs(c_acctbal) / 100 AS low, c_acctbal, c_mktsegment, c_nationkey AS n FROM customer),
s AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN low END AS lo, CASE WHEN c_mktsegment <> 'FURNITURE' THEN low + 8 END AS hi, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS least, CASE WHEN c_custkey % 5 = 0 THEN 2 END AS most,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN ['brand#' || n, 'brand#' || (n + 1), 'brand#' || (n + 2)] END AS hoods, c_mktsegment = 'HOUSEHOLD' AS cat, c_custkey % 2 = 0 AS lau, c_custkey % 7 = 0 AS red FROM c)
SELECT CAST(c_custkey AS VARCHAR) AS search_id, CAST(k AS VARCHAR) AS listing_id, array_to_string(list_filter([CASE WHEN (least IS NOT NULL OR most IS NOT NULL) AND beds IS NULL THEN 'bedrooms' END, CASE WHEN hoods IS NOT NULL AND hood IS NULL THEN 'neighborhood' END,
  CASE WHEN cat AND cats IS NULL THEN 'cat_policy' END, CASE WHEN lau AND laundry = 'unknown' THEN 'laundry' END], lambda x: x IS NOT NULL), ' ') AS unknowns
FROM s JOIN l ON NOT hidden AND (lo IS NULL AND hi IS NULL OR price IS NOT NULL) AND coalesce(price >= lo, true) AND coalesce(price <= hi, true) AND coalesce(beds >= least, true) AND coalesce(beds <= most, true) AND (hoods IS NULL OR hood IS NULL OR list_contains(hoods, hood))
  AND NOT (cat AND coalesce(NOT cats, false)) AND NOT (lau AND laundry = 'none') AND NOT (red AND contains(t, 'red'))""")
def saved_search_matches(spark, sf):
    rows = subscriptions.match_searches(_customer_searches(spark, sf), _listings(read(spark, sf, "part")))
    return rows.select("search_id", "listing_id", F.array_join("result.unknowns", " ").alias("unknowns"))


_DIGEST_SQL = """WITH c AS (SELECT o_custkey, o_orderstatus AS s, min(o_totalprice) AS price FROM orders WHERE o_orderdate >= DATE '1995-06-01' GROUP BY ALL), p AS (SELECT o_custkey, o_orderstatus AS s, min(o_totalprice) AS price FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY ALL)
SELECT coalesce(c.s, p.s) AS search_id, CAST(coalesce(c.o_custkey, p.o_custkey) AS VARCHAR) AS listing_id, c.price,
  CASE WHEN c.s IS NOT NULL AND (p.s IS NULL OR p.o_custkey % 5 = 0) THEN 'new' WHEN c.s IS NOT NULL AND c.price < p.price THEN 'price_drop' WHEN c.s IS NOT NULL THEN 'unchanged' WHEN p.o_custkey % 4 <> 0 THEN 'dropped_out' ELSE 'gone' END AS kind
FROM c FULL JOIN p ON c.o_custkey = p.o_custkey AND c.s = p.s"""


def _digest(spark, sf):
    orders = read(spark, sf, "orders")
    keys = [F.col("o_orderstatus").alias("search_id"), F.col("o_custkey").cast("string").alias("listing_id")]
    side = lambda cond: orders.filter(cond).groupBy(*keys, "o_custkey").agg(F.min("o_totalprice").alias("price"))
    late = F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")
    prior = side(~late).select("search_id", "listing_id", (F.col("o_custkey") % 4 != 0).alias("still_matching"), F.when(F.col("o_custkey") % 5 != 0, F.lit("1995-06-01")).alias("notified_at"), F.col("price").alias("notified_price"))
    return matching.digest(side(late).drop("o_custkey"), prior)


@query(_DIGEST_SQL)
def digest_diff(spark, sf):
    return _digest(spark, sf).select("search_id", "listing_id", "price", "kind")


@query(f"SELECT count(*) FILTER (WHERE kind = 'new') AS n_new, count(*) FILTER (WHERE kind = 'price_drop') AS n_price_drop, count(*) FILTER (WHERE kind = 'unchanged') AS n_unchanged, count(*) FILTER (WHERE kind = 'dropped_out') AS n_dropped_out FROM ({_DIGEST_SQL})")
def digest_totals(spark, sf):
    return views.digest_totals(_digest(spark, sf))


# Merge, liveness and runs


def _merged(spark, sf):
    events = read(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    detail = ["description"]
    none = F.lit(None)
    shape = lambda df, *more: df.select(
        F.lit("src").alias("source_id"), F.col("user_id").cast("string").alias("source_listing_id"), F.col("value").alias("price_monthly"), none.cast("double").alias("price_effective_monthly"), none.cast("string").alias("price_raw"),
        F.col("event_type").alias("title"), none.cast("string").alias("neighborhood"), F.lit("active").alias("listing_status"), F.sha2(F.col("event_type"), 256).alias("content_hash"), none.cast("double").alias("latitude"),
        none.cast("double").alias("longitude"), none.cast("string").alias("geocode_precision"), F.array().cast("array<string>").alias("photos"), F.col("props").alias("description"), *more,
    )
    batch = shape(events.filter("day > 1"), F.when(F.col("event_id") % 2 == 0, "detail").otherwise("card").alias("fetch_depth"), F.col("event_id").alias("batch_pos"))
    old = latest.latest_per_key(events.filter("day = 1"), ["user_id"], ["event_id"])
    now = F.lit("2024-01-16").cast("timestamp")
    snapshot = shape(old, F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("listing_id"), F.lit("2024-01-01").cast("timestamp").alias("first_seen_at"), F.lit("2024-01-15").cast("timestamp").alias("last_seen_at"),
        F.when(F.col("user_id") % 2 == 0, "missing_once").otherwise("active").alias("stale_status"), none.cast("timestamp").alias("missing_since"), none.cast("timestamp").alias("detail_fetched_at"), none.cast("string").alias("run_id"))
    return merge.merge_batch(snapshot, merge.fold_batch(batch, detail), now, F.lit("r2"), detail), now


_MERGE_SQL = """WITH b AS (SELECT user_id, arg_max(value, event_id) AS price, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) FILTER (WHERE event_id % 2 = 0) AS props, bool_or(event_id % 2 = 0) AS detail FROM events WHERE day(ts) > 1 GROUP BY user_id),
o AS (SELECT user_id, arg_max(value, event_id) AS price, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) AS props FROM events WHERE day(ts) = 1 GROUP BY user_id),
m AS (SELECT coalesce(b.user_id, o.user_id) AS user_id, b.user_id IS NOT NULL AS seen, o.user_id IS NOT NULL AS known, o.price AS old_price, coalesce(b.price, o.price) AS price, coalesce(b.kind, o.kind) AS kind, o.kind AS old_kind, b.detail,
  CASE WHEN o.user_id IS NULL OR b.detail THEN coalesce(b.props, o.props) ELSE o.props END AS props FROM b FULL JOIN o ON b.user_id = o.user_id),
c AS (SELECT *, coalesce(known AND seen AND old_price <> price, false) AS pc, coalesce(known AND seen AND detail AND old_kind <> kind, false) AS hc FROM m)"""


@query(_MERGE_SQL + """ SELECT CAST(user_id AS VARCHAR) AS source_listing_id, price AS price_monthly, kind AS title, props AS description, CASE WHEN seen THEN 'active' WHEN user_id % 2 = 0 THEN 'missing_once' ELSE 'active' END AS stale_status,
  CASE WHEN NOT seen THEN NULL WHEN NOT known THEN 'new' WHEN pc OR hc THEN 'changed' ELSE 'unchanged' END AS kind FROM c""")
def merge_snapshot(spark, sf):
    return _merged(spark, sf)[0].select("source_listing_id", "price_monthly", "title", "description", "stale_status", "change.kind")


@query(_MERGE_SQL + """, t AS (SELECT *, CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS ptext, CASE WHEN old_price = floor(old_price) THEN CAST(CAST(old_price AS BIGINT) AS VARCHAR) ELSE CAST(old_price AS VARCHAR) END AS otext FROM c WHERE seen)
SELECT CAST(user_id AS VARCHAR) AS source_listing_id, 'first_seen' AS event_type, NULL AS old_value, ptext AS new_value FROM t WHERE NOT known
UNION ALL SELECT CAST(user_id AS VARCHAR), 'reappeared', 'missing_once', 'active' FROM t WHERE known AND user_id % 2 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), 'price_change', otext, ptext FROM t WHERE pc
UNION ALL SELECT CAST(user_id AS VARCHAR), 'content_change', sha256(old_kind), sha256(kind) FROM t WHERE hc AND NOT pc""")
def merge_events(spark, sf):
    merged, now = _merged(spark, sf)
    events = merge.events_of(merged, now, F.lit("r2"))
    return events.join(merged.select("listing_id", "source_listing_id"), "listing_id").select("source_listing_id", "event_type", "old_value", "new_value")


@query(_MERGE_SQL + " SELECT CAST(user_id AS VARCHAR) AS source_listing_id, price AS price_monthly FROM c WHERE (seen AND NOT known) OR pc")
def price_history(spark, sf):
    merged, now = _merged(spark, sf)
    return merge.price_observations(merged, now, F.lit("r2")).join(merged.select("listing_id", "source_listing_id"), "listing_id").select("source_listing_id", "price_monthly")


def _merge_table(spark, sf):
    """The events of a month as three batches, merged one after the other into a table of its own."""
    events = read(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    none = F.lit(None)
    rows = events.select(
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("source_id"), F.col("user_id").cast("string").alias("source_listing_id"), F.col("value").alias("price_monthly"), none.cast("double").alias("price_effective_monthly"), none.cast("string").alias("price_raw"),
        F.col("event_type").alias("title"), none.cast("string").alias("neighborhood"), F.lit("active").alias("listing_status"), F.sha2(F.col("event_type"), 256).alias("content_hash"), none.cast("double").alias("latitude"),
        none.cast("double").alias("longitude"), none.cast("string").alias("geocode_precision"), F.array().cast("array<string>").alias("photos"), F.col("props").alias("description"),
        F.when(F.col("event_id") % 2 == 0, "detail").otherwise("card").alias("fetch_depth"), F.col("event_id").alias("batch_pos"), F.least(F.floor((F.col("day") - 1) / 10), F.lit(2)).alias("part"),
    )
    kept = "listing_id string, first_seen_at timestamp, last_seen_at timestamp, stale_status string, missing_since timestamp, detail_fetched_at timestamp, run_id string"
    schema = StructType([*rows.drop("fetch_depth", "batch_pos", "part").schema.fields, *spark.createDataFrame([], kept).schema.fields])
    table = MergeTable(spark, f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}", schema, ["description"])
    for part in range(3):
        table.merge(rows.filter(F.col("part") == part).drop("part"), f"part {part}", F.lit(f"2024-01-{part + 1}1").cast("timestamp"), F.lit(f"r{part}"))
    return table


_PARTS_SQL = """WITH b AS (SELECT user_id, LEAST((day(ts) - 1) // 10, 2) AS part, arg_max(value, event_id) AS price, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) FILTER (WHERE event_id % 2 = 0) AS props, bool_or(event_id % 2 = 0) AS detail FROM events GROUP BY ALL),
w AS (SELECT *, lag(price) OVER u AS old_price, lag(part) OVER u IS NOT NULL AS known, last_value(CASE WHEN detail THEN kind ELSE CASE WHEN first_of THEN kind END END IGNORE NULLS) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_kind
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part) = 1 AS first_of FROM b) WINDOW u AS (PARTITION BY user_id ORDER BY part)),
c AS (SELECT *, coalesce(known AND old_price <> price, false) AS pc, coalesce(known AND detail AND old_kind <> kind, false) AS hc FROM w)"""


@query(_PARTS_SQL + """ SELECT 's' || (user_id % 10) AS source_id, CAST(user_id AS VARCHAR) AS source_listing_id, arg_max(price, part) AS price_monthly, arg_max(kind, part) AS title, arg_max(props, part) FILTER (WHERE props IS NOT NULL) AS description,
  'r' || max(part) AS run_id, TIMESTAMP '2024-01-01' + INTERVAL (min(part) * 10 + 10) DAY AS first_seen_at, TIMESTAMP '2024-01-01' + INTERVAL (max(part) * 10 + 10) DAY AS last_seen_at FROM c GROUP BY user_id""")
def merge_table(spark, sf):
    return _merge_table(spark, sf).read().select("source_id", "source_listing_id", "price_monthly", "title", "description", "run_id", "first_seen_at", "last_seen_at")


@query(_PARTS_SQL + """, e AS (SELECT part, 'first_seen' AS event_type FROM c WHERE NOT known UNION ALL SELECT part, 'price_change' FROM c WHERE pc UNION ALL SELECT part, 'content_change' FROM c WHERE hc AND NOT pc)
SELECT 'r' || part AS run_id, event_type, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'r' || part, 'price row', count(*) FROM c WHERE NOT known OR pc GROUP BY part
UNION ALL SELECT 'r' || part, 'new', count(*) FILTER (WHERE NOT known) FROM c GROUP BY part UNION ALL SELECT 'r' || part, 'changed', count(*) FILTER (WHERE pc OR hc) FROM c GROUP BY part UNION ALL SELECT 'r' || part, 'unchanged', count(*) FILTER (WHERE known AND NOT pc AND NOT hc) FROM c GROUP BY part""")
def merge_table_log(spark, sf):
    """Events, price rows and observed counters of each merge."""
    table = _merge_table(spark, sf)
    counted = lambda df, kind: df.groupBy("run_id", kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    seen = [(f"r{e['batch'][-1]}", k, e["counts"][f"n_{k}"]) for e in table.entries() for k in ("new", "changed", "unchanged")]
    return counted(table.events(), F.col("event_type")).unionByName(counted(table.prices(), F.lit("price row"))).unionByName(spark.createDataFrame(seen, "run_id string, event_type string, n long"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), d AS (SELECT user_id, max(CAST(ts AS DATE)) AS last FROM events GROUP BY user_id), m AS (SELECT max(CAST(ts AS DATE)) AS today FROM events)
SELECT user_id, CASE LEAST(date_diff('day', last, today), 3) WHEN 0 THEN 'active' WHEN 1 THEN 'missing_once' WHEN 2 THEN 'missing_multiple_runs' ELSE 'likely_unavailable' END AS status FROM d, m""")
def liveness_chain(spark, sf):
    days = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    today = days.agg(F.max("day").alias("today"))
    last = days.groupBy("user_id").agg(F.max("day").alias("last"))
    return last.join(F.broadcast(today), F.lit(True)).select("user_id", liveness.chain_after(F.datediff("today", "last")).alias("status"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf):
    return latest.latest_per_key(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 8")
def last_n_runs(spark, sf):
    return latest.top_per_key(read(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 8).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def _runs(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("started_at"), F.col("value").alias("listings_found"), F.when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))


_TREND_SQL = """WITH r AS (SELECT user_id, event_id, value, CASE event_type WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'success' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id AS source_id, count(*) AS runs, max(status) FILTER (WHERE n = 1) AS last_status, max(event_id) FILTER (WHERE status = 'success') AS last_success,
  CASE WHEN max(status) FILTER (WHERE n = 1) <> 'skipped' AND max(status) FILTER (WHERE n = 2) <> 'skipped' THEN max(value) FILTER (WHERE n = 1) - max(value) FILTER (WHERE n = 2) END AS trend FROM r WHERE n <= 8 GROUP BY user_id"""


@query(_TREND_SQL)
def run_trend(spark, sf):
    return latest.run_trend(_runs(spark, sf), "source_id", "started_at", "listings_found", "status").select("source_id", "runs", "last_status", "last_success", "trend")


@query(f"""WITH t AS ({_TREND_SQL}), c AS (SELECT l_suppkey, count(*) AS listings, count(*) FILTER (WHERE l_linestatus = 'O') AS active FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey AS source_id, coalesce(c.listings, 0) AS listings, coalesce(c.active, 0) AS active, t.trend, CASE WHEN s_suppkey % 10 = 0 THEN 'disabled' WHEN t.last_status IS NULL THEN 'never_run' WHEN t.last_status = 'failed' THEN 'failing' ELSE 'healthy' END AS health
FROM supplier LEFT JOIN c ON s_suppkey = l_suppkey LEFT JOIN t ON s_suppkey = t.source_id""")
def source_health(spark, sf):
    sources = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 10 != 0).alias("enabled"))
    listings = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.when(F.col("l_linestatus") == "O", "active").otherwise("gone").alias("listing_status"), F.lit("active").alias("stale_status"))
    return views.source_health(sources, listings, _runs(spark, sf)).select("source_id", "listings", "active", "trend", "health")


@query("SELECT event_id, ts > (SELECT ts FROM events ORDER BY ts DESC LIMIT 1 OFFSET 99) AS fresh FROM events")
def new_since_boundary(spark, sf):
    events = read(spark, sf, "events")
    return events.join(F.broadcast(latest.boundary(events, "ts", 100)), F.lit(True)).select("event_id", (F.col("ts") > F.col("boundary")).alias("fresh"))


# Costs, preferences, JSON


_COST = "floor((length(text) / 1e6::DOUBLE * 3 + length(role) / 1e6::DOUBLE * 15 + turn / 1e6::DOUBLE * 3 * 0.1::DOUBLE + conv_id / 1e6::DOUBLE * 3 * 1.25::DOUBLE) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"


def _costs(spark, sf):
    n = lambda c: F.col(c).cast("double")
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", incremental.cost_usd(F.length("text").cast("double"), F.length("role").cast("double"), n("turn"), n("conv_id")).alias("cost"))


@query(f"SELECT conv_id, count(*) AS turns, sum(CAST({_COST} * 1000000 AS BIGINT)) AS micro_usd FROM conversations GROUP BY conv_id")
def cost_estimate(spark, sf):
    return _costs(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum((F.col("cost") * 1_000_000).cast("decimal(20,0)").cast("long")).alias("micro_usd"))


@query("""SELECT o_custkey, o_orderkey, coalesce(sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300000 AS runs FROM orders""")
def cost_cap_cutoff(spark, sf):
    orders = read(spark, sf, "orders").withColumn("cost", F.round("o_totalprice").cast("long"))
    orders = orders.withColumn("cost", F.bround("o_totalprice").cast("long").cast("double"))
    return incremental.within_cap(orders, ["o_custkey"], ["o_orderkey"], "cost", 300000).select("o_custkey", "o_orderkey", "runs")


@query("""SELECT o_orderkey, coalesce(sum(CAST(o_totalprice AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent FROM orders""")
def cost_before_each(spark, sf):
    """One running sum over all orders."""
    orders = read(spark, sf, "orders").withColumn("cost", F.bround("o_totalprice").cast("long").cast("double"))
    return incremental.within_cap(orders, [], ["o_orderdate", "o_orderkey"], "cost", 1e9).select("o_orderkey", "spent")


_TAG_SQL = "SELECT p_partkey, p_brand, p_type, [regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), CASE WHEN p_size <= 30 THEN 'size:compact' ELSE 'size:large' END, 'beds:' || (p_size % 3)] AS tags FROM part"


def _tagged(spark, sf):
    parts = read(spark, sf, "part")
    return parts.select("p_partkey", "p_brand", "p_type", F.array(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), F.when(F.col("p_size") <= 30, "size:compact").otherwise("size:large"), F.concat(F.lit("beds:"), (F.col("p_size") % 3).cast("string"))).alias("tags"))


@query(f"WITH t AS ({_TAG_SQL}), n AS (SELECT count(*) AS total FROM t WHERE p_type = 'ECONOMY'), c AS (SELECT tag, count(*) AS count FROM (SELECT unnest(list_distinct(tags)) AS tag FROM t WHERE p_type = 'ECONOMY') GROUP BY tag) SELECT tag, count, total, count / total::DOUBLE AS strength FROM c, n WHERE total >= 3 AND count >= greatest(2, ceil(total * 0.4::DOUBLE))")
def curation_aversions(spark, sf):
    return preference.aversions(_tagged(spark, sf).filter("p_type = 'ECONOMY'"))


@query(f"""WITH t AS ({_TAG_SQL}), n AS (SELECT count(*) AS total FROM t WHERE p_type = 'ECONOMY'), a AS (SELECT tag, count(*) / max(total)::DOUBLE AS s FROM (SELECT unnest(list_distinct(tags)) AS tag FROM t WHERE p_type = 'ECONOMY'), n GROUP BY tag HAVING count(*) >= greatest(2, ceil(max(total) * 0.4::DOUBLE))),
x AS (SELECT p_partkey, p_brand, (SELECT count(*) FROM a WHERE list_contains(tags, a.tag)) AS shared, (SELECT count(*) FROM a WHERE list_contains(tags, a.tag) AND s >= 0.6) > 0 AS strong FROM t),
y AS (SELECT *, bool_and(strong) OVER (PARTITION BY p_brand) AS every FROM x)
SELECT p_partkey, p_brand, CAST(shared AS INT) AS shared, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY shared, p_partkey) AS INT) AS rank FROM y WHERE NOT strong OR every""")
def curated_rank(spark, sf):
    rows = _tagged(spark, sf)
    return preference.curate(rows, preference.aversions(rows.filter("p_type = 'ECONOMY'")), "p_brand", "p_partkey").select("p_partkey", "p_brand", "shared", "rank")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.path') AS missing FROM events")
def json_extract(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing.path").alias("missing"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_from_prose(spark, sf):
    fenced = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nDone."))
    loose = F.concat(F.lit("I think "), "props", F.lit(" fits."))
    answer = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, loose).otherwise("no object here")
    return read(spark, sf, "events").select("event_id", feeds.validated(answer, "struct<k:long>", ["k"])["k"].alias("k"))


# Geometry


_LAT, _LNG = "37.6 + (c_custkey % 100) * 0.003::DOUBLE", "-122.6 + (c_custkey % 37) * 0.008::DOUBLE"
_SQUARE = [[[[-122.5, 37.65], [-122.4, 37.65], [-122.4, 37.8], [-122.5, 37.8], [-122.5, 37.65]], [[-122.47, 37.7], [-122.43, 37.7], [-122.43, 37.75], [-122.47, 37.75], [-122.47, 37.7]]]]


def _points(spark, sf):
    return spread(read(spark, sf, "customer"), "c_custkey").select("c_custkey", (F.lit(37.6) + (F.col("c_custkey") % 100) * F.lit(0.003)).alias("latitude"), (F.lit(-122.6) + (F.col("c_custkey") % 37) * F.lit(0.008)).alias("longitude"))


@query(f"""SELECT c_custkey, floor(d * 100 + 0.5) / 100 AS km, d <= 10 AS near FROM (SELECT c_custkey, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS d FROM (SELECT c_custkey,
  pow(sin(radians(({_LAT}) - 37.7749::DOUBLE) / 2), 2) + cos(radians(37.7749::DOUBLE)) * cos(radians({_LAT})) * pow(sin(radians(({_LNG}) + 122.4194::DOUBLE) / 2), 2) AS a FROM customer))""")
def haversine_radius(spark, sf):
    km = geo.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.col("latitude"), F.col("longitude"))
    return _points(spark, sf).select("c_custkey", round_half_up(km, 2).alias("km"), (km <= 10).alias("near"))


@query(f"SELECT c_custkey, CASE WHEN y > 37.65 AND y < 37.8 AND x > -122.5 AND x < -122.4 AND NOT (y > 37.7 AND y < 37.75 AND x > -122.47 AND x < -122.43) THEN 'ring' END AS area FROM (SELECT c_custkey, {_LAT} + 0.0011::DOUBLE AS y, {_LNG} + 0.0007::DOUBLE AS x FROM customer)")
def point_in_polygon(spark, sf):
    shapes = spark.createDataFrame([("ring", 0, _SQUARE), ("later", 1, _SQUARE)], "name string, ord int, coordinates array<array<array<array<double>>>>")
    points = _points(spark, sf).withColumns({"latitude": F.col("latitude") + F.lit(0.0011), "longitude": F.col("longitude") + F.lit(0.0007)})
    return spatial.locate(points, shapes).select("c_custkey", "area")


@query(f"SELECT c_custkey FROM customer WHERE {_LAT} BETWEEN 37.69 AND 37.85 AND {_LNG} BETWEEN -122.55 AND -122.33")
def bbox_filter(spark, sf):
    return _points(spark, sf).filter(geo.in_box(F.col("latitude"), F.col("longitude"))).select("c_custkey")


_TRIANGLES_SQL = "SELECT *, 0.001::DOUBLE * (c_custkey % 7 + 1) AS w, 0.002::DOUBLE * (c_nationkey % 3 + 1) AS h FROM (SELECT c_custkey, c_nationkey, " + _LAT + " AS y, " + _LNG + " AS x FROM customer)"


@query(f"""SELECT c_custkey, round(LEAST(x, x - 1), 9) AS west, round(y, 9) AS south, round(x + w, 9) AS east, round(GREATEST(y + h, y + 0.0025::DOUBLE), 9) AS north, round(w * h / 2, 12) AS area,
  round(CASE WHEN w * h / 2 >= 0.000025::DOUBLE THEN x + w / 3 ELSE x - 1 + 0.005::DOUBLE END, 6) AS lng, round(CASE WHEN w * h / 2 >= 0.000025::DOUBLE THEN y + h / 3 ELSE y + 0.00125::DOUBLE END, 6) AS lat FROM ({_TRIANGLES_SQL})""")
def polygon_bounds(spark, sf):
    """Bounds of a shape of two polygons at every customer's place, the area of the first one and the centroid of the larger one."""
    x, y = F.col("longitude"), F.col("latitude")
    w, h = F.lit(0.001) * (F.col("c_custkey") % 7 + 1), F.lit(0.002) * (F.col("c_nationkey") % 3 + 1)
    at = lambda a, b: F.array(a, b)
    triangle = F.array(at(x, y), at(x + w, y), at(x, y + h), at(x, y))
    bar = F.array(at(x - 1, y), at(x - 1 + F.lit(0.01), y), at(x - 1 + F.lit(0.01), y + F.lit(0.0025)), at(x - 1, y + F.lit(0.0025)), at(x - 1, y))
    bar = F.transform(bar, lambda p: F.array(p[0], F.when(p[1] > y, y + F.lit(0.0025)).otherwise(y)))
    rows = _points(spark, sf).join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    rows = rows.select("c_custkey", F.array(F.array(triangle), F.array(bar)).alias("c"))
    middle = geo.largest_centroid(F.col("c"))
    rows = rows.select("c_custkey", geo.bounds(F.col("c")).alias("b"), F.round(geo.ring_area(F.col("c")[0][0]), 12).alias("area"), F.round(middle[0], 6).alias("lng"), F.round(middle[1], 6).alias("lat"))
    return rows.select("c_custkey", *(F.round(f"b.{k}", 9).alias(k) for k in ("west", "south", "east", "north")), "area", "lng", "lat")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 5 END AS points, round(x, 5) AS west, round(y + 0.2::DOUBLE, 5) AS north FROM (SELECT c_custkey, {_LAT} AS y, {_LNG} AS x FROM customer)""")
def simplified_shapes(spark, sf):
    """A triangle at every customer's place with a point on its first side, near the side or off it."""
    x, y = F.col("longitude"), F.col("latitude")
    bump = F.when(F.col("c_custkey") % 2 == 0, 0.00001).otherwise(0.01)
    ring = F.array(F.array(x, y), F.array(x + 0.1, y - bump), F.array(x + 0.2, y), F.array(x, y + 0.2), F.array(x, y))
    made = spatial.simplify(_points(spark, sf).select("c_custkey", F.array(F.array(ring)).alias("coordinates")))
    points = F.col("coordinates")[0][0]
    return made.select("c_custkey", F.size(points).alias("points"), F.array_min(F.transform(points, lambda p: p[0])).alias("west"), F.array_max(F.transform(points, lambda p: p[1])).alias("north"))


@query()
def map_clusters(spark, sf):
    return map_cluster_points(_points(spark, sf), [12, 11, 10], "c_custkey").select("zoom", F.col("id").alias("c_custkey"), "cluster", "points", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


# Badges, contacts, dimensions, fetch plans


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders GROUP BY o_custkey)
SELECT o_orderkey, array_to_string(list_filter([CASE o_orderkey % 4 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'verify_carefully' WHEN o_orderpriority = '2-HIGH' THEN 'watch' END, CASE o_orderstatus WHEN 'F' THEN 'likely_unavailable' WHEN 'P' THEN 'stale' END,
  CASE WHEN o_orderdate > TIMESTAMP '1998-07-01' - INTERVAL 14 DAYS THEN CASE WHEN o_totalprice < 100000 THEN 'price_drop' ELSE 'price_increase' END END, CASE WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN 'new_today' END, CASE WHEN o_custkey % 6 = 0 THEN 'duplicate' END, CASE WHEN o_custkey % 5 = 0 THEN 'source_uncertain' END], lambda x: x IS NOT NULL), ' ') AS badges FROM orders""")
def badges(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    marks = preference.badges(
        F.when(k % 4 == 0, "saved").when(k % 4 == 1, "applied"), F.when(F.col("o_orderpriority") == "1-URGENT", "verify_carefully").when(F.col("o_orderpriority") == "2-HIGH", "watch"),
        F.when(F.col("o_orderstatus") == "F", "likely_unavailable").when(F.col("o_orderstatus") == "P", "missing_once").otherwise("active"), F.lit(100000.0), F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderdate"),
        F.lit("1996-01-01").cast("timestamp"), F.when(c % 6 == 0, "g"), F.when(c % 5 == 0, "partial").otherwise("success"), F.lit("1998-07-01").cast("timestamp"),
    )
    return read(spark, sf, "orders").select("o_orderkey", F.array_join(marks, " ").alias("badges"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, s_name) AS name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS place, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) IS NULL AND coalesce(s_name, n_name) IS NOT NULL AS inherited
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def contact_resolution(spark, sf):
    rows = read(spark, sf, "customer").join(read(spark, sf, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    own = {"name": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), "place": F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))}
    return rows.select("c_custkey", preference.contact(own, {"name": F.col("s_name"), "place": F.col("n_name")}).alias("c")).select("c_custkey", "c.*")


@query("""SELECT o_orderkey, coalesce(nullif(r_name, 'ASIA'), CAST(o_custkey AS VARCHAR)) AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_fallback_join(spark, sf):
    nation = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    name = F.coalesce(F.nullif(F.col("r_name"), F.lit("ASIA")), F.col("o_custkey").cast("string"))
    return read(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", name.alias("region"))


@query("""WITH p AS (SELECT l_suppkey AS source_id, l_orderkey * 10 + l_linenumber AS listing_id, l_linenumber AS pos, l_extendedprice AS price FROM lineitem WHERE l_linestatus = 'O'), k AS (SELECT l_suppkey AS source_id, l_orderkey * 10 + l_linenumber AS listing_id, l_extendedprice + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS price, l_orderkey % 2 = 0 AS fetched,
  CASE WHEN l_returnflag = 'R' THEN 'likely_unavailable' ELSE 'active' END AS stale FROM lineitem WHERE l_linenumber <> 1 OR l_linestatus <> 'O'),
r AS (SELECT p.source_id, p.listing_id, pos, CASE WHEN k.listing_id IS NULL THEN 'new' WHEN NOT fetched THEN 'backlog' WHEN p.price <> k.price THEN 'price_moved' END AS reason FROM p LEFT JOIN k ON p.source_id = k.source_id AND p.listing_id = k.listing_id
  UNION ALL SELECT k.source_id, k.listing_id, NULL, 'backlog' FROM k ANTI JOIN p ON p.source_id = k.source_id AND p.listing_id = k.listing_id WHERE NOT fetched AND stale IN ('active', 'missing_once'))
SELECT source_id, listing_id, reason, CAST(n AS INT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY CASE reason WHEN 'new' THEN 0 WHEN 'backlog' THEN 1 ELSE 2 END, pos NULLS LAST, listing_id) AS n FROM r WHERE reason IS NOT NULL) WHERE n <= 12""")
def fetch_plan(spark, sf):
    items = read(spark, sf, "lineitem")
    key = [F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id")]
    page = items.filter("l_linestatus = 'O'").select(*key, F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("price"))
    known = items.filter("l_linenumber <> 1 or l_linestatus <> 'O'").select(  # all but the new ones on the page
        
        *key, (F.col("l_extendedprice") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).alias("price"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("x")).alias("detail_fetched_at"),
        F.when(F.col("l_returnflag") == "R", "likely_unavailable").otherwise("active").alias("stale_status"),
    )
    return incremental.plan_fetches(page, known, 12).select("source_id", "listing_id", "reason", "turn")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(CAST(value * 100 AS BIGINT)) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    events = read(spark, sf, "events").withColumn("value", F.bround(F.col("value") * 100).cast("long"))
    return ingest.counts_by_window(events)


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS amount FROM customer")
def plain_numbers(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", plain_number(F.col("c_acctbal")).alias("amount"))


from hearthlake import search_queries, source_queries, store_queries  # noqa: E402, F401  register their queries here
