"""Registered queries of searching, user state and reports; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlake.functions import times
from hearthlake.operators import user_state
from hearthlake.operators.preference import SEARCH_FILLERS
from hearthlake.plans import reports
from hearthlake.plans import search_view as views
from hearthlake.queries import ORACLE, _digest, query, read

# Free-text search

_ADJECTIVES, _NOUNS = ["red", "blue", "small", "large", "old", "new", "hot", "cold"], ["ring", "widget", "plate", "gear", "rod", "bolt", "gizmo", "anvil"]
_WORDS_SQL = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN {tuple(SEARCH_FILLERS)}))"
_SEARCH_SQL = f"""s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'The unit, please: my home' ELSE 'Some ' || {_ADJECTIVES}[n_nationkey % 8 + 1] || ' ' || {_NOUNS}[n_nationkey // 3 % 8 + 1] || ' near brand#1' END AS query,
  n_nationkey % 2 = 0 AS centred, 0.5::DOUBLE + n_regionkey * 2 AS radius, n_nationkey % 3 = 0 AS hidden FROM nation),
l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN 37.6::DOUBLE + (p_partkey % 100) * 0.003::DOUBLE END AS lat, -122.6::DOUBLE + (p_partkey % 37) * 0.008::DOUBLE AS lng, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t,
  p_partkey % 13 <> 0 AND p_partkey % 9 <> 0 AS live FROM part WHERE p_partkey % 17 <> 0),
d0 AS (SELECT s.*, l.*, pow(sin(radians(lat - 37.75::DOUBLE) / 2), 2) + cos(radians(37.75::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng + 122.45::DOUBLE) / 2), 2) AS a FROM s JOIN l ON s.hidden OR l.live),
d AS (SELECT *, CASE WHEN centred THEN 2 * 6371 * asin(sqrt(a)) * 0.621371::DOUBLE END AS dist FROM d0),
p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist NULLS LAST, k DESC) AS place FROM d WHERE dist IS NULL OR dist <= radius QUALIFY place <= 5000),
h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY id) > 24 THEN len(list_filter({_WORDS_SQL}, lambda w: contains(t, w))) ELSE 0 END AS hits FROM p),
r AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, place) <= 24)"""


def _search_tables(spark, sf):
    n, k = F.col("n_nationkey"), F.col("p_partkey")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % 8 + 1).cast("int"))
    asked = F.when(n % 5 == 4, "The unit, please: my home").otherwise(F.concat(F.lit("Some "), pick(_ADJECTIVES, n), F.lit(" "), pick(_NOUNS, F.floor(n / 3)), F.lit(" near brand#1")))
    searches = read(spark, sf, "nation").select(
        n.alias("search_id"), asked.alias("query"), F.when(n % 2 == 0, 37.75).alias("center_lat"), F.when(n % 2 == 0, -122.45).alias("center_lng"), F.when(n % 2 == 0, F.lit(0.5) + F.col("n_regionkey") * 2).alias("radius_miles"), (n % 3 == 0).alias("include_hidden"),
    )
    listings = read(spark, sf, "part").select(
        k.alias("listing_id"), F.when(k % 17 != 0, F.col("p_retailprice")).alias("price_monthly"), F.lit(None).cast("double").alias("price_effective_monthly"), F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("first_seen_at"), F.lit("active").alias("listing_status"),
        F.when(k % 13 == 0, "likely_unavailable").otherwise("active").alias("stale_status"), F.when(k % 9 == 0, "hidden").alias("user_status"), F.col("p_name").alias("title"), F.col("p_brand").alias("neighborhood"), F.col("p_type").alias("description"),
        F.when(k % 11 != 0, F.lit(37.6) + (k % 100) * F.lit(0.003)).alias("latitude"), (F.lit(-122.6) + (k % 37) * F.lit(0.008)).alias("longitude"),
    )
    return searches, listings


@query(f"WITH {_SEARCH_SQL} SELECT id AS search_id, k AS listing_id, CAST(place AS INT) AS place, CAST(hits AS INT) AS hits FROM r")
def search_shortlists(spark, sf):
    searches, listings = _search_tables(spark, sf)
    texts = listings.select("listing_id", F.lower(F.concat_ws(" ", "title", "neighborhood", "description")).alias("text"))
    return views.prerank(views.candidates(searches, listings), texts, searches).select("search_id", "listing_id", "place", "hits")


@query(f"""WITH {_SEARCH_SQL}, a AS (SELECT r.id, r.k, r.hits, LEAST(100, GREATEST(0, (p_size * 7 + r.id) % 130 - 10))::DOUBLE AS score FROM r JOIN part ON p_partkey = r.k WHERE (r.k + r.id) % 3 <> 0)
SELECT id AS search_id, k AS listing_id, score, CAST(hits AS INT) AS hits, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS INT) AS rank FROM a""")
def search_answers(spark, sf):
    """Candidates, shortlist, a ranker's answers about parts it was given and others, and what is accepted of them."""
    searches, listings = _search_tables(spark, sf)
    replies = read(spark, sf, "part").select(F.col("p_partkey").alias("listing_id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("search_id")).filter("(listing_id + search_id) % 3 <> 0")
    replies = replies.select("search_id", "listing_id", ((F.col("p_size") * 7 + F.col("search_id")) % 130 - 10).cast("double").alias("score"))
    return views.search_view(searches, listings, replies).select("search_id", "listing_id", "score", "hits", "rank")


# Verdicts and saved searches

_REQUESTS_SQL = """q AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 7 THEN -l_orderkey - 1 ELSE l_orderkey END AS listing_id, CASE l_returnflag WHEN 'R' THEN ['saved', 'hidden', 'toured', 'bogus'][l_suppkey % 4 + 1] WHEN 'A' THEN 'suspicious' END AS status, CASE WHEN l_quantity > 25 THEN l_linestatus END AS note FROM lineitem)"""


def _verdicts(spark, sf):
    items, k = read(spark, sf, "lineitem"), F.col("l_orderkey")
    status = F.when(F.col("l_returnflag") == "R", F.element_at(F.array(*map(F.lit, ("saved", "hidden", "toured", "bogus"))), (F.col("l_suppkey") % 4 + 1).cast("int"))).when(F.col("l_returnflag") == "A", "suspicious")
    requests = items.select((k * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") == 7, -k - 1).otherwise(k).alias("listing_id"), status.alias("status"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("note"))
    return requests, read(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"))


@query(f"WITH {_REQUESTS_SQL} SELECT pos, listing_id, CASE WHEN listing_id < 0 THEN 'listing not found' WHEN status = 'bogus' THEN 'invalid status: bogus' END AS error FROM q")
def verdict_outcomes(spark, sf):
    return user_state.verdict_outcomes(*_verdicts(spark, sf)).select("pos", "listing_id", "error")


@query(f"""WITH {_REQUESTS_SQL}, g AS (SELECT * FROM q WHERE listing_id >= 0 AND coalesce(status, '') <> 'bogus'), f AS (SELECT listing_id, [status, note] AS r FROM g QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY pos DESC, status DESC NULLS LAST, note DESC NULLS LAST) = 1)
SELECT o_orderkey AS listing_id, 'maybe' AS status, o_orderstatus AS note, TIMESTAMP '1998-01-01' AS updated_at FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey NOT IN (SELECT listing_id FROM f) UNION ALL SELECT listing_id, r[1], r[2], TIMESTAMP '1998-07-01' FROM f WHERE r[1] IS NOT NULL""")
def verdict_writes(spark, sf):
    requests, listings = _verdicts(spark, sf)
    states = read(spark, sf, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("listing_id"), F.lit("maybe").alias("status"), F.col("o_orderstatus").alias("note"), F.lit("1998-01-01").cast("timestamp").alias("updated_at"))
    return user_state.write_verdicts(states, requests, listings, F.lit("1998-07-01").cast("timestamp"))


@query("""SELECT conv_id AS owner, turn AS pos, CASE WHEN role = 'user' AND trim(text) <> '' THEN 'Search ' || conv_id WHEN trim(text) <> '' THEN trim(text) ELSE 'Saved search' END AS name, nullif(trim(text), '') AS query, CASE WHEN trim(text) = '' AND turn % 2 = 0 THEN 'a query or criteria is required' END AS error
FROM (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS text FROM conversations)""".replace("\\\\", "\\"))
def created_searches(spark, sf):
    """Every turn of a conversation saved as a search of its own."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("pos"), text.alias("query"), F.when((F.col("role") == "user") & (F.trim(text) != ""), F.concat(F.lit("Search "), "conv_id")).alias("name"), (F.col("turn") % 2 == 1).alias("has_criteria"))
    made = user_state.new_searches(rows, F.lit("1998-07-01").cast("timestamp"))
    return rows.select("owner", "pos", user_state.record_id("srch", F.col("owner"), F.col("pos").cast("string")).alias("search_id")).join(made.drop("pos"), "search_id").select("owner", "pos", "name", "query", "error")


# Reports and times

@query(f"""WITH d AS ({ORACLE["digest_diff"]}), n AS (SELECT search_id, count(*) FILTER (WHERE kind = 'new') AS a, count(*) FILTER (WHERE kind = 'price_drop') AS b, count(*) FILTER (WHERE kind = 'dropped_out') AS c, count(*) FILTER (WHERE kind IN ('new', 'price_drop', 'unchanged')) AS m FROM d GROUP BY search_id),
i AS (SELECT d.search_id, kind, '- #' || listing_id AS line, row_number() OVER (PARTITION BY d.search_id, kind ORDER BY listing_id) AS turn FROM d),
l AS (SELECT search_id, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE kind = 'new' AND turn <= 5) AS x, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE kind = 'price_drop' AND turn <= 5) AS y, string_agg(line, chr(10) ORDER BY turn) FILTER (WHERE kind = 'dropped_out' AND turn <= 5) AS z FROM i GROUP BY search_id),
s AS (SELECT search_id, chr(10) || '### New (' || a || ')' || chr(10) || x AS p, chr(10) || '### Price drops (' || b || ')' || chr(10) || y AS q, chr(10) || '### No longer matching (' || c || ')' || chr(10) || z AS r, m, a + b + c AS k FROM n JOIN l USING (search_id))
SELECT CAST(row_number() OVER (ORDER BY search_id) AS BIGINT) AS place, '## Status ' || search_id || chr(10) || '_' || m || CASE m WHEN 1 THEN ' current match' ELSE ' current matches' END || '_' || coalesce(chr(10) || p, '') || coalesce(chr(10) || q, '') || coalesce(chr(10) || r, '') || CASE WHEN k = 0 THEN chr(10) || chr(10) || '_Nothing new._' ELSE '' END AS markdown FROM s
UNION ALL SELECT 0, '# Digest — 1995-06-01' || chr(10) || chr(10) || sum(a) || CASE sum(a) WHEN 1 THEN ' new match, ' ELSE ' new matches, ' END || sum(b) || CASE sum(b) WHEN 1 THEN ' price drop, ' ELSE ' price drops, ' END || sum(c) || ' dropped out — across ' || count(*) || CASE count(*) WHEN 1 THEN ' saved search' ELSE ' saved searches' END
  || ' (7 live listings evaluated).' || chr(10) || chr(10) || '_Check availability, rent, fees and terms on the original listing; nothing is sent to anyone._' FROM n""")
def digest_report(spark, sf):
    """The digest of two years' orders as a report; five listings of a list are shown, its heading counts all."""
    changes = _digest(spark, sf)
    items = changes.select("listing_id").distinct().select("listing_id", F.concat(F.lit("- #"), "listing_id").alias("text"))
    searches = changes.select("search_id").distinct().withColumn("name", F.concat(F.lit("Status "), "search_id"))
    return reports.digest_report(changes, items, searches, F.lit(7), F.lit("1995-06-01"), 5).select("place", "markdown")


@query("""SELECT o_orderkey, '- ' || CASE WHEN o_orderkey % 2 = 0 THEN '$1,234 eff ($' || (o_custkey % 900 + 100) || ')' ELSE '$' || (o_custkey % 900 + 100) END || ' · ' || CASE o_orderkey % 3 WHEN 0 THEN 'studio' WHEN 1 THEN '?bd' ELSE '2bd' END || ' · ' || CASE WHEN o_custkey % 2 = 0 THEN 'Noe' ELSE 'SF' END || CASE WHEN o_custkey % 5 = 0 THEN ', 1.5km' ELSE '' END || ' · ' || o_orderpriority
  || CASE WHEN o_orderstatus = 'P' THEN ' — was $2,000; ⚠ verify carefully; possible duplicate; missing from source; verify: a, b' ELSE '' END || chr(10) || '  T' || o_orderkey || chr(10) || '  http://l/' || o_custkey AS item FROM orders""")
def digest_items(spark, sf):
    c, flagged = F.col, F.col("o_orderstatus") == "P"
    fields = {
        "price": (c("o_custkey") % 900 + 100).cast("double"), "effective": F.when(c("o_orderkey") % 2 == 0, 1234.4), "beds": F.when(c("o_orderkey") % 3 == 0, 0.0).when(c("o_orderkey") % 3 == 2, 2.0), "area": F.when(c("o_custkey") % 2 == 0, "Noe"),
        "distance_km": F.when(c("o_custkey") % 5 == 0, 1.5), "source": c("o_orderpriority"), "title": F.concat(F.lit("T"), "o_orderkey"), "url": F.concat(F.lit("http://l/"), "o_custkey"), "previous": F.when(flagged, 2000.0), "risk": F.when(flagged, "verify_carefully"),
        "group": F.when(flagged, "g"), "stale": F.when(flagged, "missing_once").otherwise("active"), "unknowns": F.when(flagged, F.array(F.lit("a"), F.lit("b"))),
    }
    return read(spark, sf, "orders").select("o_orderkey", reports.digest_item(fields).alias("item"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN '- s' || user_id || ': skipped, not due' ELSE '- s' || user_id || ': ' || event_type || ', ' || event_id || ' listings found, 3 new, 0 changed, 5 unchanged' || CASE WHEN user_id % 3 > 0 THEN ', ' || (user_id % 3) || ' price changes' ELSE '' END || ', 2p/1d, pagination '
  || CASE user_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'INCOMPLETE' ELSE 'unknown' END || ' (9s)' || CASE WHEN event_type = 'error' THEN chr(10) || '    error: broke' ELSE '' END || CASE WHEN user_id % 2 = 0 THEN chr(10) || '    warning: slow' || chr(10) || '    warning: few' ELSE '' END END AS line FROM events""")
def run_lines(spark, sf):
    c, n = F.col, F.lit
    fields = {
        "source": F.concat(n("s"), "user_id"), "status": F.when(c("event_type") == "view", "skipped").otherwise(c("event_type")), "reason": n("not due"), "found": c("event_id"), "new": n(3), "changed": n(None).cast("int"), "unchanged": n(5), "price_changes": c("user_id") % 3, "missing": n(0),
        "pages": n(2), "details": n(1), "pagination": F.when(c("user_id") % 3 == 0, True).when(c("user_id") % 3 == 1, False), "seconds": n(9), "error": F.when(c("event_type") == "error", "broke\nin two"), "warnings": F.when(c("user_id") % 2 == 0, F.array(n("slow"), n("few"))),
    }
    return read(spark, sf, "events").select("event_id", reports.run_line(fields).alias("line"))


@query(f"""SELECT source, source || ': CHECK (' || total || ' listings)' || coalesce(chr(10) || nullif(array_to_string(list_transform(list_filter(string_split(issues, ' '), lambda x: x <> ''), lambda i: '  - ' || replace(replace(i, 'error:', 'ERROR: '), 'warning:', 'warning: ')), chr(10)), ''), '') AS report FROM ({ORACLE["docs_coverage_contract"]})""")
def verification_texts(spark, sf):
    from hearthlake.queries import QUERIES

    profiled = QUERIES["docs_coverage_contract"](spark, sf)
    issues = F.filter(F.split("issues", " "), lambda x: x != "")
    return profiled.select("source", reports.verification_text(F.col("source"), F.lit("CHECK"), F.col("total"), issues).alias("report"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts) + CASE event_id % 4 WHEN 0 THEN INTERVAL 8 HOURS WHEN 1 THEN INTERVAL (-330) MINUTES ELSE INTERVAL 0 HOURS END, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS posted FROM events""")
def posted_times(spark, sf):
    k = F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(plain, F.lit("-0800"))).when(k == 1, F.concat(plain, F.lit("+05:30"))).when(k == 2, F.concat(plain, F.lit("Z"))).otherwise("last Tuesday")
    return read(spark, sf, "events").select("event_id", times.utc_text(times.instant(raw)).alias("posted"))
