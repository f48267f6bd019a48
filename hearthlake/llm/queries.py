"""Queries over the driver's tables, one per operator, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import embed_dedup, exact_dedup, hard_negatives, licences, line_dedup, mix, periodic, sentencepieces, sharding, simhash, substring, toxicity, url_tree


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_docs(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = licences.scan(docs, licences.fit(docs))
    sure = F.filter("findings", lambda f: f["confirmed"])
    return found.select(
        "doc_id", "n_paragraphs", F.array_sort(F.array_distinct(F.transform(sure, lambda f: f["family"]))).alias("families"), F.size(sure).cast("long").alias("n_confirmed"),
        F.size(F.filter("findings", lambda f: f["family"] == "unknown")).cast("long").alias("n_unknown"), F.size("findings").cast("long").alias("n_findings"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_docs(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content
  FROM documents
), g AS (
  SELECT doc_id, content,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM g
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_docs(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d
), w AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 12], ' ')) AS first_doc FROM p
), gone AS (
  SELECT doc_id, unnest(range(i, i + 13)) AS k FROM w WHERE first_doc < doc_id
), g AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM gone GROUP BY doc_id
), o AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d
), kept AS (
  SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.k) AS text, count(*) AS n
  FROM o ANTI JOIN gone ON o.doc_id = gone.doc_id AND o.k = gone.k GROUP BY o.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return cut.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH t AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)<(?:br|/p|/div|/li|/h[1-6]|/title|/nav|/article|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS text
  FROM pages
), u AS (
  SELECT page_id, host, regexp_replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r\f\x0B]+', ' ', 'g') AS text FROM t
), r AS (
  SELECT page_id, host, string_split(text, chr(10)) AS parts FROM u
), l AS (
  SELECT page_id, host, k, trim(line, ' ') AS line FROM (SELECT page_id, host, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM r) WHERE trim(line, ' ') <> ''
), c AS (
  SELECT host, line, count(DISTINCT page_id) AS n FROM l GROUP BY host, line
), s AS (
  SELECT host, count(*) AS pages FROM r GROUP BY host
), g AS (
  SELECT c.host, c.line FROM c JOIN s ON c.host = s.host WHERE n > 1 AND n > 0.3 * pages
), k AS (
  SELECT l.page_id, count(*) AS n_lines, count(g.line) AS n_dropped, string_agg(CASE WHEN g.line IS NULL THEN l.line END, chr(10) ORDER BY k) AS text
  FROM l LEFT JOIN g ON l.host = g.host AND l.line = g.line GROUP BY l.page_id
)
SELECT r.page_id, r.host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM r LEFT JOIN k ON r.page_id = k.page_id
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a
)
SELECT c.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.encode(_docs(spark, sf_dir).select("doc_id", "text"), n=3, check=True)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("scores")[0].alias("score"), F.size("scores").alias("n_best"),
        (F.col("scores")[0] - F.try_element_at("scores", F.lit(2))).alias("second_gap"), F.xxhash64("others").alias("others_hash"), "round_trip",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_docs(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number").withColumn("size", F.col("size") + 8)


#: (verdict, host, path) of the rules that come before the method's own verdict.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's path is the document that it shows; low quality or toxicity makes its label bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("number"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    judged = url_tree.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_share", 9).alias("bad_share"))


def _op11_sql() -> str:
    """The tree level by level; every level of the module's LEVELS, those that no path reaches are empty."""
    weight, levels = url_tree.WEIGHT, url_tree.LEVELS
    cases = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in cases)
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""
h{k} AS (SELECT *, segments[{k}] AS segment FROM t{k - 1} WHERE len(segments) >= {k}),
c{k} AS (SELECT host, template, segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad, sum(n * (len(segments) - {k})) AS below FROM h{k} GROUP BY ALL),
m{k} AS (SELECT *, CASE WHEN n >= {url_tree.LEAST} AND n * {url_tree.SHARE} >= sum(n) OVER (PARTITION BY host, template) THEN segment ELSE '*' END AS token FROM c{k}),
b{k} AS (SELECT host, template, token, sum(n) AS n, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad, sum(below) AS below FROM m{k} GROUP BY ALL),
r{k} AS (SELECT b{k}.*, floor(below / n + 0.5) AS deep, (bad + {weight} * share) / (labelled + {weight}) AS rate FROM b{k}, total),
a{k} AS (SELECT *, lag(bad) OVER o AS pb, lag(labelled) OVER o AS pl FROM r{k} WINDOW o AS (PARTITION BY host, template, deep ORDER BY rate, token)),
p{k} AS (SELECT *, sum(CASE WHEN (pb * labelled - bad * pl) * (pb * labelled - bad * pl) * (pl + labelled) > {url_tree.ALIKE} * pl * labelled * (pb + bad) * (pl + labelled - pb - bad) THEN 1 ELSE 0 END) OVER (PARTITION BY host, template, deep ORDER BY rate, token) AS part FROM a{k}),
n{k} AS (SELECT host, template, deep, part, CASE WHEN count(*) = 1 THEN min(token) ELSE '{{' || string_agg(token, ',' ORDER BY token) || '}}' END AS name FROM p{k} GROUP BY ALL),
t{k} AS (
  SELECT host, masked, n, labelled, bad, segments, template FROM t{k - 1} WHERE len(segments) < {k}
  UNION ALL
  SELECT h.host, h.masked, h.n, h.labelled, h.bad, h.segments, h.template || '/' || x.name
  FROM h{k} h JOIN m{k} m ON h.host = m.host AND h.template = m.template AND h.segment = m.segment
  JOIN p{k} p ON m.host = p.host AND m.template = p.template AND m.token = p.token
  JOIN n{k} x ON p.host = x.host AND p.template = x.template AND p.deep = x.deep AND p.part = x.part
),""")
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{url_tree.UPPER}', '{url_tree.LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), w AS (
  SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS masked, regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS digits FROM v
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id >= 0 GROUP BY doc_id
), d AS (
  SELECT host, masked, count(*) AS n, count(l.bad) AS labelled, coalesce(sum(l.bad), 0) AS bad
  FROM w LEFT JOIN l ON l.doc_id = CASE WHEN length(digits) BETWEEN 1 AND 18 THEN CAST(digits AS BIGINT) END GROUP BY host, masked
), total AS (
  SELECT (sum(bad) + 1.0::DOUBLE) / (sum(labelled) + 2.0::DOUBLE) AS share FROM d
), e AS (
  SELECT *, CASE WHEN masked = '' THEN [] ELSE string_split(regexp_replace(masked, '^/', ''), '/') END AS parts FROM d
), t0 AS (
  SELECT host, masked, n, labelled, bad, CASE WHEN len(parts) > {levels} THEN list_append(parts[1:{levels - 1}], '**') ELSE parts END AS segments, host AS template FROM e
),{"".join(steps)}
g AS (
  SELECT host, template, sum(bad)::DOUBLE AS tb, sum(labelled)::DOUBLE AS tl FROM t{levels} GROUP BY ALL
), k AS (
  SELECT host, sum(bad)::DOUBLE AS hb, sum(labelled)::DOUBLE AS hl FROM t{levels} GROUP BY ALL
), s AS (
  SELECT g.host, template, (tb + {weight} * ((hb - tb + {weight} * share) / (hl - tl + {weight}))) / (tl + {weight}) AS bad_share FROM g JOIN k ON g.host = k.host, total
), f AS (
  SELECT page_id, host, path, masked, CASE {fits} END AS ruled FROM w
)
SELECT f.page_id, f.host, f.path, split_part(ruled, ' ', 2) AS rule, coalesce(split_part(ruled, ' ', 1), CASE WHEN bad_share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(bad_share, 9) AS bad_share
FROM f JOIN t{levels} t ON f.host = t.host AND f.masked = t.masked JOIN s ON t.host = s.host AND t.template = s.template
"""


OP11_SQL = _op11_sql()


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, repeats a part of its words from some place on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0)).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    planted = F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, (n - a).cast("int")))
    return docs.select("doc_id", F.when(h % 10 == 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(with_planted_period(_docs(spark, sf_dir)))
    # Greatest length, then smallest start, then smallest period.
    found = found.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("fine")))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), "best.length", (-F.col("best.fine")).alias("period"), F.expr("-(1000 * best.length div best.fine)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""


QUERIES = {"op1_mix": op1_mix, "op2_simhash": op2_simhash, "op3_license_scan": op3_license_scan, "op4_exact_dedup": op4_exact_dedup, "op5_substring_dedup": op5_substring_dedup, "op6_toxicity": op6_toxicity, "op7_line_dedup": op7_line_dedup, "op8_embedding_dedup": op8_embedding_dedup, "op9_sentencepiece": op9_sentencepiece, "op10_sharding": op10_sharding, "op11_url_filter": op11_url_filter, "op12_periodic_runs": op12_periodic_runs, "op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op4_exact_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_line_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op11_url_filter": OP11_SQL, "op13_hard_negatives": OP13_SQL}
