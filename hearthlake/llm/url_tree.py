"""URL filter by a tree of path templates per host, in DataFrame functions.

Every URL has a host and path segments, in which runs of digits are one sign.
Equal ones are counted first, with their labels, so that the tree is built over
distinct masked paths. Level by level, under every node:

1. A segment stays as it is if at least ``LEAST`` pages and a ``SHARE``-th of the
   node's pages have it; all others become the wildcard ``*``. A node therefore
   has ``SHARE`` named branches at most, and its wildcard.
2. Branches of about equal mean depth are put in the order of their smoothed
   share of bad labels, and neighbours whose shares a two-proportion test cannot
   tell apart become one branch, ``{a,b}``.

A whole path of branches is a template. Its share of bad labels is smoothed towards
that of the rest of its host, and that one towards the share of all labels, so no
label counts twice. Templates whose share is above ``limit`` (their purity below one
minus that) are rejected. Rules given by hand come before it.

Counts combine before every shuffle. Joins with a node's few rows deal a node
out by ``SALTS`` and name their kind, as the size that Spark estimates is that of the rows before they are
copied; a tree of at most ``FEW`` masked paths, which are counted, is broadcast instead, without copies. Labels are
merged by their numbers, never broadcast. Verdicts of masked paths that hold over a ``HOT``-th of all
pages (fewer than ``HOT`` of them, each a digest of 64 characters) are broadcast,
and the other paths meet theirs in a shuffle that holds no hot key.

Defined results: a null URL, or one without ``://``, has an empty host and path and
belongs to the host with the empty name; a path deeper than ``LEVELS`` ends in
``**``; a template without labels has the share of its host; labels that repeat a number
are bad if one of them is; null labels are none; rows that repeat a page count
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.session import materialize

LEVELS, LEAST, SHARE = 4, 5, 20
#: Weight of the share that another one is smoothed towards, in labels; chi-square of one degree at 0.05.
WEIGHT, ALIKE = 8.0, 3.84
SALTS, HOT = 16, 1000
#: Masked paths, and a hundred times as many characters of them, whose tree a broadcast may carry.
FEW = 5000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its path.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; of equally long ones a block, then the first by name."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    cases = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in ranked]
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))


def last_number(path: Column) -> Column:
    """The last run of digits of a path as a number, null if there is none or it has over 18 digits."""
    digits = F.regexp_extract(path, "([0-9]+)[^0-9]*$", 1)
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 18), digits).cast("long")


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join of rows with the few rows of their keys; a key's rows on the left are dealt by ``by`` to SALTS parts, unless all those on the right are ``few``."""
    if few:
        return left.join(F.broadcast(right), keys, how)
    left = left.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def masked_paths(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (host, masked, n, labelled, bad) of the distinct hosts and masked paths.

    pages (host, path, number); labels (number, bad), number the one that a URL and its label share.
    """
    masked = F.regexp_replace("path", "[0-9]+", "#")
    counted = pages.groupBy("host", masked.alias("masked"), "number").agg(F.count(F.lit(1)).alias("n"))
    # Paths without a number get one of their own that no label has, so they are not one key.
    counted = counted.withColumn("number", F.coalesce("number", -F.abs(F.xxhash64("host", "masked") % (1 << 60)) - 1))
    known = labels.filter("number >= 0 and bad is not null").groupBy("number").agg(F.max("bad").cast("int").alias("bad"))
    met = _dealt(counted, known, ["number"], ["host", "masked"], "left")
    return met.groupBy("host", "masked").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("bad"))


def grow(paths: DataFrame) -> DataFrame:
    """Rows (host, masked, template, bad_share) for the rows of ``masked_paths``."""
    segments = F.when(F.col("masked") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("masked", "^/", ""), "/"))
    cut = F.when(F.size("segments") > LEVELS, F.concat(F.slice("segments", 1, LEVELS - 1), F.array(F.lit("**")))).otherwise(F.col("segments"))
    rows = paths.withColumn("segments", segments).withColumn("segments", cut)
    signs = F.sum(F.length("host") + F.length("masked"))
    total = rows.agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.max(F.size("segments")).alias("depth"), F.count(F.lit(1)).alias("paths"), signs.alias("signs"))
    first = total.first()
    if first["all_labelled"] is None:
        return rows.select("host", "masked", F.lit("").alias("template"), F.lit(0.0).alias("bad_share"))
    few = first["paths"] <= FEW and first["signs"] <= 100 * FEW
    share = (first["all_bad"] + 1.0) / (first["all_labelled"] + 2.0)
    rows = materialize(rows.withColumn("template", F.col("host")))
    for level in range(1, first["depth"] + 1):
        rows = materialize(_level(rows, level, share, few))
    smooth = lambda bad, labelled, to: (bad + F.lit(WEIGHT) * to) / (labelled + F.lit(WEIGHT))
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    own = rows.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    own = _dealt(own, hosts, ["host"], ["template"], few=few)
    rest = smooth(F.col("hb") - F.col("tb"), F.col("hl") - F.col("tl"), F.lit(share))
    own = own.select("host", "template", smooth(F.col("tb"), F.col("tl"), rest).alias("bad_share"))
    return _dealt(rows.select("host", "masked", "template"), own, ["host", "template"], ["masked"], few=few)


def _level(rows: DataFrame, level: int, share: float, few: bool) -> DataFrame:
    """One level of the tree: rows whose paths reach it get the branch of their segment."""
    node = ["host", "template"]
    here = rows.filter(F.size("segments") >= level).withColumn("segment", F.col("segments")[level - 1])
    ended = rows.filter(F.size("segments") < level)
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "below")]
    counted = here.withColumn("below", F.col("n") * (F.size("segments") - level)).groupBy(*node, "segment").agg(*sums)
    totals = counted.groupBy(*node).agg(F.sum("n").alias("total"))
    frequent = (F.col("n") >= LEAST) & (F.col("n") * SHARE >= F.col("total"))
    named = _dealt(counted, totals, node, ["segment"], few=few).withColumn("token", F.when(frequent, F.col("segment")).otherwise("*"))
    branches = named.groupBy(*node, "token").agg(*sums)
    # At most SHARE + 1 branches a node, so its window is short.
    rate = (F.col("bad") + F.lit(WEIGHT) * F.lit(share)) / (F.col("labelled") + F.lit(WEIGHT))
    branches = branches.withColumn("deep", F.floor(F.col("below") / F.col("n") + 0.5)).withColumn("rate", rate)
    order = Window.partitionBy(*node, "deep").orderBy("rate", "token")
    before = lambda c: F.lag(c).over(order).cast("double")
    b1, l1, b2, l2 = before("bad"), before("labelled"), F.col("bad").cast("double"), F.col("labelled").cast("double")
    apart = (b1 * l2 - b2 * l1) * (b1 * l2 - b2 * l1) * (l1 + l2) > F.lit(ALIKE) * l1 * l2 * (b1 + b2) * (l1 + l2 - b1 - b2)
    branches = branches.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("part", F.sum("apart").over(order))
    merged = branches.groupBy(*node, "deep", "part").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    name = F.when(F.size("tokens") == 1, F.col("tokens")[0]).otherwise(F.concat(F.lit("{"), F.array_join("tokens", ","), F.lit("}")))
    branch = merged.select(*node, F.explode("tokens").alias("token"), name.alias("name"))
    of_segment = _dealt(named.select(*node, "segment", "token"), branch, [*node, "token"], ["segment"], few=few).select(*node, "segment", "name")
    met = _dealt(here, of_segment, [*node, "segment"], ["masked"], few=few)
    met = met.withColumn("template", F.concat("template", F.lit("/"), "name"))
    return ended.unionByName(met.select(*rows.columns))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), limit: float = 0.5, id_col: str = "page_id", url_col: str = "url", number=last_number) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share.

    labels (number, bad): what is known about some URLs, by the number that ``number`` reads from a path.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    read = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    paths = materialize(masked_paths(read.select("host", "path", number(F.col("path")).alias("number")), labels))
    judged = grow(paths)
    key = F.sha2(F.concat("host", "masked"), 256)  # a host has no slash and a path starts with one
    verdicts = materialize(paths.select("host", "masked", "n").join(judged, ["host", "masked"]).select(key.alias("key"), "n", "template", "bad_share"))
    n = verdicts.agg(F.sum("n")).first()[0] or 0
    hot = verdicts.filter(F.col("n") * HOT > n).drop("n")  # fewer than HOT rows
    cold = verdicts.filter(F.col("n") * HOT <= n).drop("n")
    rows = read.withColumn("key", F.sha2(F.concat("host", F.regexp_replace("path", "[0-9]+", "#")), 256))
    near = rows.join(F.broadcast(hot), "key")
    far = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key")
    found = near.unionByName(far).withColumn("by", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("bad_share") > limit, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")
