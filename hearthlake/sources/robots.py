"""robots.txt rules as rows, and which paths they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_rules(files: DataFrame, site: str = "site", text: str = "text") -> DataFrame:
    """Rows (site, grp, agents, allow, path). A group starts at an agent line that follows no agent line."""
    lines = files.select(site, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter(F.contains("line", F.lit(":")))
    lines = lines.select(site, "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    order = Window.partitionBy(site).orderBy("pos")  # a file is one site's
    agent = F.col("field") == "user-agent"
    start = agent & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    lines = lines.withColumn("grp", F.sum(start.cast("int")).over(order))
    agents = lines.filter(agent).groupBy(site, "grp").agg(F.collect_list(F.lower("value")).alias("agents"))
    rules = lines.filter(F.col("field").isin("allow", "disallow") & (F.col("grp") > 0))
    return agents.join(rules, [site, "grp"], "left").select(site, "grp", "agents", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def allowed(paths: DataFrame, rules: DataFrame, token: str, site: str = "site", path: str = "path") -> DataFrame:
    """``paths`` with ``allowed``: the longest rule of the first group for the agent decides, allow wins a tie.

    A group named for the agent comes before the one for everybody; without either all is allowed.
    """
    token = token.lower()
    named = F.exists("agents", lambda a: (a != "*") & F.contains(F.lit(token), a))
    rank = F.when(named, 0).when(F.array_contains("agents", "*"), 1)
    mine = rules.withColumn("rank", rank).filter("rank is not null")
    best = mine.groupBy(F.col(site).alias("__site")).agg(F.min(F.struct("rank", "grp")).alias("best"))
    chosen = mine.join(best, (F.col(site) == F.col("__site")) & (F.struct("rank", "grp") == F.col("best"))).select(F.col("__site"), "allow", F.col("path").alias("__rule"))
    keyed = paths.withColumn("__id", F.monotonically_increasing_id())
    met = keyed.join(chosen, F.col(site) == F.col("__site"), "left")
    hit = F.when((F.col("__rule") != "") & F.startswith(F.col(path), F.col("__rule")), F.struct(F.length("__rule").alias("n"), F.col("allow").alias("allow")))
    found = met.groupBy("__id").agg(*(F.first(c).alias(c) for c in paths.columns), F.max(hit).alias("hit"))
    return found.select(*paths.columns, F.coalesce("hit.allow", F.lit(True)).alias("allowed"))
