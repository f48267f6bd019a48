"""Removal of boilerplate lines by their frequency within a site, in DataFrame functions.

A page's HTML becomes lines of text. For every host, the pages that contain a
line are divided by the pages of the host; lines above the ratio go from all
pages of that host.

Counting shuffles digests of lines, combined before the shuffle. The lines that
go are gathered per host: as each is on more than ``ratio`` of the pages, there are
at most ``1 / ratio`` times as many as a page of the host has lines on average, so
the list of a host is short however many pages it has. The pages of a host meet
it in ``SALTS`` parts.

Defined results: null or empty HTML has no lines; a null URL, or one without a
host, belongs to the site with the empty name; a line counts once for a page
however often the page repeats it; a line on a single page repeats nothing and stays,
whatever the size of its site; lines are compared after blanks are collapsed and
trimmed; rows that repeat a page count as pages of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.session import write_table

SALTS = 32
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAK = r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/title|/nav|/article|/tr)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Replaced one after the other, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_lines(html: Column) -> Column:
    """Lines of text of a page's HTML."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, " ")
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped and the kept lines."""
    lines = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col).cast("string")).alias("host"), page_lines(F.col(html_col).cast("string")).alias("lines"))
    lines = write_table(lines)
    digest = lambda x: F.unhex(F.md5(x.cast("binary")))
    counted = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", digest(F.col("line")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    sites = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = counted.filter("n > 1").join(sites, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    gone = common.groupBy("host").agg(F.collect_list("digest").alias("gone")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = lines.withColumn("salt", F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(SALTS)).cast("int")).join(gone, ["host", "salt"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("gone"), digest(x))))
    met = met.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept_lines"))
    return met.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), "kept_lines")
