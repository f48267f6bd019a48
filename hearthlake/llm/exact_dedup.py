"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Contents are combined three times and the whole content is a grouping key each
time, so two texts that merely share a digest never meet:

1. locally: the partial aggregation merges the copies inside each input split;
2. salted: what the splits hold of a digest is spread over ``salts`` groups;
3. globally: the winners of the salts are merged, one row per salt at most.

Copies are mapped back by digest. Only where several contents share one digest
is the content needed again; those few digests take a second join that compares
it.

Defined results: a null text counts as empty; a null doc_id comes after every
other one in a tie; rows that repeat a doc_id and its text count in
``group_size`` and share the same ``kept``, while ``drop_exact_duplicates`` keeps one
of them; null ids are told apart like others; an empty table gives no rows;
further columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.session import materialize, write_table

#: Characters that don't count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
_STEP = "100000000000000000000"  # above 2^64, the range of a doc_id


def normalized(text: Column) -> Column:
    """The text without blanks; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_of(content: Column) -> Column:
    """SHA-256 of the UTF-8 content as lowercase hex."""
    return F.sha2(content, 256)


def _rank(length: Column, doc_id: Column) -> Column:
    """A number that is greatest for the longest text, then the smallest doc_id."""
    inverse = F.when(doc_id.isNull(), F.lit(0)).otherwise(F.lit(9223372036854775807).cast("decimal(20,0)") - doc_id + 1)
    return (length.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(21,0)")).cast("decimal(38,0)") + inverse.cast("decimal(20,0)")


def _doc_id(rank: Column) -> Column:
    inverse = rank % F.lit(_STEP).cast("decimal(21,0)")
    return F.when(inverse > 0, F.lit("9223372036854775808").cast("decimal(20,0)") - inverse).cast("long")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=digest_of, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the one with the most code points stays, then the smallest
    id. ``digest`` may be replaced by a weaker function of the content; the
    result does not depend on it, as contents are compared. Columns to ``carry``
    along must not be named like those of the result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), *carry).select(
        "doc_id", *carry, F.length(F.coalesce("t", F.lit(""))).alias("chars"), normalized(F.col("t")).alias("content")
    )
    rows = rows.withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id", "chars"), F.lit(salts)).alias("salt")
    salted = (
        rows.select("digest", salt, "content", _rank(F.col("chars"), F.col("doc_id")).alias("rank"))
        .groupBy("digest", "salt", "content")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    merged = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    # One row per digest, with the contents kept only where there is more than one.
    classes = merged.groupBy("digest").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))
    classes = materialize(classes.select("digest", _doc_id(F.col("rank")).alias("keep_id"), F.col("n").alias("group_size"), "contents"))
    one = classes.filter("contents = 1").drop("contents")
    found = rows.drop("content").join(one, "digest")
    sha = F.col("digest")
    if digest is not digest_of:
        found = rows.join(one, "digest")
        sha = digest_of(F.col("content"))
    out = found.select("doc_id", "keep_id", "group_size", sha.alias("text_sha256"), *carry)
    shared = classes.filter("contents > 1").select("digest")
    if not shared.isEmpty():
        apart = merged.join(shared, "digest", "left_semi").select("digest", "content", _doc_id(F.col("rank")).alias("keep_id"), F.col("n").alias("group_size"))
        more = rows.join(shared, "digest", "left_semi").join(apart, ["digest", "content"])
        out = out.unionByName(more.select("doc_id", "keep_id", "group_size", digest_of(F.col("content")).alias("text_sha256"), *carry))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *carry)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each set of equal texts.

    Of several rows with the id and length that stay, whatever the id, one stays:
    rows are numbered in a table of their own and told apart by that number.
    """
    numbered = write_table(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row")))
    text = F.col(f"d.`{text_col}`").cast("string")
    rows = numbered.select("row", F.col(f"d.`{id_col}`").cast("long").alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("length"), text.alias("t"))
    kept = duplicate_groups(rows, "id", "t", carry=("row", "length"), **options).filter("kept")
    # One row per class already, unless rows repeat the id that stays.
    stay = kept.groupBy("text_sha256").agg(F.min(F.struct(-F.col("length"), F.col("row").alias("row")))["row"].alias("row")).select("row")
    return numbered.join(stay, "row", "left_semi").select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))
