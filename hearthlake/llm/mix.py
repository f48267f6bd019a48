"""Mixing sources to target weights by exact subset sums of document lengths.

Every source gets a share of the word budget in proportion to its weight, but at
most ``max_repeats`` times what it holds; what is cut off is shared again by
weight. Within a source every document is taken ``target // size`` times, and
the rest of the budget is met exactly where lengths allow it: the number of
documents of each exact length is counted, each length first gives its
proportional part, a bounded-knapsack dynamic program over the counts that are
left closes the gap, and so many documents of each length are then picked in a
seeded order.

Defined results: a null text has no words; null is a source of its own that
comes last; a source without words gets no target and takes nothing; documents
without words are taken like others of their length, which adds no words; ties
in the seeded order fall to the smaller doc_id, null last, and then to the smaller
hash of the text, so rows that repeat an id (or have none) are placed one by one,
and only rows with equal texts too are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.session import materialize, write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one seeded group may hold before it is cut into smaller ones.
GROUP_ROWS = 250
#: Sums that the knapsack's table holds at most; lengths above an eighth of it are placed before it.
TABLE = 1 << 24


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one per source.

    Weights repeat over the sources by code point, null last. Sharing the excess
    again by weight until nobody is above the cap ends at ``min(cap, level * weight)``
    with one level for all; sorted by cap per weight, the level is found from
    running sums. One row per source goes through one window here.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    )
    # The level if all sources before this one are at their caps; it holds from the first source that it doesn't lift above its cap.
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    ranked = ranked.withColumn("at", level["level"])
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come to the budget.

    Each length first gives its part of the budget less a reserve of four times
    the longest length, then one more of each from the longest down while the
    reserve is left. The bounded-knapsack program over what remains of each length
    fills the reserve, in which even the longest documents fit; the sum is the one
    nearest to the budget. Of lengths above ``TABLE // 8`` words their part, rounded
    to whole documents, is taken first, and the shorter ones make up for the
    difference; so the table's size is bounded however long a document is.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    size = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if size == 0 or budget <= 0:
        return take
    if budget >= size:
        return counts.copy()
    small = lengths <= TABLE // 8
    if not small.all():
        carry = 0.0
        for i in np.flatnonzero(~small)[::-1]:
            want = float(counts[i] * lengths[i]) * budget / size + carry
            take[i] = min(int(counts[i]), max(0, math.floor(want / int(lengths[i]) + 0.5)))
            carry = want - float(take[i] * lengths[i])
        take[small] = fit_budget(lengths[small], counts[small], budget - int((take * lengths).sum()))
        return take
    keep_free = 4 * int(lengths[counts > 0].max())
    take = np.array([int(c) * max(0, budget - keep_free) // size for c in counts], dtype=np.int64)
    gap = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and (more := min(int(counts[i] - take[i]), max(0, gap - keep_free) // int(lengths[i]))) > 0:
            take[i] += more
            gap -= more * int(lengths[i])
    return take + _subset(lengths, counts - take, gap)


def _subset(lengths: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """Bounded knapsack: the choice whose sum comes nearest to the gap, below rather than above it."""
    take = np.zeros(len(lengths), dtype=np.int64)
    top = gap + int(lengths[counts > 0].max(initial=0))
    reached = np.full(top + 1, -1, dtype=np.int32)  # the part that first reached each sum
    reached[0] = -2
    parts: list[tuple[int, int]] = []  # (length's index, how many at once): powers of two of each count
    for i in np.argsort(-counts * (lengths > 0), kind="stable"):
        left, k = int(min(counts[i], top // lengths[i] if lengths[i] else 0)), 1
        while left > 0 and reached[gap] == -1:
            k = min(k, left)
            step = k * int(lengths[i])
            if step <= top:
                new = np.flatnonzero((reached[: top + 1 - step] != -1) & (reached[step:] == -1)) + step
                reached[new] = len(parts)
                parts.append((int(i), k))
            left -= k
            k *= 2
        if reached[gap] != -1:
            break
    sums = np.flatnonzero(reached != -1)
    at = int(sums[np.abs(sums - gap).argmin()])
    while at > 0:
        i, k = parts[reached[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    return _mixed(docs.select(*_inputs(id_col, text_col, source_col)), weights, max_repeats, seed).drop("hash")


def _inputs(id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text).alias("size"), F.xxhash64(text).alias("hash")]


def _mixed(rows: DataFrame, weights: tuple[float, ...], max_repeats: int, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, hash, ...) with source_size, target, copies and taken."""
    carried = [c for c in rows.columns if c not in ("doc_id", "size", "source")]
    rows = materialize(rows)
    histogram = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, max_repeats)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group.source_size.iloc[0]), float(group.target.iloc[0])
        whole = min(int(target // size), max_repeats) if size else 0
        rest = round(target - whole * size) if whole < max_repeats else 0
        group = group.sort_values("size", ignore_index=True)
        take = fit_budget(group["size"].to_numpy(), group["docs"].to_numpy(), min(rest, size)) if size else np.zeros(len(group), dtype=np.int64)
        parts = [math.ceil(n / GROUP_ROWS) for n in group["docs"]]
        return pd.DataFrame({"source": group["source"], "size": group["size"], "source_size": size, "target": target, "whole": whole, "more": take, "parts": parts})

    # A source's histogram has a row per distinct length, however many documents it holds.
    counted = histogram.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    schema = "source string, size long, source_size long, target double, whole long, more long, parts long"
    quota = materialize(counted.groupBy("source").applyInPandas(plan, schema))

    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    mine = rows.withColumn("order", order).join(
        quota.select(F.col("source").alias("name"), F.col("size").alias("length"), "source_size", "target", "whole", "more", "parts"),
        (F.col("size") == F.col("length")) & F.col("source").eqNullSafe(F.col("name")),
    )
    # Long groups are cut into ranges of the seeded order, so that no window holds more than a part of one and the choice is that of one window.
    range_of = (F.shiftright("order", 32) + F.lit(1 << 31)) * F.col("parts") / F.lit(1 << 32)
    mine = mine.withColumn("part", F.floor(range_of)).drop("name", "length")
    cut = mine.filter("parts > 1").groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = cut.withColumn("earlier", F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("n"))
    earlier = earlier.select(F.col("source").alias("name"), F.col("size").alias("length"), F.col("part").alias("piece"), "earlier")
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", F.asc_nulls_last("doc_id"), F.asc_nulls_last("hash")))
    numbered = mine.withColumn("place", place).join(
        earlier, (F.col("size") == F.col("length")) & (F.col("part") == F.col("piece")) & F.col("source").eqNullSafe(F.col("name")), "left"
    )
    copies = F.col("whole") + (F.col("place") + F.coalesce("earlier", F.lit(0)) <= F.col("more")).cast("long")
    return numbered.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), *carried).withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns.

    Rows are numbered in a table of their own, so those that repeat an id, or have
    none, each take what ``mix_sources`` gives them.
    """
    numbered = write_table(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row")))
    at = lambda c: f"d.`{c}`"
    plan = _mixed(numbered.select(*_inputs(at(id_col), at(text_col), at(source_col)), "row"), weights, max_repeats, seed).filter("copies > 0").select("row", "copies")
    taken = numbered.join(plan, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*(F.col(at(c)).alias(c) for c in docs.columns))
