"""Sources and the readers for their kinds of payload, and what is kept of a batch that went wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.sources import feeds

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def reader(kind: str, read: Callable[[DataFrame], DataFrame]) -> None:
    """Register what turns rows with a ``payload`` into listings; a later one of the same kind replaces it."""
    READERS[kind] = read


reader("apartments_json", feeds.apartments)
reader("unit_types_json", feeds.unit_types)
reader("posts_json", feeds.posts)


def read_sources(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings of all enabled sources with a known kind, with their ``adapter_type``.

    payloads (source_id, payload), sources (id, adapter_type, enabled). Each kind is
    read once for all its sources; columns that a kind lacks are null.
    """
    wanted = sources.filter(F.col("enabled") & F.col("adapter_type").isin(list(READERS))).select(F.col("id").alias("source_id"), "adapter_type")
    met = payloads.join(wanted, "source_id")
    out = None
    for kind, read in sorted(READERS.items()):
        made = read(met.filter(F.col("adapter_type") == kind)).withColumn("adapter_type", F.lit(kind))
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out


def skipped_sources(sources: DataFrame) -> DataFrame:
    """Sources that are not read, and why."""
    why = F.when(~F.coalesce("enabled", F.lit(False)), "disabled").when(~F.coalesce(F.col("adapter_type").isin(list(READERS)), F.lit(False)), F.concat(F.lit("no reader for "), F.coalesce("adapter_type", F.lit("none"))))
    return sources.withColumn("reason", why).filter("reason is not null")


def seed_sources(table: DataFrame, seeds: DataFrame, now: Column, reset_enabled: bool = False, key: str = "id") -> DataFrame:
    """The source table after seeding: what the seeds say wins, but for ``enabled`` of sources that were there, unless reset.

    Sources without a seed and columns that seeds lack stay; ``created_at`` is kept.
    """
    both = table.withColumn("__old", F.lit(True)).alias("t").join(seeds.withColumn("__new", F.lit(True)).alias("s"), key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        old = F.col(f"t.{c}")
        if c == "created_at":
            return F.coalesce(old, F.when(F.col("__new"), now)).alias(c)
        if c == "updated_at":
            return F.when(F.col("__new"), now).otherwise(old).alias(c)
        if c not in seeds.columns:
            return old.alias(c)
        seeded = F.col("__new") & F.col("__old").isNull() if c == "enabled" and not reset_enabled else F.col("__new")
        return F.when(seeded, F.col(f"s.{c}")).otherwise(old).alias(c)

    return both.select(*(value(c) for c in table.columns))


def failed_batches(batch: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (run_id, status, record) of the batches whose run failed or was partial, each row as JSON, to be written beside the run.

    runs (run_id, source_id, status). Rows of a source that had no such run are left out.
    """
    bad = runs.filter(F.col("status").isin("failed", "partial")).select("run_id", "source_id", "status")
    return batch.join(bad, "source_id").select("run_id", "status", F.to_json(F.struct(*(F.col(c) for c in batch.columns))).alias("record"))


def write_failed_batches(batch: DataFrame, runs: DataFrame, folder: str) -> None:
    """JSON lines by run; a run written again replaces what it left before."""
    rows = failed_batches(batch, runs).select("run_id", "record")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").text(folder)
