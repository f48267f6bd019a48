"""Liveness of listings across runs, and the status of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The chain of a listing that is no longer seen.
STEPS = {"active": "missing_once", "still_seen": "missing_once", "unknown": "missing_once", "missing_once": "missing_multiple_runs", "missing_multiple_runs": "likely_unavailable", "likely_unavailable": "likely_unavailable"}
MISSING = ["missing_once", "missing_multiple_runs", "likely_unavailable"]


def advance(status: Column) -> Column:
    """The next step of a missing listing; other values stay."""
    steps = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    return F.coalesce(F.try_element_at(steps, status), status)


def may_advance(run_status: Column, pagination_completed: Column) -> Column:
    """Only a full success that saw every page says anything about what is missing."""
    return (run_status == "success") & F.coalesce(pagination_completed, F.lit(False))


def run_status(fatal: Column, rows: Column, pagination_completed: Column, contract_errors: Column, details: Column, detail_failures: Column) -> Column:
    mostly_failed = (details >= 5) & (detail_failures > 0.3 * details)
    partial = (rows == 0) | (~F.coalesce(pagination_completed, F.lit(True))) | (contract_errors > 0) | mostly_failed
    return F.when(fatal.isNotNull(), "failed").when(partial, "partial").otherwise("success")


def advance_missing(snapshot: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """The snapshot after the runs of one round: what a trusted run has not seen moves on a step.

    snapshot (source_id, listing_id, last_seen_at, stale_status, missing_since,
    listing_status, ...); runs (source_id, started_at, status, pagination_completed), one per source.
    """
    trusted = runs.filter(may_advance(F.col("status"), F.col("pagination_completed"))).select("source_id", F.col("started_at").alias("__started"))
    met = snapshot.join(trusted, "source_id", "left")
    target = (F.col("last_seen_at") < F.col("__started")) & (F.col("stale_status") != "likely_unavailable") & (F.col("listing_status") == "active")
    target = F.coalesce(target, F.lit(False))
    out = met.withColumns({"missing_since": F.when(target, now).otherwise(F.col("missing_since")), "stale_status": F.when(target, advance(F.col("stale_status"))).otherwise(F.col("stale_status"))})
    return out.select(*snapshot.columns)


def chain_after(misses: Column) -> Column:
    """Status after so many runs in a row without a listing, from active."""
    return F.when(misses <= 0, "active").when(misses == 1, "missing_once").when(misses == 2, "missing_multiple_runs").otherwise("likely_unavailable")


def health_warnings(found: Column, last_success: Column, details: Column, with_photos: Column) -> Column:
    """Warnings about a run against the last good one."""
    from hearthlake.functions.scalars import compact

    return compact(
        F.when((last_success >= 10) & (found < 0.4 * last_success), "listing_count_drop"),
        F.when((details >= 10) & (with_photos < 0.2 * details), "photo_loss"),
    )
