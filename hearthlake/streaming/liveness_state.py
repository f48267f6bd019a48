"""Liveness as keyed state: listings that a trusted run has not seen move on a step, whatever batches bring the rows.

Two kinds of rows arrive: sightings (source_id, listing_id, run_no) and ends of runs
(source_id, run_no, without a listing, and whether the run can be trusted). The key is
the source and one of ``buckets`` parts of its listings, so a large source is many
keys; the end of a run goes to every part of its source.

A part's state is a map of its listings, with the run that saw each one last and
the steps it had taken by then, and its latest three trusted runs. A listing's status is
the number of steps and of trusted runs after its last sighting, and three are as
many as the chain can tell apart. So the state does not depend on the order of
rows: a sighting that arrives behind the end of its run puts the listing back.

A timer is set at each run's end. If no other run of the source ends before it
expires, a row with the status ``run_overdue`` tells so; no listing moves because
of a run that never came. A query with timers runs until it is stopped.

``initial`` brings the statuses of a snapshot and the run that it was taken after.
Statuses outside the chain stay as they are until the listing is seen.
Defined results: rows without a source, a run or both a listing and a trust are
ignored; repeated rows change nothing; listings that were never seen have no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthlake.operators.liveness import STEPS

#: The chain by the number of trusted runs that missed a listing.
CHAIN = ["active", "missing_once", "missing_multiple_runs", "likely_unavailable"]
TAKEN = {"active": 0, "still_seen": 0, "unknown": 0} | {s: n for n, s in enumerate(CHAIN)}
OUTPUT = "source_id string, listing_id string, status string, last_seen_run long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
assert set(STEPS) == set(TAKEN)


class Liveness(StatefulProcessor):
    """State of one part of a source's listings."""

    def __init__(self, overdue_ms: int | None):
        self.overdue_ms = overdue_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.listings = handle.getMapState("listings", "listing_id string", "last_run long, steps int, other string")
        self.runs = handle.getValueState("runs", "latest array<long>")

    def _latest(self) -> list[int]:
        return list(self.runs.get()[0]) if self.runs.exists() else []

    @staticmethod
    def _status(last_run: int, steps: int, other: str | None, runs: list[int]) -> str:
        return other or CHAIN[min(steps + sum(r > last_run for r in runs), len(CHAIN) - 1)]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            other = None if r.stale_status in TAKEN else r.stale_status
            self.listings.updateValue((r.listing_id,), (int(r.as_of_run), TAKEN.get(r.stale_status, 0), other))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._latest()
        seen: dict[str, int] = {}
        ended: set[int] = set()
        for part in rows:
            sightings = part[part["listing_id"].notna()]
            for listing, run in sightings.groupby("listing_id")["run_no"].max().items():
                seen[listing] = max(int(run), seen.get(listing, -1))
            ended |= set(part.loc[part["listing_id"].isna() & part["trusted"].eq(True), "run_no"].astype(int))
            if part["listing_id"].isna().any():
                self._set_timer(timerValues)
        runs = sorted(set(before) | ended)[-3:]
        out, moved = [], set()
        for listing, run in seen.items():
            old = self.listings.getValue((listing,)) if self.listings.containsKey((listing,)) else None
            if old is None or run > old[0]:
                moved.add(listing)
                self.listings.updateValue((listing,), (run, 0, None))
                was = None if old is None else self._status(*old, before)
                now = self._status(run, 0, None, runs)
                if was != now or old is None:
                    out.append((key[0], listing, now, run))
        if runs != before:
            self.runs.update((runs,))
            for (listing,), state in self.listings.iterator():
                now = self._status(*state, runs)
                if listing not in moved and now != self._status(*state, before):
                    out.append((key[0], listing, now, state[0]))
        yield pd.DataFrame(out, columns=["source_id", "listing_id", "status", "last_seen_run"])

    def _set_timer(self, timerValues) -> None:
        if self.overdue_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Every part of a source has the timer; one of them tells.
        rows = [(key[0], None, "run_overdue", max(self._latest(), default=-1))] if key[1] == 0 else []
        yield pd.DataFrame(rows, columns=["source_id", "listing_id", "status", "last_seen_run"]).astype({"last_seen_run": "int64"})


def liveness_stream(rows: DataFrame, initial: DataFrame | None = None, buckets: int = 64, overdue_hours: float | None = None) -> DataFrame:
    """Changes of status: rows (source_id, listing_id, status, last_seen_run), output mode ``update``.

    rows (source_id, listing_id, run_no, trusted) as a stream; initial (source_id,
    listing_id, stale_status, as_of_run), one row a listing.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    part = F.pmod(F.xxhash64("listing_id"), F.lit(buckets)).cast("int")
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = rows.filter("source_id is not null and run_no is not null").select(
        F.col("source_id").cast("string").alias("source_id"), F.col("listing_id").cast("string").alias("listing_id"), F.col("run_no").cast("long").alias("run_no"), F.col("trusted").cast("boolean").alias("trusted"),
        F.explode(F.when(F.col("listing_id").isNull(), every).otherwise(F.array(part))).alias("bucket"),
    )
    first = None
    if initial is not None:
        first = initial.select(F.col("source_id").cast("string").alias("source_id"), F.col("listing_id").cast("string").alias("listing_id"), "stale_status", F.col("as_of_run").cast("long").alias("as_of_run"), part.alias("bucket")).groupBy("source_id", "bucket")
    overdue = None if overdue_hours is None else math.ceil(overdue_hours * 3_600_000)
    return dealt.groupBy("source_id", "bucket").transformWithStateInPandas(Liveness(overdue), OUTPUT, "Update", "None" if overdue is None else "ProcessingTime", first)


def statuses(changes: DataFrame, version: str = "version") -> DataFrame:
    """The latest status of every listing from the changes that a stream has written, each with the number of its batch."""
    known = changes.filter("listing_id is not null")
    return known.groupBy("source_id", "listing_id").agg(F.max_by(F.struct("status", "last_seen_run"), version).alias("s")).select("source_id", "listing_id", "s.*")
