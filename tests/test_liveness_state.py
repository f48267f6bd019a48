"""Liveness as a stream: several layouts of batches, restarts, an initial snapshot, late rows and runs that never come."""

from __future__ import annotations

import random
import time

import pytest

from hearthlake.operators.liveness import MISSING
from hearthlake.streaming import liveness_state as ls

ROWS = "source_id string, listing_id string, run_no long, trusted boolean"
SNAPSHOT = "source_id string, listing_id string, stale_status string, as_of_run long"


class Stream:
    """A folder that batches land in, and a query that takes a file at a time."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0

    def land(self, rows):
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def start(self, **trigger):
        stream = self.spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        changes = ls.liveness_stream(stream, buckets=3, **self.options)
        write = lambda df, n: df.selectExpr("*", f"{n}L as version").write.mode("overwrite").parquet(str(self.folder / f"out/batch={n}"))
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(self.folder / "ck")).trigger(**trigger).start()

    def run(self):
        assert self.start(availableNow=True).awaitTermination(120)
        return self

    def changes(self):
        return self.spark.read.parquet(str(self.folder / "out"))

    def statuses(self):
        return {(r.source_id, r.listing_id): r.status for r in ls.statuses(self.changes()).collect()}


def history(seed, runs=6, listings=8):
    """Rows of some runs of two sources, and the plain outcome."""
    draw = random.Random(seed)
    rows, state = [], {}
    for run in range(runs):
        for source in ("a", "b"):
            trusted = draw.random() < 0.8
            met = [f"l{i}" for i in range(listings) if draw.random() < 0.5]
            rows.append([(source, x, run, None) for x in met] + [(source, None, run, trusted)])
            for x in met:
                state[source, x] = 0
            for key in [k for k in state if trusted and k[0] == source and k[1] not in met]:
                state[key] = min(state[key] + 1, 3)
    return rows, {k: ls.CHAIN[n] for k, n in state.items()}


@pytest.mark.parametrize("layout", ["run by run", "all at once", "shuffled", "with a restart"])
def test_equal_to_the_plain_chain_in_any_layout(spark, tmp_path, layout):
    runs, want = history(3)
    stream = Stream(spark, tmp_path)
    if layout == "run by run":
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            stream.land(a + b)
    elif layout == "all at once":
        stream.land([r for rows in runs for r in rows])
    elif layout == "shuffled":  # ends of runs before their sightings, old runs behind new ones, rows twice
        rows = [r for part in runs for r in part] * 2
        random.Random(1).shuffle(rows)
        for k in range(3):
            stream.land(rows[k::3])
    else:
        stream.land([r for rows in runs[:5] for r in rows])
        stream.run()
        stream.land([r for rows in runs[5:] for r in rows])
    assert stream.run().statuses() == want
    assert {"active", *MISSING} == set(want.values()) | {"active", *MISSING} and len(set(want.values())) > 2


def test_a_snapshot_as_initial_state(spark, tmp_path):
    old = [("a", "one", "active", 5), ("a", "two", "missing_once", 5), ("a", "three", "missing_multiple_runs", 5), ("a", "gone", "likely_unavailable", 5), ("a", "odd", "expired", 5), ("b", "still", "active", 5)]
    stream = Stream(spark, tmp_path, initial=spark.createDataFrame(old, SNAPSHOT))
    stream.land([("a", "one", 6, None), ("a", "gone", 6, None), ("a", None, 6, True), ("a", None, 4, True), (None, "x", 6, None), ("a", "y", None, None)])  # run 4 is in the snapshot already
    got = stream.run().statuses()
    assert got == {("a", "one"): "active", ("a", "two"): "missing_multiple_runs", ("a", "three"): "likely_unavailable", ("a", "gone"): "active"} or got == {("a", "two"): "missing_multiple_runs", ("a", "three"): "likely_unavailable", ("a", "gone"): "active"}
    stream.land([("a", None, 7, False), ("a", "odd", 7, None), ("b", None, 7, None)])  # a run that cannot be trusted moves nothing
    got = stream.run().statuses()
    assert got["a", "odd"] == "active" and got["a", "two"] == "missing_multiple_runs" and ("b", "still") not in got


def test_a_run_that_never_comes_is_told_and_moves_nothing(spark, tmp_path):
    stream = Stream(spark, tmp_path, overdue_hours=0.5 / 3600)
    stream.land([("a", "x", 1, None), ("a", None, 1, True)])
    query = stream.start(processingTime="1 second")  # timers keep a query alive until it is stopped
    told, end = [], time.time() + 60
    try:
        while not told and time.time() < end:
            time.sleep(1)
            told = [(r.source_id, r.last_seen_run) for r in stream.changes().filter("status = 'run_overdue'").collect()] if (tmp_path / "out/batch=0/_SUCCESS").exists() else []
    finally:
        query.stop()
    assert told == [("a", 1)]
    assert stream.statuses() == {("a", "x"): "active"}
