"""The merge table: crashes between writes, repeated batches, two writers, and how much a batch rewrites."""

from __future__ import annotations

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import BATCH, DETAIL, SNAPSHOT, batch

from hearthlake.operators import merge
from hearthlake.sources.merge_table import STATE_EVERY, MergeTable
from hearthlake.streaming import ingest


class Crash(Exception):
    pass


def table(spark, path, **options):
    return MergeTable(spark, str(path), SNAPSHOT, DETAIL, **options)


def put(t, rows, name, day=1):
    return t.merge(rows, name, F.lit(pd.Timestamp(f"2024-01-{day:02d}")), F.lit(f"r-{name}"))


def content(t):
    """Listings, events and prices as sorted plain rows."""
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    return rows(t.read()), rows(t.events()), rows(t.prices())


def days(spark):
    """Three batches: a price moves, a listing comes, details change."""
    card, detail = {"source_listing_id": "1", "price_monthly": 3000.0}, {"source_listing_id": "2", "price_monthly": 10.0, "fetch_depth": "detail", "description": "d", "content_hash": "h"}
    return [batch(spark, card, detail), batch(spark, card | {"price_monthly": 2800.0}, {"source_listing_id": "3", "price_monthly": 1.0}), batch(spark, detail | {"content_hash": "h2", "description": "e"}, card | {"price_monthly": 2700.0})]


@pytest.mark.parametrize("at", ["listings", "events", "prices", "commit", "after"])
def test_a_crash_between_any_two_writes_changes_nothing(spark, tmp_path, at):
    whole = table(spark, tmp_path / "whole")
    t = table(spark, tmp_path / "crashing")
    for n, rows in enumerate(days(spark)):
        put(whole, rows, f"b{n}", n + 1)
        before = content(t)

        def stop(name):
            if name == at:
                raise Crash(name)

        t._step = stop
        if at == "after":
            put(t, rows, f"b{n}", n + 1)  # committed, but the caller dies before it takes note
        else:
            with pytest.raises(Crash):
                put(t, rows, f"b{n}", n + 1)
            assert content(t) == before
        t = table(spark, tmp_path / "crashing")  # a new process
        put(t, rows, f"b{n}", n + 1)
    assert content(t) == content(whole) and t.state().version == 3
    kinds = sorted(e.event_type for e in t.events().collect())
    assert kinds == ["content_change", "first_seen", "first_seen", "first_seen", "price_change", "price_change"]
    assert len({e.event_id for e in t.events().collect()}) == 6 and t.prices().count() == 5


def test_an_old_batch_that_comes_again_stays_merged_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for n, rows in enumerate(days(spark)):
        put(t, rows, f"b{n}", n + 1)
    done = content(t)
    again = put(t, days(spark)[0], "b0", 9)
    assert content(t) == done and again["version"] == 1 and again["counts"]["n_new"] == 2
    assert [e["before"] for e in t.entries()] == [0, 1, 2]
    assert {r.source_listing_id: r.price_monthly for r in t.read(version=1).collect()} == {"1": 3000.0, "2": 10.0}


def test_two_writers_take_turns(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    rows = days(spark)
    put(one, rows[0], "b0")
    met, errors = threading.Barrier(2), []

    waited = set()

    def together(name):  # both have merged from version 1 before either commits
        if name == "commit" and threading.get_ident() not in waited:
            waited.add(threading.get_ident())
            met.wait(120)

    def work(t, rows, name):
        try:
            t._step = together
            put(t, rows, name, 2)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work, args=a) for a in ((one, rows[1], "left"), (two, rows[2], "right"))]
    for x in threads:
        x.start()
    for x in threads:
        x.join(180)
    assert not errors
    assert sorted(e["batch"] for e in one.entries()) == ["b0", "left", "right"] and [e["before"] for e in one.entries()] == [0, 1, 2]
    got = {r.source_listing_id: (r.price_monthly, r.description) for r in one.read().collect()}
    assert got["2"] == (10.0, "e") and got["3"] == (1.0, None) and got["1"][0] in (2800.0, 2700.0)
    changes = [e.new_value for e in one.events().filter("event_type = 'price_change'").collect()]
    assert sorted(changes) == ["2700", "2800"]  # the second writer saw what the first one wrote


def test_a_small_batch_rewrites_few_files(spark, tmp_path):
    fields = [c.split(" ")[0] for c in BATCH.split(", ")]
    kinds = dict(c.split(" ", 1) for c in BATCH.split(", "))

    def rows(n, where="true", price=1.0):
        made = {"source_id": F.format_string("s%02d", F.col("id") % 40), "source_listing_id": F.format_string("%06d", "id"), "price_monthly": F.lit(price), "title": F.lit("T"), "listing_status": F.lit("active"), "fetch_depth": F.lit("card"), "batch_pos": F.col("id")}
        return spark.range(n).filter(where).select(*(made.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in fields))

    t = table(spark, tmp_path, rows_per_file=500)
    put(t, rows(20_000), "all")
    files = t.state().files
    assert len(files) >= 40 and sum(f["rows"] for f in files.values()) == 20_000
    spans = sorted((f["first"], f["last"]) for f in files.values())
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    entry = put(t, rows(20_000, "id % 40 = 7 and id < 8000", 2.0), "one percent", 2)  # 200 rows of one source
    assert 1 <= len(entry["remove"]) <= 3 and sum(f["rows"] for f in entry["add"].values()) < 2000
    assert set(files) - set(entry["remove"]) <= set(t.state().files)
    assert entry["counts"] == {"n_new": 0, "n_changed": 200, "n_unchanged": 0, "n_price_changes": 200, "n_reappeared": 0, "n_observed": 200}
    put(t, rows(20_500, "id >= 19990", 3.0), "new keys", 3)
    got = t.read().groupBy("price_monthly").count().collect()
    assert {r.price_monthly: r["count"] for r in got} == {1.0: 20_000 - 200 - 10, 2.0: 200, 3.0: 510}
    spans = sorted((f["first"], f["last"]) for f in t.state().files.values())
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_states_empty_batches_and_rows_without_keys(spark, tmp_path):
    t = table(spark, tmp_path)
    assert put(t, batch(spark), "none")["add"] == {} and t.read().count() == 0
    put(t, batch(spark, {"source_listing_id": None}, {"source_listing_id": "1", "price_monthly": 1.0}, {"source_listing_id": "1", "price_monthly": 2.0}), "some")
    assert [r.price_monthly for r in t.read().collect()] == [2.0]
    for n in range(STATE_EVERY):
        put(t, batch(spark), f"empty {n}")
    assert any(n.endswith(".state") for n in t.log.names()) and t.state().version == STATE_EVERY + 2 and t.read().count() == 1
    assert t.read(version=1).count() == 0


def test_observed_counters_equal_counted_ones_in_one_job(spark):
    rows = merge.fold_batch(days(spark)[1], DETAIL)
    merged = merge.merge_batch(spark.createDataFrame([], SNAPSHOT), rows, F.lit(pd.Timestamp("2024-01-01")), F.lit("r"), DETAIL)
    seen, counts = merge.observed(merged)
    seen.collect()
    assert dict(counts.get) == merge.run_counters(merged).first().asDict()


def test_stream_merges_each_batch_once(spark, tmp_path):
    source, t = str(tmp_path / "in"), table(spark, tmp_path / "table")
    rows = batch(spark, {"source_listing_id": "1", "price_monthly": 1.0}).withColumn("observed_at", F.lit(pd.Timestamp("2024-01-01")))

    def run(checkpoint):
        ingest.merge_stream(spark.readStream.schema(rows.schema).parquet(source), t, str(tmp_path / checkpoint)).awaitTermination(120)

    for day, price in ((1, 1.0), (2, 2.0)):
        rows.withColumns({"price_monthly": F.lit(price), "observed_at": F.lit(pd.Timestamp(f"2024-01-0{day}"))}).write.mode("append").parquet(source)
        run("ck")
    done = content(t)
    assert [r.price_monthly for r in t.read().collect()] == [2.0] and t.prices().count() == 2
    assert sorted(e.event_type for e in t.events().collect()) == ["first_seen", "price_change"]
    commit = tmp_path / "ck" / "commits" / "1"  # the stream died after the merge and before its own commit
    commit.unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    run("ck")
    assert content(t) == done and t.state().version == 2
