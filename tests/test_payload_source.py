"""The data source of landed payloads: rows, pruning by source, offsets of a stream."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hearthlake.sources import payload_source, registry

ROWS = [("posts_json", "a", '[{"id":1,\n"x":"ä"}]'), ("posts_json", "a", "second"), ("unit_types_json", "b/c d=e%", "third"), (None, "n", "kindless"), ("posts_json", "z", None), ("posts_json", "e", "")]
PAYLOADS = "adapter_type string, source_id string, payload string"


@pytest.fixture
def landed(spark, tmp_path):
    payload_source.register(spark)
    folder = f"file://{tmp_path}/landing"
    payload_source.write_batch(spark.createDataFrame(ROWS, PAYLOADS), folder, 0)
    return folder


def test_rows_of_all_sources(spark, landed):
    rows = spark.read.format("payloads").load(landed)
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [("none", "n", 0, "kindless"), ("posts_json", "a", 0, '[{"id":1, "x":"ä"}]'), ("posts_json", "a", 0, "second"), ("unit_types_json", "b/c d=e%", 0, "third")]
    assert sorted(r[0] for r in rows.select("payload").collect()) == sorted(r[3] for r in got)
    payload_source.write_batch(spark.createDataFrame([("posts_json", "a", "again")], PAYLOADS), landed, 0)  # replaces that source's batch
    assert [r.payload for r in spark.read.format("payloads").load(landed).filter("source_id = 'a'").collect()] == ["again"]
    assert spark.read.format("payloads").load(landed + "/nothing").count() == 0


def test_filters_prune_sources_before_they_are_opened(spark, landed):
    folder = landed.removeprefix("file://")
    whole = spark.read.format("payloads").load(landed).rdd.getNumPartitions()
    one = spark.read.format("payloads").load(landed).filter(F.col("source_id").isin("a", "q") & (F.col("adapter_type") == "posts_json") & F.col("payload").contains("sec"))
    assert [r.payload for r in one.collect()] == ["second"] and one.rdd.getNumPartitions() < whole
    for path, _, names in os.walk(f"{folder}/adapter_type=unit_types_json"):
        for name in names:
            if name.endswith(".txt"):
                os.chmod(f"{path}/{name}", 0)
                os.rename(f"{path}/{name}", f"{path}/{name}.gone")
                os.mkdir(f"{path}/{name}")  # reading it would fail
    assert spark.read.format("payloads").load(landed).filter("source_id = 'a'").count() == 2
    assert spark.read.format("payloads").load(landed).filter("source_id = 'a' and source_id = 'n'").count() == 0
    assert spark.read.format("payloads").load(landed).filter("batch = 7").count() == 0


def test_large_sources_are_several_tasks(spark, landed, monkeypatch):
    many = spark.range(400).select(F.lit("posts_json").alias("adapter_type"), F.lit("hot").alias("source_id"), F.concat(F.lit("line "), "id").alias("payload")).repartition(8)
    payload_source.write_batch(many, landed, 3)
    monkeypatch.setattr(payload_source, "TASK_BYTES", 1000)
    monkeypatch.setattr(payload_source, "READ_BYTES", 7)
    plan = [p for p in payload_source._plan(landed, {"source_id": {"hot"}})]
    assert len(plan) >= 4 and all(p.batch == 3 for p in plan)
    lines = [x for p in plan for b in payload_source._read(landed, p, ["payload"]) for x in b.column(0).to_pylist()]
    assert sorted(lines) == sorted(f"line {i}" for i in range(400))


def test_stream_goes_on_behind_its_last_batch(spark, landed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.format("payloads").load(landed)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.source_id, r.batch, r.payload) for r in spark.read.parquet(out).collect())

    assert len(run()) == 4
    payload_source.write_batch(spark.createDataFrame([("posts_json", "a", "new"), ("posts_json", "y", "other")], PAYLOADS), landed, 1)
    rows = spark.createDataFrame([("posts_json", "a", "not yet")], PAYLOADS).select(F.col("payload").alias("value"), "adapter_type", "source_id", F.lit(2).alias("batch"))
    rows.write.mode("append").partitionBy("adapter_type", "source_id", "batch").text(landed)  # lands, but is not marked as complete
    got = run()
    assert len(got) == 6 and ("a", 1, "new") in got and not any(b == 2 for _, b, _ in got)
    assert run() == got


def test_listings_come_from_enabled_sources_only(spark, tmp_path):
    payload_source.register(spark)
    folder = str(tmp_path / "plain path")
    posts = '[{"id":5,"link":"l","title":{"rendered":"<b>Flat</b>"},"content":{"rendered":"<p>2 bedroom for $3,500</p>"}}]'
    payload_source.write_batch(spark.createDataFrame([("posts_json", "1", posts), ("posts_json", "2", posts.replace("5", "6", 1)), ("odd", "3", "x")], PAYLOADS), folder, 0)
    sources = spark.createDataFrame([(1, "posts_json", True), (2, "posts_json", False), (3, "odd", True)], "id long, adapter_type string, enabled boolean")
    got = payload_source.read_listings(spark, folder, sources).select("source_listing_id", "title", "adapter_type").collect()
    assert [tuple(r) for r in got] == [("5", "Flat", "posts_json")] and "posts_json" in registry.READERS


def test_files_and_tasks_do_not_grow_with_the_sources(spark, tmp_path):
    payload_source.register(spark)
    folder = str(tmp_path / "many")
    rows = spark.range(3000).select(F.lit("posts_json").alias("adapter_type"), F.concat(F.lit("s "), "id").alias("source_id"), F.concat(F.lit("p\t"), "id").alias("payload"))
    payload_source.write_batch(rows, folder, 0)
    landed = spark.read.format("payloads").load(folder)
    assert landed.rdd.getNumPartitions() == 1 and sum(n.endswith(".txt") for _, _, names in os.walk(folder) for n in names) <= payload_source.BUCKETS * payload_source.PARTS
    assert landed.select("source_id", "payload").exceptAll(rows.select("source_id", "payload")).count() == 0 and landed.count() == 3000
    payload_source.write_batch(rows.limit(0).unionByName(spark.createDataFrame([("posts_json", "s 7", "again")], PAYLOADS).select(rows.columns)), folder, 0)
    assert [r.payload for r in spark.read.format("payloads").load(folder).filter("source_id = 's 7'").collect()] == ["again"]
    assert spark.read.format("payloads").load(folder).count() == 3000  # the other sources of its bucket stay


def test_more_sources_than_a_scan_names_are_joined(spark, tmp_path, monkeypatch):
    payload_source.register(spark)
    monkeypatch.setattr(payload_source, "NAMED_SOURCES", 1)
    post = '[{"id":%d,"link":"l","title":{"rendered":"T"},"content":{"rendered":"x"}}]'
    payload_source.write_batch(spark.createDataFrame([("posts_json", str(i), post % i) for i in range(4)], PAYLOADS), str(tmp_path), 0)
    sources = spark.createDataFrame([(i, "posts_json", i != 2) for i in range(4)], "id long, adapter_type string, enabled boolean")
    got = payload_source.read_listings(spark, str(tmp_path), sources).select("source_listing_id").collect()
    assert sorted(r[0] for r in got) == ["0", "1", "3"]
