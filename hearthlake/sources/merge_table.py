"""A keyed table that is merged batch by batch: copy on write by key range, one atomic log entry a batch.

The current rows lie in files that each own a range of keys. A batch names keys; only the
files that own one of them are read, merged and written anew, all others stay as
they are. Everything that a batch writes, the new files, its events and its price
observations, goes to folders that nobody knows until one entry of the log
names them. The entry of version v can be put once only, so

- an attempt that dies between two writes leaves nothing to be seen, and the
  batch, when it comes again, starts from the version it started from before;
- a batch whose entry is there is not merged a second time, whatever else has
  been committed since;
- of two writers of one version one finds the entry taken and merges its batch
  again, from the version of the other.

An entry holds the batch, the versions before and after, the files that came and
went with the first and last key and the rows of each, the folders of events and
prices, and the run's counters. Every ``STATE_EVERY`` versions the whole state is
kept beside the log, so a reader takes one state and a few entries. The list of
files is as long as the one that Spark's own scan of the table keeps on the driver.

Defined results: rows without a whole key are left out; an empty batch is
committed with no change; folders of attempts that failed are named by no entry and
may be deleted at any time.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from bisect import bisect_right
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthlake.operators import merge

STATE_EVERY = 20
EVENTS = "event_id string, listing_id string, run_id string, event_type string, old_value string, new_value string, created_at timestamp"
PRICES = "price_id string, listing_id string, price_monthly double, price_effective_monthly double, run_id string, observed_at timestamp"


class CommitLog:
    """Numbered entries under a folder, each put once only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("")))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, content: dict) -> bool:
        """Put a whole file of that name, unless there is one; whether it was put."""
        draft = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = self._path(name)
        try:
            if self._fs.getUri().getScheme() == "file":
                # A link fails where the name is taken, which a rename of local files does not.
                plain = lambda path: unquote(urlparse(path.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString()).path)
                try:
                    os.link(plain(draft), plain(target))
                except FileExistsError:
                    return False
                return True
            # Renaming refuses a name that is taken, in one step on file systems that can.
            if self._fs.exists(target):
                return False
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            try:
                context.rename(draft, target, self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            except Exception as error:
                if self._fs.exists(target) and "exist" in str(error).lower():
                    return False
                raise
            return True
        finally:
            self._fs.delete(draft, False)


@dataclass
class State:
    """What a version of the table consists of."""

    version: int = 0
    files: dict[str, dict] = field(default_factory=dict)  # by path: rows, first and last key
    batches: list[str] = field(default_factory=list)
    events: list[str] = field(default_factory=list)
    prices: list[str] = field(default_factory=list)

    def apply(self, entry: dict) -> None:
        for path in entry["remove"]:
            self.files.pop(path)
        self.files |= entry["add"]
        self.batches.append(entry["batch"])
        self.events += entry["events"]
        self.prices += entry["prices"]
        self.version = entry["version"]


class MergeTable:
    """Listings by (source_id, source_listing_id) under a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, detail_fields: list[str], rows_per_file: int = 1_000_000, retries: int = 20):
        self.spark, self.root, self.detail_fields, self.rows_per_file, self.retries = spark, root.rstrip("/"), detail_fields, rows_per_file, retries
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, f"{self.root}/_log")

    def state(self, version: int | None = None) -> State:
        """The state of a version, by default the newest one."""
        names = [n for n in self.log.names() if not n.startswith(".")]
        kept = [n for n in names if n.endswith(".state") and (version is None or int(n[:-6]) <= version)]
        state = State(**self.log.read(kept[-1])) if kept else State()
        for name in (n for n in names if n.endswith(".json")):
            if state.version < int(name[:-5]) and (version is None or int(name[:-5]) <= version):
                state.apply(self.log.read(name))
        return state

    def entries(self) -> list[dict]:
        """All log entries, the oldest first."""
        return [self.log.read(n) for n in self.log.names() if n.endswith(".json") and not n.startswith(".")]

    def _load(self, schema, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._load(self.schema, sorted(self.state(version).files))

    def events(self) -> DataFrame:
        return self._load(EVENTS, self.state().events)

    def prices(self) -> DataFrame:
        return self._load(PRICES, self.state().prices)

    def _step(self, name: str) -> None:
        """Called before every write; tests stop an attempt here."""

    def merge(self, batch: DataFrame, batch_id: str, now: Column, run_id: Column) -> dict:
        """Merge a batch as ``merge.fold_batch`` takes it; returns its log entry, the old one where it is committed already."""
        for _ in range(self.retries):
            state = self.state()
            if batch_id in state.batches:
                return next(e for e in reversed(self.entries()) if e["batch"] == batch_id)
            entry = self._attempt(state, batch, batch_id, now, run_id)
            self._step("commit")
            if self.log.put(f"{entry['version']:020d}.json", entry):
                if entry["version"] % STATE_EVERY == 0:
                    state.apply(entry)
                    self.log.put(f"{entry['version']:020d}.state", vars(state))
                return entry
        raise RuntimeError(f"batch {batch_id}: {self.retries} versions were taken by other writers")

    def _attempt(self, state: State, batch: DataFrame, batch_id: str, now: Column, run_id: Column) -> dict:
        """Write what the batch makes of a version; nothing of it can be seen yet."""
        owned = sorted((tuple(f["first"]), path) for path, f in state.files.items())
        firsts = [first for first, _ in owned]

        @F.pandas_udf("int")
        def owner(source: pd.Series, listing: pd.Series) -> pd.Series:
            # A file owns the keys from its first one on to that of the next file; the first file also those before it.
            return pd.Series([max(bisect_right(firsts, key) - 1, 0) for key in zip(source, listing, strict=True)], dtype="int32")

        folded = merge.fold_batch(batch.filter("source_id is not null and source_listing_id is not null"), self.detail_fields)
        touched = sorted(r[0] for r in folded.select(owner(*merge.KEY).alias("owner")).distinct().collect())
        paths = [owned[i][1] for i in touched if owned]
        merged = merge.merge_batch(self._load(self.schema, paths), folded, now, run_id, self.detail_fields)
        stem = uuid.uuid4().hex
        made, columns = {}, [f.name for f in self.schema]
        entry = {"version": state.version + 1, "before": state.version, "batch": batch_id, "add": made, "remove": paths, "events": [], "prices": [], "counts": {}}
        if not touched:
            return entry
        size = sum(state.files[p]["rows"] for p in paths) + folded.count()
        rows = merged.select(*columns, "change").withColumn("owner", owner(*merge.KEY))
        self._step("listings")
        target = f"{self.root}/listings/{stem}"
        parts = max(1, math.ceil(size / self.rows_per_file))
        # A file never holds keys of two owners, and files of one owner follow each other.
        laid, counts = merge.observed(rows.repartitionByRange(parts, "owner", *merge.KEY).sortWithinPartitions("owner", *merge.KEY))
        laid.write.option("maxRecordsPerFile", self.rows_per_file).partitionBy("owner").parquet(target)
        # What comes next reads what was written, so a lost executor costs no second merge.
        written = self.spark.read.schema(StructType([*self.schema.fields, merged.schema["change"]])).parquet(target)
        key = F.struct(*merge.KEY)
        stats = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        made |= {r["path"]: {"rows": r["rows"], "first": list(r["first"]), "last": list(r["last"])} for r in stats.collect()}
        for name, rows in (("events", merge.events_of(written, now, run_id)), ("prices", merge.price_observations(written, now, run_id))):
            self._step(name)
            rows.write.parquet(f"{self.root}/{name}/{stem}")
            entry[name] = [f"{self.root}/{name}/{stem}"]
        entry["counts"] = dict(counts.get)
        return entry
