"""Payloads of sources as a Spark data source, for batches and for streams.

A landing folder holds the payloads as lines of text (``write_batch``), by adapter
type, bucket of the source and batch; a line begins with its source. Folders of a
single source (``source_id=``), whose lines are payloads alone, are read as well.
``spark.read.format("payloads").load(folder)`` lists the folder, not its content: a
task reads files of one adapter type and batch, up to ``TASK_BYTES`` of them, to
which each file adds ``OPEN_BYTES`` for being opened. So files and tasks grow with
the payloads, not with the number of sources, and a large source is many files.
Filters on adapter_type, source_id and batch are pushed into the listing, so other
buckets are never opened, and other sources of a bucket are left out as it is read. As
a stream its offsets are batch numbers: a batch is seen once its marker is written, a
restarted query goes on behind the last batch it has committed.

The folder must be one that pyarrow opens by its URI or path on every machine.
Defined results: a source without lines has no rows; empty lines are no payloads;
a batch written again replaces what ``write_batch`` wrote of the same sources before and
keeps its other sources; null payloads are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote, unquote_plus
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from hearthlake.session import spread
from hearthlake.sources import registry

FORMAT = "payloads"
SCHEMA = "adapter_type string, source_id string, batch long, payload string"
TASK_BYTES, READ_BYTES, OPEN_BYTES = 64 << 20, 4 << 20, 64 << 10
#: Sources that are named to a scan; more of them are picked by a join.
NAMED_SOURCES = 1000
#: Buckets of sources, parts that a bucket is written in, and lines of a file.
BUCKETS, PARTS, FILE_LINES = 16, 8, 200_000
NO_SOURCE = "__HIVE_DEFAULT_PARTITION__"
DONE = "_done"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return pafs.LocalFileSystem(), folder


def _folders(fs: pafs.FileSystem, path: str, key: str) -> list[tuple[str, str]]:
    """Values and paths of the folders ``key=value`` below a path."""
    below = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    named = [(i.base_name, i.path) for i in below if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{key}=")]
    return sorted((unquote(name[len(key) + 1 :]), p) for name, p in named)


class Files(InputPartition):
    """Files (source_id, or none where the lines tell it, and path) of one adapter type and batch that a task reads, and the wanted sources, if not all."""

    def __init__(self, adapter_type: str, batch: int, files: list[tuple[str | None, str]], sources: set[str] | None):
        self.adapter_type, self.batch, self.files, self.sources = adapter_type, batch, files, sources


def _plan(folder: str, wanted: dict[str, set], after: int | None = None, upto: int | None = None) -> list[Files]:
    """Tasks for the files of the wanted types, sources and batches."""
    fs, root = _open(folder)
    asked = lambda key, value: key not in wanted or value in wanted[key]
    sources = wanted.get("source_id")
    buckets = None if sources is None else {crc32(s.encode()) % BUCKETS for s in sources if isinstance(s, str)}
    out = []
    for kind, kind_path in _folders(fs, root, "adapter_type"):
        if not asked("adapter_type", kind):
            continue
        places = [(None, path) for bucket, path in _folders(fs, kind_path, "bucket") if buckets is None or int(bucket) in buckets]
        places += [(source, path) for source, path in _folders(fs, kind_path, "source_id") if asked("source_id", source)]
        open_: dict[int, tuple[list[tuple[str | None, str]], int]] = {}
        for source, place in places:
            for batch, batch_path in _folders(fs, place, "batch"):
                number = int(batch)
                if not asked("batch", number) or (after is not None and number <= after) or (upto is not None and number > upto):
                    continue
                held, size = open_.get(number, ([], 0))
                for info in sorted(fs.get_file_info(pafs.FileSelector(batch_path)), key=lambda i: i.path):
                    if info.type != pafs.FileType.File or info.base_name[0] in "_.":
                        continue
                    cost = info.size + OPEN_BYTES
                    if held and size + cost > TASK_BYTES:
                        out.append(Files(kind, number, held, sources))
                        held, size = [], 0
                    held.append((source, info.path))
                    size += cost
                open_[number] = held, size
        out += [Files(kind, number, held, sources) for number, (held, _) in sorted(open_.items()) if held]
    return out


def _lines(fs: pafs.FileSystem, path: str) -> Iterator[list[str]]:
    """The lines of a file, a few megabytes at a time."""
    with fs.open_input_stream(path) as stream:
        rest = b""
        while block := stream.read(READ_BYTES):
            *whole, rest = (rest + block).split(b"\n")
            if whole:
                yield [x.decode() for x in whole if x]
        if rest:
            yield [rest.decode()]


def _read(folder: str, part: Files, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a task's files; small files share a batch of rows."""
    fs, _ = _open(folder)

    def batch(sources: list[str], lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        made = {"adapter_type": pa.repeat(part.adapter_type, n), "source_id": pa.array(sources, pa.string()), "batch": pa.repeat(pa.scalar(part.batch, pa.int64()), n), "payload": pa.array(lines, pa.string())}
        return pa.RecordBatch.from_arrays([made[c] for c in columns], names=columns)

    sources, held, size = [], [], 0
    for source, path in part.files:
        for lines in _lines(fs, path):
            if source is None:
                told = [(unquote_plus(of), payload) for of, _, payload in (line.partition("\t") for line in lines)]
                told = [x for x in told if part.sources is None or x[0] in part.sources]
                sources += [of for of, _ in told]
                lines = [payload for _, payload in told]
            else:
                sources += [source] * len(lines)
            held += lines
            size += sum(map(len, lines))
            if size >= READ_BYTES:
                yield batch(sources, held)
                sources, held, size = [], [], 0
    if held:
        yield batch(sources, held)


class PayloadReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.columns, self.wanted = folder, schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("adapter_type", "source_id", "batch"):
                key = f.attribute[0]
                self.wanted[key] = self.wanted[key] & values if key in self.wanted else values
            else:
                yield f  # Spark evaluates it

    def partitions(self) -> list[Files]:
        return _plan(self.folder, self.wanted)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition, self.columns) if partition is not None else iter(())


class PayloadStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.columns = folder, schema.names

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        fs, root = _open(self.folder)
        done = fs.get_file_info(pafs.FileSelector(f"{root}/{DONE}", allow_not_found=True))
        return {"batch": max((int(i.base_name) for i in done if i.base_name.isdigit()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _plan(self.folder, {}, start["batch"], end["batch"])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition, self.columns)


class PayloadSource(DataSource):
    """The data source ``payloads``; its one option is the folder, ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PayloadReader:
        return PayloadReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> PayloadStreamReader:
        return PayloadStreamReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)


def write_batch(payloads: DataFrame, folder: str, batch: int) -> None:
    """Land payloads (adapter_type, source_id, payload) as a batch, and mark it as complete."""
    spark = payloads.sparkSession
    rows = payloads.filter("payload is not null").select(F.when(F.col("adapter_type") == "", NO_SOURCE).otherwise(F.coalesce("adapter_type", F.lit("none"))).alias("adapter_type"), F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), F.lit(NO_SOURCE)).alias("source_id"), F.regexp_replace("payload", r"[\r\n]+", " ").alias("payload"))
    rows = rows.filter("payload <> ''")
    if _plan(folder, {"batch": {batch}}):
        # Buckets are replaced whole: sources that are not written again are carried over.
        again = rows.select("adapter_type", "source_id").distinct()
        before = spark.read.format(FORMAT).load(folder).filter(F.col("batch") == batch).select("adapter_type", "source_id", "payload")
        rows = rows.unionByName(before.join(again, ["adapter_type", "source_id"], "left_anti"))
    line = F.concat(F.url_encode("source_id"), F.lit("\t"), "payload")
    dealt = rows.select(line.alias("value"), "adapter_type", F.pmod(F.crc32(F.encode("source_id", "UTF-8")), F.lit(BUCKETS)).alias("bucket"), F.lit(batch).alias("batch"), F.pmod(F.xxhash64("payload"), F.lit(PARTS)).alias("part"))
    dealt = spread(dealt, "adapter_type", "bucket", "part").drop("part")
    dealt.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_LINES).mode("overwrite").partitionBy("adapter_type", "bucket", "batch").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{DONE}/{batch}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


def read_listings(spark: SparkSession, folder: str, sources: DataFrame) -> DataFrame:
    """Listings of all enabled sources with a known kind from the landing folder.

    Up to ``NAMED_SOURCES`` enabled sources are named to the scan, which opens no others;
    of more of them the scan reads the known kinds, and the join with the sources picks.
    """
    known = sources.filter(F.col("enabled") & F.col("adapter_type").isin(list(registry.READERS))).withColumn("id", F.col("id").cast("string"))
    ids = [r[0] for r in known.select("id").limit(NAMED_SOURCES + 1).collect()]
    rows = spark.read.format(FORMAT).load(folder).filter(F.col("adapter_type").isin(list(registry.READERS)))
    if len(ids) <= NAMED_SOURCES:
        rows = rows.filter(F.col("source_id").isin(ids))
    return registry.read_sources(rows.select("source_id", "payload"), known)
