"""Versioned snapshots of keyed tables: a folder per version and a pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotStore:
    """Tables under a root path that only Spark's file systems need to reach.

    A write makes a new version and then appends one row to the pointer table;
    a reader takes the version of the newest row. A write that dies half-way is
    never pointed at. One writer at a time is assumed.
    """

    POINTER = "table string, version long, rows long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointers")
        exists = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.POINTER).json(f"{self.root}/_pointers") if exists else None

    def version(self, table: str) -> int:
        pointers = self._pointers()
        row = pointers.filter(F.col("table") == table).agg(F.max("version")).first() if pointers is not None else None
        return int(row[0]) if row and row[0] is not None else 0

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The current version, or an empty table."""
        v = self.version(table)
        if not v:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v={v}")

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write a new version and point to it."""
        v = self.version(table) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/v={v}")
        self.spark.createDataFrame([(table, v, -1)], self.POINTER).coalesce(1).write.mode("append").json(f"{self.root}/_pointers")
        return v

    def append(self, table: str, df: DataFrame, batch_id: int) -> None:
        """Append rows of a batch; writing the same batch again replaces it."""
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_id}")

    def read_appended(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")


def copy_tables(source: SnapshotStore, target: SnapshotStore, schemas: dict[str, StructType | str], insert_only: dict[str, list[str]] | None = None) -> None:
    """Copy tables in the given order, parents first; tables named in ``insert_only`` (with their keys) keep the rows they have."""
    from hearthlake.operators.merge import insert_ignore

    for table, schema in schemas.items():
        rows, keys = source.read(table, schema), (insert_only or {}).get(table)
        target.write(table, insert_ignore(target.read(table, schema), rows, keys) if keys else rows)
