"""Session factory and helpers that touch session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "hearthlake", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC and adaptive execution.

    The number of shuffle partitions is left to the cluster unless it is given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster. Without it a temporary folder
    serves a local master, whose executor is the driver; any other one is refused.
    What lies there goes with the application's folder, which Spark names anew for each.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hearthlake-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; a
    temporary folder is used only where none is set, as in local tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Deal rows to as many tasks as the cluster has work for, by their keys, before costly steps; ``tasks``: instead of the number of shuffle partitions.

    A small file is read by one task, and all that follows without a shuffle would run in it.
    Narrow rows are dealt, before texts are made of them.
    """
    spark = rows.sparkSession
    return rows.repartition(max(shuffle_partitions(spark) if tasks is None else tasks, 2 * spark.sparkContext.defaultParallelism), *keys)


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Like ``materialize``, for wide rows: columns are compressed and read selectively.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
