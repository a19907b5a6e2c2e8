"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tillweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Without a stack trace per column expression, wide plans are built in about half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Where the session names none, a local one gets a temporary folder; a cluster is refused, as its executors
    wouldn't share that.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, and lost executors cost nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks per split of a scan that steps heavy per row are dealt over.
TASKS_PER_SPLIT = 16


def spread(scan: DataFrame) -> DataFrame:
    """A table scan in even partitions, ahead of steps that are heavy per row.

    A small table gets one partition per core. Otherwise a split of a Parquet file holds the row groups that begin in it, so a few
    splits may hold all rows; narrow rows are dealt evenly over partitions whose number grows with that of the splits.
    Only for plain scans: counting their partitions starts no job.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    return scan.repartition(cores if splits < cores else TASKS_PER_SPLIT * splits)
