"""Helpers shared by the operators: tables, the shared folder, text slices and fixed character classes."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillweave.session import work_path as shared_path  # noqa: F401

# The white space and the letters that the contracts name.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SHARED_SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made and nothing will read any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark clean up after finished jobs: it deletes the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def slices_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of an Arrow column with about ``most`` bytes together; a longer text is a range of
    its own. What a worker holds beside its batch is bounded by that."""
    ends, begin = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)), 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, stop
        begin = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes under a string column and its offsets into them; a null is as long as an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Has the session hand texts to Python in batches of at most ``rows`` rows, which bounds what a worker holds."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
