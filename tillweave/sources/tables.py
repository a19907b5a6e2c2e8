"""Keyed upsert, set-based delete, rebuild and statistics for Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _row_hash(rows: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, by their JSON."""
    return F.xxhash64(*[F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema])


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row per key. A mergeable maximum, so a key with very many versions is never gathered.

    Of rows with equal versions the one with the largest hash of all its columns wins, whatever their order, so
    a retry gives the same row. A null version is refused with an error.
    """
    rest = [c for c in rows.columns if c not in keys and c != version]
    refused = F.raise_error(F.lit(f"{version} must not be null"))
    stated = rows.withColumn(version, F.when(F.col(version).isNull(), refused).otherwise(F.col(version)))
    order = F.struct(F.col(version), _row_hash(rows))
    top = stated.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max(version).alias(version))
    return top.select(*[c if c in keys or c == version else F.col(f"_r.{c}") for c in rows.columns])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of every key, stored or incoming; a late older version changes nothing.

    Only keys of the incoming batch are aggregated; the other rows of ``existing`` pass an anti join, which Spark
    broadcasts for small batches.
    """
    columns = existing.columns
    touched = new.select(*keys).distinct()
    untouched = existing.join(touched, keys, "left_anti").select(*columns)
    stored = existing.join(touched, keys, "left_semi").select(*columns)
    return untouched.unionByName(newest(stored.unionByName(new.select(*columns)), keys, version).select(*columns))


def delete_keys(table: DataFrame, gone: DataFrame, table_key: str, gone_key: str) -> DataFrame:
    """Rows whose key is not in the delete table."""
    return table.join(gone, table[table_key] == gone[gone_key], "left_anti")


def rebuild(rows: DataFrame, path: str, schema: StructType | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Overwrites the table at a path and reads it back with its declared schema."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return rows.sparkSession.read.schema(schema or rows.schema).parquet(path)


def clear(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Leaves an empty table of the declared schema."""
    return rebuild(spark.createDataFrame([], schema), path, schema)


def index_statistics(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Row count, dimension and distinct keys, one row."""
    return vectors.agg(
        F.count(F.lit(1)).alias("total_vector_count"),
        F.max(F.size(embedding)).alias("dimension"),
        F.min(F.size(embedding)).alias("least_dimension"),
        F.count_distinct(key).alias("distinct_ids"),
    )


def store(existing: DataFrame, new: DataFrame, keys: list[str], version: str, path: str) -> int:
    """Upserts into a fresh path and returns the number of incoming keys stored.

    The old table stays untouched until the caller switches to the new path, so a lost executor or
    a failed write never leaves a half-written table behind.
    """
    upsert(existing, new, keys, version).write.mode("overwrite").parquet(path)
    batch = new.select(*keys).distinct()
    return existing.sparkSession.read.parquet(path).join(batch, keys, "left_semi").count()


# --- keyed tables ----------------------------------------------------------------------------
#
# A keyed table is a folder of partitions ``bucket_of_<n>=<hash of the keys modulo n>``, so a batch concerns the
# partitions of its keys alone. The number of buckets is part of the column's name and can't be mistaken later.


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(f"bucket_of_{buckets}")


def _deal(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Rows of a bucket in one task, so that a bucket is one file."""
    column = f"bucket_of_{buckets}"
    return rows.select("*", _bucket(keys, buckets)).repartition(column)


def create_keyed(rows: DataFrame, path: str, keys: list[str], version: str, buckets: int = 64) -> None:
    """Writes a keyed table with the newest row of every key."""
    _deal(newest(rows, keys, version), keys, buckets).write.mode("overwrite").partitionBy(f"bucket_of_{buckets}").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.drop(*[c for c in table.columns if c.startswith("bucket_of_")])


def merge_keyed(new: DataFrame, path: str, keys: list[str], version: str) -> list[int]:
    """Merges a batch into a keyed table: the highest version of every key stays. Returns the buckets rewritten.

    Only the partitions of the batch's keys are read and written; all others keep their files. A partition is replaced when
    the job commits, so a failed merge leaves the old files, and repeating it gives the same rows.
    """
    stored = new.sparkSession.read.parquet(path)
    column = next(c for c in stored.columns if c.startswith("bucket_of_"))
    buckets = int(column.removeprefix("bucket_of_"))
    # The numbers of buckets are bounded by their count.
    touched = sorted(r[0] for r in new.select(_bucket(keys, buckets)).distinct().collect())
    if touched:
        old = stored.filter(F.col(column).isin(touched)).drop(column)
        merged = newest(old.unionByName(new.select(*old.columns)), keys, version)
        writer = _deal(merged, keys, buckets).write.mode("overwrite").partitionBy(column)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched
