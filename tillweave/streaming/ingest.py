"""Continuous loading: every new receipt file is read once, extracted, cut into chunks and stored.

A loaded collection is a folder with two tables, ``receipts`` and ``chunks``, whose partitions are batches. A batch is
written as a whole under its key, so one that is repeated after a failure replaces itself. A document is known by
its content: copies, in one batch or in several, are taken once; a file that was rewritten has new content and is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillweave.operators.chunks import chunk_receipts
from tillweave.operators.receipts import extract_receipts
from tillweave.sources.documents import FILE_GLOB, only_new, scan_text_files, with_identity

IDENTITY = ("path", "content_sha256")

#: Batches of up to so many documents send their hashes (8 bytes each) to the stored ones; of larger ones both are shuffled.
HASHES_SENT = 2_000_000
#: Tables of texts and hashes are the bulk of a load; they take about a third less room than in Spark's default form.
COMPRESSION = "zstd"


def stream_text_files(spark: SparkSession, directory: str, glob: str = FILE_GLOB) -> DataFrame:
    """New files of a directory: ``(filename, raw_text, path, content_sha256)``."""
    return with_identity(spark.readStream.text(directory, wholetext=True, pathGlobFilter=glob))


def _table(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    """The stored table; an empty batch gives a new one its columns."""
    empty = spark.createDataFrame([], like.schema)
    empty.write.mode("ignore").parquet(f"{root}/{name}/batch=none")
    return spark.read.schema(f"{_ddl(like)}, batch string").parquet(f"{root}/{name}")


def _stored_among(files: DataFrame, known: DataFrame) -> DataFrame:
    """The stored hashes that a batch may hold again; a superset by hash collisions only, so few rows.

    The stored hashes grow with every batch. They are filtered where they are read, so none of them is shuffled or sorted
    for the sake of a batch.
    """
    short = lambda rows: F.xxhash64(rows["content_sha256"])
    if files.count() > HASHES_SENT:
        return known
    sent = F.broadcast(files.select(short(files).alias("_short")).distinct())
    return F.broadcast(known.join(sent, short(known) == sent["_short"], "left_semi"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def store_batch(files: DataFrame, batch: str, root: str, **category_rules) -> None:
    """Extracts and chunks the documents whose content isn't stored under another batch, and stores them as this one.

    ``files`` has filename, raw_text, path and content_sha256. Of copies in the batch the one with the smallest path
    stays. Receipts are written first; if chunks fail, the batch is repeated as a whole.
    """
    spark = files.sparkSession
    # Short documents cost much work per byte, so a batch keeps at least one partition per core.
    parts = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions())
    least = files.repartition(parts, "content_sha256").groupBy("content_sha256").agg(F.min_by(F.struct("filename", "raw_text", "path"), F.struct("path", "filename")).alias("f"))
    own = least.select("f.filename", "f.raw_text", "f.path", "content_sha256")
    extracted = extract_receipts(own, keep=IDENTITY, **category_rules)
    known = _table(spark, root, "receipts", extracted).filter(F.col("batch") != batch).select("content_sha256")
    at = f"{root}/receipts/batch={batch}"
    # Known documents are left out below the extraction: Spark moves the anti join there.
    new = only_new(extracted, _stored_among(files, known), ("content_sha256",)).select(*extracted.columns)
    new.write.mode("overwrite").parquet(at, compression=COMPRESSION)
    chunks = chunk_receipts(spark.read.schema(extracted.schema).parquet(at))
    _table(spark, root, "chunks", chunks)
    chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch={batch}", compression=COMPRESSION)


def stream_chunks(files: DataFrame, root: str, checkpoint: str, **category_rules) -> StreamingQuery:
    """Takes every file that arrived since the last run, batch by batch, to receipts and their five views."""
    return (
        files.writeStream.foreachBatch(lambda batch, number: store_batch(batch, f"s{number}", root, **category_rules))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sweep_rewritten(spark: SparkSession, directory: str, root: str, since: str, sweep: str, glob: str = FILE_GLOB, **category_rules) -> None:
    """Takes files that were rewritten after ``since`` ("yyyy-MM-ddTHH:mm:ss"): a stream never reads a path again.

    ``sweep`` names the batch. Times may overlap those of earlier sweeps, as content that is stored is not taken again.
    """
    files = scan_text_files(spark, directory, glob, modified_after=since)
    store_batch(files, f"w{sweep}", root, **category_rules)


def load_new(
    documents: DataFrame, out: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = extract_receipts,
) -> StreamingQuery:
    """Extracts whatever arrived since the last run and appends it; stateless and map-only.

    The checkpoint remembers the files taken, and the file sink commits each batch once, so a
    restart after a failure neither loses nor repeats a document.
    """
    return (
        transform(documents)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
