"""Receipt documents: scanning text files, landing them once, loading only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_GLOB = "receipt_*.txt"


def scan_text_files(spark: SparkSession, directory: str, glob: str = FILE_GLOB, modified_after: str | None = None) -> DataFrame:
    """One row per UTF-8 file, or per file changed since a time: ``(filename, raw_text, path, content_sha256)``."""
    return with_identity(spark.read.text(directory, wholetext=True, pathGlobFilter=glob, modifiedAfter=modified_after))


def with_identity(files: DataFrame) -> DataFrame:
    """The columns of whole text files: the name to show, the text, and what tells a file apart: its full path and
    the hash of its content."""
    text = F.col("value")
    return files.select(
        F.col("_metadata.file_name").alias("filename"), text.alias("raw_text"),
        F.col("_metadata.file_path").alias("path"), F.sha2(text, 256).alias("content_sha256"),
    )


def documents_from_table(table: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The same two columns from documents that already sit in a table."""
    name = F.concat(F.lit("receipt_"), F.col(doc_id).cast("string"), F.lit(".txt"))
    return table.select(name.alias("filename"), F.col(text).alias("raw_text"))


def land(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Writes documents to Parquet, so that later jobs never list small files again."""
    raw.write.mode(mode).parquet(path)


def only_new(incoming: DataFrame, loaded: DataFrame, keys: tuple[str, ...] = ("path", "content_sha256")) -> DataFrame:
    """Incoming rows whose key isn't loaded yet.

    By default a file is known by path and content: one of the same name in another folder is new, and so is one
    that was rewritten.
    """
    return incoming.join(loaded.select(*keys), list(keys), "left_anti")


def readable(receipts: DataFrame) -> DataFrame:
    return receipts.filter(F.size("parse_errors") == 0)


def quarantine(receipts: DataFrame) -> DataFrame:
    """Documents that could not be read fully, with their reasons; the rest of the load goes on."""
    return receipts.filter(F.size("parse_errors") > 0)


def split_outputs(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return readable(receipts), quarantine(receipts)
