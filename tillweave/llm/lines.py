"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop the lines of frequent
hashes except in the first document, and reassemble the rest by position. DataFrame code only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillweave.llm.common import SPACES, ascii_lower, stored

MIN_DOCUMENTS = 2
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents with ``text`` reassembled from the lines that stay, and ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points that stand in at least ``min_documents`` distinct documents lose all
    their lines except in the smallest doc_id. A null or empty text is one empty line; it comes back as an empty text.
    Rows without an id count as one document, after all others. Rows with equal ids are one document. Other columns are kept, except
    those called n_lines or n_dropped. An empty table gives no rows.

    Lines travel as two 64-bit hashes, the document's id and the position; texts are shuffled once, to meet the
    positions that go. The frequent hashes are stored first, so that the join deals both sides anew and
    adaptive execution can split a hot line.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept if c.lower() != "text")).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("ord"),
    ).withColumn("version", F.xxhash64("text"))
    key = line_key(F.col("line"))
    lines = (
        base.select("ord", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("ord", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    # Two distinct documents show in smallest and largest id; only higher thresholds need the count itself.
    frequent = F.min("ord") != F.max("ord") if min_documents == 2 else F.count_distinct("ord") >= min_documents
    many = stored(
        lines.groupBy("h1", "h2").agg(F.min("ord").alias("first"), frequent.alias("frequent")).where("frequent").select("h1", "h2", "first"),
        "frequent-lines",
    )
    gone = (
        lines.join(many, ["h1", "h2"])
        .where("ord != first")
        .groupBy("ord", "version")
        .agg(F.collect_set("pos").alias("gone"))
    )
    stay = F.expr("array_except(sequence(0, n_lines - 1), gone)")
    return (
        base.join(gone, ["ord", "version"], "left")
        .withColumn("_lines", F.split("text", "\n", -1))
        .withColumn("n_lines", F.size("_lines"))
        .withColumn("_stay", stay)
        .withColumn(
            "text",
            F.when(F.col("gone").isNull(), F.col("text"))
            .when(F.size("_stay") == 0, F.lit(""))
            .otherwise(F.array_join(F.transform("_stay", lambda i: F.col("_lines")[i]), "\n")),
        )
        .select(
            "row.*", "text", F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
