"""The corpus pipeline: five stages, each of which reads what its predecessor wrote and works on all of it.

All stages but the last return the columns of ``documents``, so that any of them can be left out or run alone. They
take whatever columns the table has, and keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.llm import decontaminate, langid, mixing, neardup, tokens
from tillweave.llm.common import release, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, ``lang`` set to it; those that are ``und`` go.

    The network learns from the rows of ``docs`` that aren't held out; without any label it knows no language, and then
    there is nothing to tell documents apart by: all stay as they are.
    """
    net = langid.fit(docs)
    if not net.languages:
        return docs
    # Columns of the names that are added step aside.
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}
    named = langid.identify(docs.withColumnsRenamed(aside), net)
    kept = named.where(named.lang_pred != langid.UNKNOWN).withColumn("lang", named.lang_pred.cast(docs.schema["lang"].dataType))
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by similarities of 0.8 or more."""
    release(spark)
    return neardup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    release(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the target weights, repeats as repeated rows."""
    release(spark)
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    release(spark)
    return tokens.token_files(docs, tokens.public_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: A trained network and tokenizer files have no SQL form; stages are tested against brute force and round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
