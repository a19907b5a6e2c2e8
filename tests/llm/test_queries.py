"""Registered queries beside their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from compare import compare, connect
from tillweave.llm import mixing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir) == ""


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    junk = docs.limit(1).selectExpr("-5L AS doc_id", "'12 34 !!' AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(junk)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert out.columns == columns
        before, after = (sorted(r.doc_id for r in x.select("doc_id").collect()) for x in (docs, out))
        assert set(after) <= set(before) and after
        if name == "language_id":
            assert set(before) - set(after) == {-5}
        if name == "near_duplicates":
            assert len(after) == len(set(after)) < len(before)
        if name == "mix_sources":
            words = lambda d: d.agg({"n": "sum"}).first()[0]
            size = [words(x.select(mixing.word_count(x.text).alias("n"))) for x in (docs, out)]
            assert size[1] == pytest.approx(1.5 * size[0], rel=0.01)
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(rows) == docs.count() and {r.doc_id for r in rows} <= ids
