"""Text features, cosine similarity, filtered top-k and top-k for many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillweave.functions import fixed
from tillweave.operators import nearest, terms


def fit_text(df: DataFrame, text: str, dimension: int = 1536):
    """TF-IDF features hashed to a fixed dimension and scaled to unit length, fitted on ``df``.

    The fitted model holds one weight per dimension; its ``write()`` and ``PipelineModel.load`` store and read it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimension),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
        ]
    ).fit(df)


def text_vectors(model, df: DataFrame, out: str = "embedding") -> DataFrame:
    """Adds the vectors of a fitted model. Rows need the text column that it was fitted on."""
    from pyspark.ml.functions import vector_to_array

    made = model.transform(df)
    return made.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_tfidf", "_unit")


def embed_text(df: DataFrame, text: str, out: str = "embedding", dimension: int = 1536) -> DataFrame:
    """The vectors of a model fitted on the same rows."""
    return text_vectors(fit_text(df, text, dimension), df, out)


def search_text(
    model, vectors: DataFrame, questions: DataFrame, vector_id: str, question_id: str,
    predicate: Column | None = None, k: int = fixed.TOP_K,
) -> DataFrame:
    """The k stored texts nearest to every question, ``(question_id, vector_id, score, rank)``.

    Questions get vectors from the model that made ``vectors``; the predicate filters before anything is scored.
    A question without any known word has no direction and finds nothing.
    """
    rows = vectors if predicate is None else vectors.filter(predicate)
    make = terms.term_vectors if isinstance(model, terms.TermModel) else text_vectors
    asked = make(model, questions).filter(norm(F.col("embedding")) > 0)
    return top_k_many(rows, asked, vector_id, question_id, k=k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is zero."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector scaled to length one, so that a score is a single dot product."""
    length = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda v: v.cast("double") / length)


def mean_vectors(vectors: DataFrame, embedding: str, *by: str) -> DataFrame:
    """Component-wise mean per group. Sums merge before the shuffle; arrays hold one value per dimension."""
    parts = vectors.select(*by, F.posexplode(embedding).alias("_pos", "_v"))
    means = parts.groupBy(*by, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    rows = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_a"))
    return rows.select(*by, F.transform("_a", lambda p: p["_m"]).alias(embedding))


def top_k(
    vectors: DataFrame, query: Column, vector_id: str, embedding: str = "embedding",
    predicate: Column | None = None, k: int = fixed.TOP_K,
) -> DataFrame:
    """The k best rows for one query vector; the predicate filters before anything is scored."""
    rows = vectors if predicate is None else vectors.filter(predicate)
    # The query is one value for the whole scan, usually a scalar subquery.
    asked = rows.withColumn("_query", query)
    scored = asked.withColumn("score", cosine(F.col(embedding), F.col("_query"))).drop("_query")
    best = scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), F.asc(vector_id)).limit(k)
    return best.withColumn("score", F.round("score", 6))


def top_k_many(
    vectors: DataFrame, queries: DataFrame, vector_id: str, query_id: str, embedding: str = "embedding",
    k: int = fixed.TOP_K, cells: nearest.Cells | None = None,
) -> DataFrame:
    """The k best rows for every query vector: ``(query_id, vector_id, score, rank)``, exact, ties to smaller ids.

    Vectors are searched by inverted cells (see ``nearest``), which ``cells`` may hold ready from an earlier search.
    Rows are ranked on the full score, which is rounded for output only. Queries have distinct ids. Vectors without
    a direction (null, zero, or with null or non-finite components) and those of another dimension take no part.
    """
    cells = cells or nearest.build_cells(vectors, vector_id, embedding)
    if cells is None:
        nothing = f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{vector_id}` {dict(vectors.dtypes)[vector_id]}, score double, rank int"
        return vectors.sparkSession.createDataFrame([], nothing)
    found = nearest.search(cells, queries, query_id, embedding, k).filter("id IS NOT NULL")
    found = found.select(F.col("query").alias(query_id), F.col("id").alias(vector_id), "score")
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(vector_id))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.round("score", 6))


def similar_pairs_lsh(vectors: DataFrame, queries: DataFrame, vector_id: str, query_id: str, embedding: str, distance: float, bucket: float = 0.5, tables: int = 4) -> DataFrame:
    """Approximate neighbours for very large query sets: hashed buckets on unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    left = vectors.select(vector_id, array_to_vector(unit(F.col(embedding))).alias("features"))
    right = queries.select(query_id, array_to_vector(unit(F.col(embedding))).alias("features"))
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7
    ).fit(left)
    near = model.approxSimilarityJoin(left, right, distance, distCol="distance")
    score = F.lit(1.0) - F.col("distance") * F.col("distance") / 2.0
    return near.select(
        F.col(f"datasetB.{query_id}"), F.col(f"datasetA.{vector_id}"), score.alias("score")
    )


# --- predicate language ----------------------------------------------------------------------


def predicate(spec: dict) -> Column:
    """A filter from plain values, as used before a top-k.

    ``{"col": 5}`` equality, ``{"col": [..]}`` membership, ``{"col": (low, high)}`` inclusive range
    (either end may be None), ``{"col": True}`` flag, ``{"any": [spec, ...]}``, ``{"all": [spec, ...]}``.
    """
    parts = []
    for name, value in spec.items():
        if name in ("any", "all"):
            inner = [predicate(s) for s in value]
            joined = inner[0]
            for other in inner[1:]:
                joined = (joined | other) if name == "any" else (joined & other)
            parts.append(joined)
        elif isinstance(value, list):
            parts.append(F.col(name).isin(value))
        elif isinstance(value, tuple):
            low, high = value
            cond = F.lit(True)
            if low is not None:
                cond = cond & (F.col(name) >= F.lit(low))
            if high is not None:
                cond = cond & (F.col(name) <= F.lit(high))
            parts.append(cond)
        else:
            parts.append(F.col(name) == F.lit(value))
    out = parts[0] if parts else F.lit(True)
    for other in parts[1:]:
        out = out & other
    return out


def latest(df: DataFrame, ts: str) -> DataFrame:
    """Exact latest time, one row."""
    return df.agg(F.max(ts).alias("latest_ts"))
