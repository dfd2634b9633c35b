"""Embeddings and nearest-neighbour search over a vector table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.text import url_id
from intelweave.functions.vectors import similarity, squared_distance
from intelweave.operators.latent import LatentModel, embed_latent
from intelweave.operators.quality import first_per, not_stored

METADATA = ["title", "url", "threat_score", "primary_industry", "industry_score"]


def fit_embedder(df: DataFrame, column: str = "clean_text", dim: int = vocab.EMBEDDING_DIM) -> PipelineModel:
    """Hashed TF-IDF model giving unit-length vectors; save it and use it for queries too."""
    stages = [
        RegexTokenizer(inputCol=column, outputCol="_tokens", pattern=r"\s+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vector", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(column))


def embedder_column(model: PipelineModel | LatentModel) -> str:
    """The text column that a fitted embedder reads."""
    return model.column if isinstance(model, LatentModel) else model.stages[0].getInputCol()


def embed(df: DataFrame, model: PipelineModel | LatentModel) -> DataFrame:
    """Add ``embedding`` (array of float) with a fitted :func:`fit_embedder` or ``fit_latent`` model."""
    if isinstance(model, LatentModel):
        return embed_latent(df, model)
    out = model.transform(df).withColumn("embedding", vector_to_array("_vector", "float32"))
    return out.select(*df.columns, "embedding")


def embed_with(df: DataFrame, column: str, encoder: Callable[[], Callable[[list[str]], Sequence]]) -> DataFrame:
    """Add ``embedding`` with a user model, one Arrow batch at a time.

    ``encoder`` runs once per task (loads the model) and returns the function
    from a list of texts to a list of float vectors. The batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", embedding array<float>"

    def run(batches):
        encode = encoder()
        for pdf in batches:
            yield pdf.assign(embedding=[list(v) for v in encode(pdf[column].tolist())])

    return df.mapInPandas(run, schema)


def vector_rows(df: DataFrame) -> DataFrame:
    """Embedded articles to collection rows; metadata as text, null as ""."""
    meta = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in METADATA]
    return df.select(url_id("url").alias("id"), F.col("clean_text").alias("document"), "embedding", *meta)


def vector_metadata(df: DataFrame) -> DataFrame:
    """``id`` and the five metadata columns as text, null as ""."""
    meta = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in METADATA]
    return df.select(url_id("url").alias("id"), *meta)


def add_vectors(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose id is not stored yet, each id once."""
    return first_per(not_stored(new, existing, "id"), ["id"], F.col("url").asc(), F.col("title").asc()).select(*new.columns)


def by_industry(df: DataFrame, industry: str | None, column: str = "primary_industry") -> DataFrame:
    """Equality filter; ``None``, "" and "All Industries" mean no filter."""
    if not industry or industry == vocab.ALL_INDUSTRIES:
        return df
    return df.where(F.col(column) == industry)


def knn(
    vectors: DataFrame,
    query: Sequence[float] | Column,
    k: int = 5,
    industry: str | None = None,
    tie: str = "id",
) -> DataFrame:
    """The ``k`` nearest rows by squared Euclidean distance, with ``distance`` and ``similarity``.

    ``query`` is a literal vector or a scalar subquery; the industry filter
    reaches the scan and each task keeps only its own best ``k``.
    """
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    # The subquery becomes a column first: it may not stand inside a lambda.
    asked = by_industry(vectors, industry).withColumn("_query", q)
    scored = asked.withColumn("distance", squared_distance(F.col("embedding"), F.col("_query")))
    top = scored.drop("_query").orderBy("distance", tie).limit(k)
    return top.withColumn("similarity", similarity(F.col("distance")))


def search_results(hits: DataFrame) -> DataFrame:
    """Result rows as a reader sees them: title, url, 300-character snippet, scores."""
    return hits.select(
        "title",
        "url",
        F.substring("document", 1, 300).alias("snippet"),
        F.col("similarity").alias("similarity_score"),
        "threat_score",
        "primary_industry",
    )


def describe_vectors(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors and smallest and largest dimension."""
    size = F.size("embedding")
    return vectors.agg(
        F.count("*").alias("n_vectors"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim")
    )


def peek(vectors: DataFrame, n: int = 3, tie: str = "id") -> DataFrame:
    """A small sample of the collection in id order."""
    return vectors.orderBy(tie).limit(n)
