"""The corpus pipeline: ``documents`` through five operators of ``intelweave.llm``.

``STAGES`` are (name, function) in order. A function takes (spark, docs, sf_dir) and returns a frame
with the columns of ``documents``; the last one returns packed pieces. ``run`` writes each stage's
frame to the shared folder as Parquet and hands the next stage what it reads from there.

Rows are told apart by their id and a hash of their text, so null and repeated ids are no exception;
of rows that are equal in both one stays. Null texts count as empty. Columns beyond those of
``documents`` pass through all stages but the last. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave.llm import decontam, packing, quality_gam, secret_scan, simhash_dedup
from intelweave.llm.common import row_key, staged
from intelweave.llm.queries import tokenizer

QUALITY_THRESHOLD = 0.3


def _nested(docs: DataFrame, **added: Column) -> DataFrame:
    """The whole row as one struct, so that no column's name can clash with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in added.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, unchanged and as often as they stand.

    A null or empty text is scored as one without words. Without a labelled row the classifier scores all alike.
    """
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = _nested(docs, score=quality_gam.score_column(F.col("text"), model))
    return scored.filter(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; a null id comes first.

    Null and empty texts and texts without words have one fingerprint and are one group. Of rows that are
    equal in id and text one stays.
    """
    keyed = _nested(docs, key=row_key(docs), text=F.col("text"))
    found = simhash_dedup.near_duplicates(keyed.select("key", "text"), id_col="key")
    chosen = staged(found.filter(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("n")), "chosen")
    kept = keyed.select("row", "key").join(chosen, "key")
    if not chosen.filter(F.col("n") > 1).isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and neither do empty items match."""
    keyed = _nested(docs, key=row_key(docs), text=F.col("text"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_windows(keyed.select("key", "text"), benchmark, 0.8)
    return keyed.select("row", "key").join(found.select("key").distinct(), "key", "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` follows the text where there is one.

    Null texts stay null with the ``n_chars`` they had; repeated rows stay repeated.
    """
    masked = docs.withColumn("text", secret_scan.mask_column(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences; a null or empty text is a piece of its end id, repeated rows are packed each."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: The classifier's scores and the tokenizer's ids cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
