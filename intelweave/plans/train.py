"""Training tables from bootstrap tags, fitted models, and the folder they are kept in."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave.operators import tagging as C
from intelweave.operators import vectors as V
from intelweave.operators.latent import LatentModel, fit_latent, load_latent
from intelweave.plans.batch import Models
from intelweave.sources import tables as T


def binary_training(tagged: DataFrame, negatives: DataFrame, key: str = "url", seed: int = 42) -> DataFrame:
    """``(key, text, label)``: the tagged articles' model input against as many ``(key, text)`` negatives."""
    positives = tagged.select(key, C.model_input().alias("text"))
    return C.balanced_training_set(positives, negatives, key, seed)


def industry_training(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(text, label_id)`` rows of the tagged articles, and the ``(label_id, label)`` mapping."""
    labels = C.label_map(tagged.select("primary_industry"), "primary_industry")
    rows = tagged.select(C.model_input().alias("text"), "primary_industry")
    return C.encode_labels(rows, "primary_industry", labels).select("text", "label_id"), labels


def fit_models(tagged: DataFrame, negatives: DataFrame, key: str = "url", latent: bool = False, **settings: int) -> Models:
    """Both classifiers and the embedder from a staged table of tagged articles and a table of negatives.

    ``latent`` makes the embedder a latent semantic one in place of hashed word weights.
    """
    rows, labels = industry_training(tagged)
    binary = C.train_binary(binary_training(tagged, negatives, key), **settings)
    return Models(binary, C.train_industry(rows, **settings), labels, fit_latent(tagged) if latent else V.fit_embedder(tagged))


def save_models(models: Models, path: str) -> None:
    """Write all parts of ``models`` under ``path``, replacing what is there; ``tagger`` and ``names`` are code and stay out."""
    for name in ("binary", "industry", "embedder"):
        model = getattr(models, name)
        if isinstance(model, LatentModel):
            model.save(models.labels.sparkSession, f"{path}/{name}")
        else:
            model.write().overwrite().save(f"{path}/{name}")
    T.save_label_map(models.labels, f"{path}/labels")


def load_models(spark: SparkSession, path: str, latent: bool = False) -> Models:
    """What :func:`save_models` wrote; ``latent`` as in :func:`fit_models`."""
    parts = [PipelineModel.load(f"{path}/{name}") for name in ("binary", "industry")]
    parts.append(load_latent(spark, f"{path}/embedder") if latent else PipelineModel.load(f"{path}/embedder"))
    labels = T.load_label_map(spark, f"{path}/labels").select(F.col("label_id"), "label")
    return Models(parts[0], parts[1], labels, parts[2])
