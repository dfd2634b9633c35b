"""Full build: raw articles to processed, tagged and entity tables, vectors and graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave.functions.flow import with_computed
from intelweave.functions.text import clean_text
from intelweave.operators import entities as E
from intelweave.operators import graph as G
from intelweave.operators import quality as Q
from intelweave.operators import tagging as C
from intelweave.operators import vectors as V
from intelweave.operators.latent import LatentModel
from intelweave.sources import stores as S
from intelweave.sources import tables as T


@dataclass(frozen=True)
class Layout:
    """Where the stage tables of one installation live (a shared folder)."""

    root: str

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"


@dataclass(frozen=True)
class Models:
    """Fitted models of the tagging cascade and the embedder, with the industry names.

    ``tagger`` replaces the cascade: a function from cleaned articles to the rows
    it keeps, with ``threat_score``, ``primary_industry`` and ``industry_score``.
    ``names`` adds the arrays ``model_malware`` and ``model_actors`` of a named
    entity model to articles with keyword entities.
    """

    binary: PipelineModel | None
    industry: PipelineModel | None
    labels: DataFrame | None
    embedder: PipelineModel | LatentModel
    tagger: Callable[[DataFrame], DataFrame] | None = None
    names: Callable[[DataFrame], DataFrame] | None = None

    def tag(self, clean: DataFrame) -> DataFrame:
        if self.tagger is not None:
            return self.tagger(clean)
        return C.tag_articles(clean, self.binary, self.industry, self.labels)

    def entities(self, tagged: DataFrame) -> DataFrame:
        """Keyword entities, merged with the model's where there is one, vendors removed."""
        found = E.extract_entities(tagged)
        if self.names is None:
            return E.combine(found)
        return E.combine(self.names(found), "model_malware", "model_actors").drop("model_malware", "model_actors")


def cleaned(articles: DataFrame) -> DataFrame:
    """Replace ``content`` by ``clean_text``."""
    return with_computed(articles, {"clean_text": clean_text("content")}).drop("content")


def processed(articles: DataFrame, order: str) -> DataFrame:
    """Clean, then drop short articles, exact copies and junk titles.

    The title test follows the copy test, as a copy's first row decides.
    """
    return Q.good_title(Q.dedupe_text(Q.min_words(cleaned(articles)), order))


def stage(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write a stage and read it back: later stages start from files, not from lineage."""
    T.write_stage(df, path)
    return T.read_stage(spark, path)


def build(spark: SparkSession, articles: DataFrame, models: Models, layout: Layout, order: str = "url") -> None:
    """Run every stage once and leave all tables under ``layout``.

    Three text-wide writes: processed, entities and vectors. The entity table
    feeds both the vectors and the graph.
    """
    clean = stage(spark, processed(articles, order), layout.at("processed"))
    S.write_base(models.entities(models.tag(clean)), layout.at("entities"))
    found = spark.read.parquet(f"{layout.at('entities')}/increment={S.BASE}")
    complete = Q.require(found, ["clean_text", "title", "url"])
    ties = [F.col(c).desc() for c in ("title", "primary_industry", "threat_score", "clean_text")]
    latest = Q.first_per(complete, ["url"], F.col(order).desc(), *ties)
    S.write_vectors(V.vector_rows(V.embed(latest, models.embedder)), layout.at("vectors"))
    S.write_graph(*G.build_graph(found, order), layout.at("graph"))
    S.write_counts(spark, layout.at("graph"), layout.at("counts"), S.BASE)
    # Increments start behind what the build has read, filtered rows included.
    S.write_ledger(articles.select("url").where("url <> ''").distinct(), layout.at("ledger"), S.BASE)
