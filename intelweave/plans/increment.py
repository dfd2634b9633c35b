"""One incremental run: only articles the ledger does not list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intelweave import vocab
from intelweave.functions.text import url_id, word_count
from intelweave.operators import graph as G
from intelweave.operators import quality as Q
from intelweave.operators import vectors as V
from intelweave.operators.web import drop_seen
from intelweave.plans.batch import Layout, Models, cleaned
from intelweave.session import spread
from intelweave.sources import stores as S

LEDGER_SCHEMA = S.LEDGER_SCHEMA


def new_articles(raw: DataFrame, ledger: DataFrame, order: str = "title") -> DataFrame:
    """Articles with a URL the ledger does not hold, each URL once."""
    ties = [F.col(c).asc() for c in ("content",) if c in raw.columns]
    return drop_seen(raw, ledger, F.col(order).asc(), *ties)


def advance_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger plus every new URL, including articles later filtered out."""
    return ledger.select("url").unionByName(new.select("url")).where("url <> ''").distinct()


def clean_increment(articles: DataFrame, strict: bool = False, order: str = "url") -> DataFrame:
    """Clean and filter an increment: at least 100 words and a title that is not blank.

    ``strict`` applies the batch rules instead (over 100 words, no exact copies
    within the increment, longer titles).
    """
    rows = cleaned(articles)
    if strict:
        return Q.good_title(Q.dedupe_text(Q.min_words(rows), order))
    return Q.good_title(Q.min_words(rows, inclusive=True), strict=False)


def run_increment(
    spark: SparkSession,
    raw: DataFrame,
    models: Models,
    layout: Layout,
    increment: int,
    strict: bool = False,
) -> DataFrame:
    """Process what is new in ``raw`` into vectors, graph and ledger; returns the summary row.

    Each table gets one ``increment=`` partition, and lookups see earlier
    increments only, so a retry overwrites its own files and changes nothing
    else. The ledger goes last: after any failure the run is repeated whole.
    Empty inputs flow through as empty partitions.
    """
    ledger = S.read_ledger(spark, layout.at("ledger"), before=increment, near=raw)
    fresh_path = f"{layout.at('fresh')}/increment={increment}"
    # Staged once: three later steps need the new articles.
    new_articles(raw, ledger).write.mode("overwrite").parquet(fresh_path)
    fresh = spark.read.parquet(fresh_path)

    clean = clean_increment(spread(fresh, "url"), strict)
    S.write_increment(models.entities(models.tag(clean)), layout.at("entities"), increment)
    found = spark.read.parquet(f"{layout.at('entities')}/increment={increment}")

    # Ids already stored drop out before the embedding, not after it.
    stored = S.read_increments(spark, layout.at("vectors"), S.VECTOR_SCHEMA, before=increment)
    unseen = V.add_vectors(found.withColumn("id", url_id("url")), stored)
    rows = V.vector_rows(V.embed(unseen, models.embedder))
    S.write_increment(rows, layout.at("vectors"), increment)
    nodes, edges = G.build_graph(found, "url")
    S.write_graph(nodes, edges, layout.at("graph"), clear_first=False, increment=increment)
    S.write_counts(spark, layout.at("graph"), layout.at("counts"), increment)
    S.write_ledger(fresh, layout.at("ledger"), increment)
    # The raw copy has served; an empty table takes its place.
    spark.createDataFrame([], fresh.schema).write.mode("overwrite").parquet(fresh_path)
    return summary(spark, layout, increment)


def summary(spark: SparkSession, layout: Layout, increment: int) -> DataFrame:
    """One row: new, threat-relevant and newly embedded articles, and the collection size."""
    def rows(name: str, schema: T.StructType) -> DataFrame:
        return S.read_increments(spark, layout.at(name), schema)

    url = LEDGER_SCHEMA
    mine = F.count(F.when(F.col("increment") == increment, 1))
    count = lambda name, f: rows(name, url).agg(f.alias("v")).scalar()
    return spark.range(1).select(
        F.lit(increment).alias("increment"),
        count("ledger", mine).alias("new_articles"),
        count("entities", mine).alias("threat_relevant"),
        count("vectors", mine).alias("embedded"),
        count("vectors", F.count("*")).alias("vectors_total"),
    )


def step_counts(fresh: DataFrame) -> DataFrame:
    """Funnel of the increment's own filters over new articles, in one pass."""
    rows = cleaned(fresh)
    return Q.count_steps(
        rows,
        {
            "min_words": word_count("clean_text") >= vocab.ARTICLE_MIN_WORDS,
            "has_title": Q.has_good_title(F.col("title"), strict=False),
        },
    )
