"""The query surface: search, graph listing, statistics, entities and alerts.

Every function takes tables and returns one lazy frame with an explicit order,
so limits are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.operators import vectors as V
from intelweave.operators.latent import LatentModel

_EDGE_ORDER = ["src_label", "src", "rel", "dst_label", "dst"]


def search(
    vectors: DataFrame,
    query: str,
    embedder: PipelineModel | LatentModel,
    industry: str = vocab.ALL_INDUSTRIES,
    top_k: int = 5,
) -> DataFrame:
    """Semantic search for a text; a blank query is an error."""
    if not query.strip():
        raise ValueError("Query cannot be empty.")
    column = V.embedder_column(embedder)
    asked = vectors.sparkSession.createDataFrame([(query,)], f"`{column}` string")
    vector = V.embed(asked, embedder).first()["embedding"]
    return search_by_vector(vectors, vector, industry, top_k)


def search_by_vector(
    vectors: DataFrame,
    query: Sequence[float] | Column,
    industry: str = vocab.ALL_INDUSTRIES,
    top_k: int = 5,
) -> DataFrame:
    return V.search_results(V.knn(vectors, query, top_k, industry))


def display_name(name: Column, id_: Column, address: Column, title: Column) -> Column:
    """First non-empty of name, id, address and the title's first 40 characters, else ``Unknown``."""
    options = [name, id_, address, F.substring(title, 1, 40)]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit("Unknown"))


def _shown(label: Column, key: Column, title: Column) -> Column:
    # Articles carry a title only; the other nodes' key is their name, id or address.
    article = label == "Article"
    none = F.lit(None).cast("string")
    return display_name(F.when(~article, key), none, none, F.when(article, title))


def graph_listing(
    nodes: DataFrame, edges: DataFrame, industry: str = vocab.ALL_GRAPH, limit: int = 100
) -> DataFrame:
    """Edges with display names, optionally those that touch an industry.

    An edge qualifies when either end is that Industry node or its source is an
    article with that industry property. The titles are read for the listed
    edges alone.
    """
    articles = nodes.where("label = 'Article'").select(F.col("key").alias("src"), "title", "industry")
    if industry != vocab.ALL_GRAPH:
        # Only articles' edges meet a join; edges at the Industry node are a plain filter.
        at_src = (F.col("src_label") == "Industry") & (F.col("src") == industry)
        at_dst = (F.col("dst_label") == "Industry") & (F.col("dst") == industry)
        at_node = F.coalesce(at_src | at_dst, F.lit(False))
        of_industry = articles.where(F.col("industry") == industry).select("src")
        own = edges.where((F.col("src_label") == "Article") & ~at_node).join(of_industry, "src", "left_semi")
        edges = edges.where(at_node).unionByName(own.select(*edges.columns))
    listed = edges.orderBy(*_EDGE_ORDER).limit(limit)
    # At most `limit` keys pick the titles; articles that are not listed stay where they are.
    wanted = listed.where("src_label = 'Article'").select("src").distinct()
    titles = articles.select("src", "title").join(F.broadcast(wanted), "src", "left_semi")
    named = listed.join(F.broadcast(titles), "src", "left")
    return named.select(
        _shown(F.col("src_label"), F.col("src"), F.col("title")).alias("source"),
        F.col("src_label").alias("source_type"),
        _shown(F.col("dst_label"), F.col("dst"), F.lit(None).cast("string")).alias("target"),
        F.col("dst_label").alias("target_type"),
        F.col("rel").alias("relationship"),
    )


def stats(vectors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals: articles, industries, dimension, nodes, relationships."""
    by_node = nodes.agg(
        F.count("*").alias("graph_nodes"),
        F.count(F.when(F.col("label") == "Industry", 1)).alias("industries_covered"),
    )
    return vectors.agg(
        F.count("*").alias("total_articles"), F.max(F.size("embedding")).alias("embedding_dimensions")
    ).select(
        "total_articles",
        by_node.select("industries_covered").scalar().alias("industries_covered"),
        "embedding_dimensions",
        by_node.select("graph_nodes").scalar().alias("graph_nodes"),
        edges.agg(F.count("*").alias("n")).scalar().alias("graph_relationships"),
    )


def top_entities(
    nodes: DataFrame, edges: DataFrame, industry: str = vocab.ALL_INDUSTRIES, limit: int = 10
) -> DataFrame:
    """Most mentioned malware, CVEs and actors: ``(kind, name, connections)``.

    ``edges`` must be unique. One aggregate serves all kinds; the rank limit
    trims each task's candidates before the per-kind sort.
    """
    hits = edges.where(
        (F.col("rel") == "MENTIONS")
        & (F.col("src_label") == "Article")
        & F.col("dst_label").isin("Malware", "CVE", "ThreatActor")
    )
    if industry != vocab.ALL_INDUSTRIES:
        own = nodes.where((F.col("label") == "Article") & (F.col("industry") == industry))
        hits = hits.join(own.select(F.col("key").alias("src")), "src", "left_semi")
    counts = hits.groupBy(F.col("dst_label").alias("kind"), F.col("dst").alias("name")).agg(
        F.count("*").alias("connections")
    )
    return top_per_kind(counts, limit)


def top_per_kind(counts: DataFrame, limit: int) -> DataFrame:
    by = Window.partitionBy("kind").orderBy(F.desc("connections"), "name")
    ranked = counts.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= limit)
    return ranked.drop("_rank").orderBy("kind", F.desc("connections"), "name")


def industry_stats(edges: DataFrame) -> DataFrame:
    """Articles per industry by TARGETS edges, most first."""
    hits = edges.where((F.col("src_label") == "Article") & (F.col("rel") == "TARGETS"))
    counts = hits.groupBy(F.col("dst").alias("industry")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "industry")


# -- the same answers from kept counts (`stores.read_counts`), without the graph --


def kept_stats(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """:func:`stats`, of whose totals only the collection's still need a scan."""
    def total(measure: str, kind: str | None = None) -> Column:
        rows = counts.where(F.col("measure") == measure)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()

    return vectors.agg(
        F.count("*").alias("total_articles"), F.max(F.size("embedding")).alias("embedding_dimensions")
    ).select(
        "total_articles",
        total("node", "Industry").alias("industries_covered"),
        "embedding_dimensions",
        total("node").alias("graph_nodes"),
        total("edge").alias("graph_relationships"),
    )


def kept_top_entities(counts: DataFrame, industry: str = vocab.ALL_INDUSTRIES, limit: int = 10) -> DataFrame:
    """:func:`top_entities`."""
    hits = counts.where((F.col("measure") == "mention") & F.col("kind").isin("Malware", "CVE", "ThreatActor"))
    if industry != vocab.ALL_INDUSTRIES:
        hits = hits.where(F.col("industry") == industry)
    return top_per_kind(hits.groupBy("kind", "name").agg(F.sum("n").alias("connections")), limit)


def kept_industry_stats(counts: DataFrame) -> DataFrame:
    """:func:`industry_stats`."""
    hits = counts.where("measure = 'target'").select(F.col("name").alias("industry"), F.col("n").alias("count"))
    return hits.orderBy(F.desc("count"), "industry")


def alerts(
    vectors: DataFrame,
    limit: int = 10,
    industry: str = vocab.ALL_INDUSTRIES,
    tie: str = "url",
) -> DataFrame:
    """Highest threat scores; an unreadable score counts as 0.0.

    ``count`` repeats how many alerts are returned.
    """
    rows = V.by_industry(vectors, industry)
    score = F.coalesce(F.col("threat_score").try_cast("double"), F.lit(0.0))
    scored = rows.select("title", "url", "primary_industry", score.alias("threat_score"))
    top = scored.orderBy(F.desc("threat_score"), tie).limit(limit)
    # The frame is at most `limit` rows here, so an unpartitioned count is free.
    return top.withColumn("count", F.count("*").over(Window.partitionBy()))
