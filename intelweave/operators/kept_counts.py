"""Counts of the graph that are kept from increment to increment instead of counted again.

counts: measure, kind, name, industry, n

| measure | kind | name | industry |
|---|---|---|---|
| node | label | | |
| edge | relation | | |
| article | Article | | the article's industry |
| mention | label of the entity | its key | industry of the articles that mention it |
| target | Industry | its key | |

What an increment changes is the difference of two counts over the part of the graph it touches, after and
before it: new nodes, edges of new articles (their industry may have changed, which moves all their mentions)
and repeated edges, which count once. Differences are added up on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.operators import graph as G

COUNT_COLUMNS = ["measure", "kind", "name", "industry"]
COUNT_SCHEMA = "measure string, kind string, name string, industry string, n long"


def _counted(df: DataFrame, measure: str, kind: Column, name: Column | None = None, industry: Column | None = None) -> DataFrame:
    none = F.lit("")
    columns = [F.lit(measure), kind, none if name is None else name, none if industry is None else industry]
    keyed = df.select(*[c.alias(n) for c, n in zip(columns, COUNT_COLUMNS)])
    return keyed.groupBy(*COUNT_COLUMNS).agg(F.count("*").alias("n"))


def count_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All counts of a graph of unique nodes and edges; an article without a node has the empty industry."""
    articles = nodes.where("label = 'Article'")
    of_articles = edges.where("src_label = 'Article'")
    industry = F.coalesce("industry", F.lit(""))
    owner = articles.select(F.col("key").alias("src"), industry.alias("industry"))
    mentions = of_articles.where("rel = 'MENTIONS'").join(owner, "src", "left")
    parts = [
        _counted(nodes, "node", F.col("label")),
        _counted(edges, "edge", F.col("rel")),
        _counted(articles, "article", F.col("label"), industry=industry),
        _counted(mentions, "mention", F.col("dst_label"), F.col("dst"), industry),
        _counted(of_articles.where("rel = 'TARGETS'"), "target", F.col("dst_label"), F.col("dst")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def touched(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an earlier graph that the new ones can change the count of.

    Semi-joins with the increment's keys: the earlier graph is filtered by them and not ordered or merged.
    """
    articles = new_nodes.where("label = 'Article'").select(F.col("key").alias("src"))
    articles = articles.unionByName(new_edges.where("src_label = 'Article'").select("src")).distinct()
    keys = new_nodes.select("label", "key").unionByName(articles.select(F.lit("Article").alias("label"), F.col("src").alias("key")))
    repeated = new_edges.where("src_label <> 'Article'").select(*G.EDGE_COLUMNS).distinct()
    of_articles = edges.where("src_label = 'Article'").join(articles, "src", "left_semi")
    others = edges.where("src_label <> 'Article'").join(repeated, G.EDGE_COLUMNS, "left_semi")
    return nodes.join(keys.distinct(), ["label", "key"], "left_semi"), of_articles.unionByName(others)


def count_changes(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, order: str = "increment") -> DataFrame:
    """What an increment adds to the counts, negative where it takes something back; no rows of zero.

    ``nodes`` and ``edges`` are the rows of earlier increments, merged or not. Column ``order`` of all four ranks
    the increments, the new ones last.
    """
    near_nodes, near_edges = touched(nodes, edges, new_nodes, new_edges)
    before = count_graph(G.latest_nodes(near_nodes, order), G.unique_edges(near_edges))
    after = count_graph(
        G.latest_nodes(near_nodes.unionByName(new_nodes), order), G.unique_edges(near_edges.unionByName(new_edges))
    )
    return add_up(after.unionByName(before.withColumn("n", -F.col("n"))))


def add_up(changes: DataFrame) -> DataFrame:
    """Changes of any number of increments to counts; what has been taken back entirely is left out."""
    return changes.groupBy(*COUNT_COLUMNS).agg(F.sum("n").alias("n")).where("n <> 0")
