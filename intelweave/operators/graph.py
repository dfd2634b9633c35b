"""Knowledge graph as two tables: nodes and edges.

nodes: label, key, title, industry, threat_score (the last three for articles)
edges: src_label, src, rel, dst_label, dst

Input frames are entity rows: title, url, primary_industry, threat_score and the
four entity arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.operators.entities import KINDS
from intelweave.operators.quality import first_per

NODE_COLUMNS = ["label", "key", "title", "industry", "threat_score"]
EDGE_COLUMNS = ["src_label", "src", "rel", "dst_label", "dst"]
LABEL_OF = {
    "cve_ids": "CVE",
    "malware_names": "Malware",
    "threat_actors": "ThreatActor",
    "ip_addresses": "IPAddress",
}
_EDGE = "struct<src_label:string,src:string,rel:string,dst_label:string,dst:string>"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _entities() -> Column:
    return sum((F.size(k) for k in KINDS), F.lit(0))


def graph_articles(df: DataFrame) -> DataFrame:
    """Rows that enter the graph: a URL and at least one entity."""
    return df.where((_text("url") != "") & (_entities() > 0))


def article_nodes(df: DataFrame, order: str) -> DataFrame:
    """One Article node per URL; the last row by ``order`` sets the properties."""
    ties = [F.col(c).desc() for c in ("title", "primary_industry", "threat_score")]
    last = first_per(graph_articles(df), [_text("url")], F.col(order).desc(), *ties)
    return last.select(
        F.lit("Article").alias("label"),
        _text("url").alias("key"),
        _text("title").alias("title"),
        _text("primary_industry").alias("industry"),
        _text("threat_score").alias("threat_score"),
    )


def _noder(label: str) -> Callable[[Column], Column]:
    return lambda key: F.struct(F.lit(label).alias("label"), key.alias("key"))


def entity_nodes(df: DataFrame) -> DataFrame:
    """Entity and Industry nodes, unique by (label, key).

    All kinds leave one explode, so the text work upstream runs once.
    """
    named = [F.transform(F.col(k), _noder(label)) for k, label in LABEL_OF.items()]
    industry = F.array(_noder("Industry")(_text("primary_industry")))
    nodes = graph_articles(df).select(F.inline(F.concat(*named, industry))).where("key <> ''").distinct()
    return nodes.select("label", "key", *[F.lit(None).cast("string").alias(c) for c in NODE_COLUMNS[2:]])


def _edge(src_label: str, src: Column, rel: str, dst_label: str, dst: Column) -> Column:
    return F.struct(
        F.lit(src_label).alias("src_label"),
        src.alias("src"),
        F.lit(rel).alias("rel"),
        F.lit(dst_label).alias("dst_label"),
        dst.alias("dst"),
    )


def _mentions() -> Column:
    def to(label: str) -> Callable[[Column], Column]:
        return lambda entity: _edge("Article", _text("url"), "MENTIONS", label, entity)

    return F.concat(*[F.transform(F.col(k), to(label)) for k, label in LABEL_OF.items()])


def _article_targets() -> Column:
    return F.array(_edge("Article", _text("url"), "TARGETS", "Industry", _text("primary_industry")))


def _pairs(left: str, rel: str, right: str) -> Column:
    """Edges between the entities of two kinds within one article."""
    return F.flatten(
        F.transform(
            F.col(left),
            lambda a: F.transform(F.col(right), lambda b: _edge(LABEL_OF[left], a, rel, LABEL_OF[right], b)),
        )
    )


def _actor_targets() -> Column:
    industry = _text("primary_industry")
    return F.transform(
        F.col("threat_actors"), lambda a: _edge("ThreatActor", a, "TARGETS", "Industry", industry)
    )


def _edges_from(df: DataFrame, *groups: Column) -> DataFrame:
    """Distinct edges; repeats collapse in each map task before the shuffle."""
    every = F.concat(*[g.cast(f"array<{_EDGE}>") for g in groups])
    return graph_articles(df).select(F.inline(every)).where("dst <> ''").distinct()


def mentions(df: DataFrame) -> DataFrame:
    return _edges_from(df, _mentions())


def article_targets(df: DataFrame) -> DataFrame:
    return _edges_from(df, _article_targets())


def actor_uses(df: DataFrame) -> DataFrame:
    return _edges_from(df, _pairs("threat_actors", "USES", "malware_names"))


def malware_exploits(df: DataFrame) -> DataFrame:
    return _edges_from(df, _pairs("malware_names", "EXPLOITS", "cve_ids"))


def actor_targets(df: DataFrame) -> DataFrame:
    return _edges_from(df, _actor_targets())


def actor_infra(df: DataFrame) -> DataFrame:
    return _edges_from(df, _pairs("threat_actors", "USES_INFRASTRUCTURE", "ip_addresses"))


def graph_edges(df: DataFrame) -> DataFrame:
    """All edge kinds from one pass over the entity rows."""
    return _edges_from(
        df,
        _mentions(),
        _article_targets(),
        _pairs("threat_actors", "USES", "malware_names"),
        _pairs("malware_names", "EXPLOITS", "cve_ids"),
        _actor_targets(),
        _pairs("threat_actors", "USES_INFRASTRUCTURE", "ip_addresses"),
    )


def graph_nodes(df: DataFrame, order: str) -> DataFrame:
    return article_nodes(df, order).unionByName(entity_nodes(df))


def build_graph(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a fresh graph. Stage ``df`` first: both sides read it."""
    return graph_nodes(df, order), graph_edges(df)


def latest_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per (label, key); the highest ``order`` wins."""
    return first_per(nodes, ["label", "key"], F.col(order).desc()).select(*NODE_COLUMNS)


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE_COLUMNS).distinct()


def merge_graph(
    nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add new nodes and edges; nothing is deleted.

    New article properties replace old ones, while an old TARGETS edge stays
    when an article's industry changes.
    """
    both = nodes.withColumn("_run", F.lit(0)).unionByName(new_nodes.withColumn("_run", F.lit(1)))
    return latest_nodes(both, "_run"), unique_edges(edges.unionByName(new_edges))


def graph_counters(df: DataFrame) -> DataFrame:
    """Articles, entity mentions and entity relations as attempted, repeats included."""
    n = {k: F.size(k) for k in KINDS}
    with_industry = F.when(_text("primary_industry") != "", n["threat_actors"]).otherwise(0)
    relations = (
        n["threat_actors"] * n["malware_names"]
        + n["malware_names"] * n["cve_ids"]
        + with_industry
        + n["threat_actors"] * n["ip_addresses"]
    )
    zero = F.lit(0)
    return graph_articles(df).agg(
        F.count("*").alias("articles_added"),
        F.coalesce(F.sum(_entities()), zero).cast("long").alias("entity_mentions"),
        F.coalesce(F.sum(relations), zero).cast("long").alias("relations_attempted"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(part, name, n)``: totals, nodes by label and edges by type, most frequent first."""
    def counted(df: DataFrame, part: str, column: str) -> DataFrame:
        by = df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
        return by.select(F.lit(part).alias("part"), "name", "n")

    parts = counted(nodes, "node", "label").unionByName(counted(edges, "edge", "rel"))
    # Totals add up the few per-label counts instead of scanning again.
    rolled = parts.rollup("part", "name").agg(F.sum("n").alias("n"))
    named = rolled.where("part is not null").withColumn("name", F.coalesce("name", F.lit("(total)")))
    return named.orderBy("part", F.desc("n"), "name")
