"""Vector collection and graph tables kept as parquet.

A store is a folder with one ``increment=<n>`` partition per run. Overwriting a
partition makes a retried run land on the same files, so an executor or driver
lost halfway leaves nothing twice. A full rebuild replaces the whole folder and
leaves its rows in partition ``BASE``, which precedes every increment.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intelweave.operators import graph as G
from intelweave.operators import kept_counts as K
from intelweave.operators.vectors import add_vectors

BASE = -1

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("threat_score", T.StringType()),
        T.StructField("primary_industry", T.StringType()),
        T.StructField("industry_score", T.StringType()),
    ]
)
NODE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("label", "key", "title", "industry", "threat_score")]
)
EDGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("src_label", "src", "rel", "dst_label", "dst")]
)


def read_increments(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """All partitions of a store, or only those of earlier increments; empty if absent."""
    full = T.StructType([*schema.fields, T.StructField("increment", T.LongType())])
    try:
        df = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return df if before is None else df.where(F.col("increment") < before)


def write_increment(df: DataFrame, path: str, increment: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/increment={increment}")


def write_base(df: DataFrame, path: str) -> None:
    """Replace the whole store by ``df``, as the partition in front of all increments."""
    df.withColumn("increment", F.lit(BASE)).write.mode("overwrite").partitionBy("increment").parquet(path)


LEDGER_SCHEMA = T.StructType([T.StructField("url", T.StringType())])
BUCKETS = 64  # of the ledger: at most so many folders an increment


def url_bucket(url: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def write_ledger(urls: DataFrame, path: str, increment: int) -> None:
    """One increment of the ledger, a folder for each bucket of URLs; ``BASE`` replaces the whole ledger."""
    rows = urls.select("url", url_bucket(F.col("url")).alias("bucket"))
    # A bucket is one task's, and with it one file.
    rows = rows.repartition("bucket")
    if increment == BASE:
        rows.withColumn("increment", F.lit(BASE)).write.mode("overwrite").partitionBy("increment", "bucket").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/increment={increment}")


def read_ledger(spark: SparkSession, path: str, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """``(url, increment)`` of all increments or of earlier ones; with ``near``, only buckets that its URLs fall into.

    Whatever ``near`` holds, its URLs are found if the ledger has them: other buckets cannot hold them. The
    buckets, at most ``BUCKETS`` numbers, become a filter on the folder names, so other folders are not read.
    """
    full = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("increment", T.LongType()), T.StructField("bucket", T.IntegerType())])
    try:
        df = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], full)
    if before is not None:
        df = df.where(F.col("increment") < before)
    if near is not None:
        touched = sorted(r["bucket"] for r in near.select(url_bucket(F.col("url")).alias("bucket")).where("bucket IS NOT NULL").distinct().collect())
        # Folders of ledgers from before there were buckets have no number and are always read.
        df = df.where(F.col("bucket").isin(touched) | F.col("bucket").isNull())
    return df.drop("bucket")


def write_vectors(df: DataFrame, path: str, mode: str = "rebuild", increment: int = 0) -> None:
    """``rebuild`` drops the collection first; ``add`` writes only ids not stored yet."""
    if mode == "rebuild":
        write_base(df, path)
    elif mode == "add":
        stored = read_increments(df.sparkSession, path, VECTOR_SCHEMA, before=increment)
        write_increment(add_vectors(df, stored), path, increment)
    else:
        raise ValueError(f"mode must be 'rebuild' or 'add', not {mode!r}")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_increments(spark, path, VECTOR_SCHEMA).drop("increment")


def write_graph(
    nodes: DataFrame, edges: DataFrame, path: str, clear_first: bool = True, increment: int = 0
) -> None:
    """Replace the graph, or merge one more increment into it.

    ``clear_first`` may not read from the same ``path`` it replaces.
    """
    for df, name in ((nodes, "nodes"), (edges, "edges")):
        target = f"{path}/{name}"
        if clear_first:
            write_base(df, target)
        else:
            write_increment(df, target, increment)


STATE_SCHEMA = "number long, step string, upto long"


def _compaction(spark: SparkSession, path: str) -> tuple[int, int | None]:
    """Number of the last compaction begun, and the last increment it covers while its tables are not all in place."""
    try:
        rows = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/compacted/state").collect()  # two rows a compaction
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    number = max((r["number"] for r in rows), default=0)
    last = {r["step"]: r["upto"] for r in rows if r["number"] == number}
    return number, last["merged"] if "merged" in last and "placed" not in last else None


def _mark(spark: SparkSession, path: str, number: int, step: str, upto: int) -> None:
    spark.createDataFrame([(number, step, upto)], STATE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/compacted/state")


def compact_graph(spark: SparkSession, path: str) -> None:
    """Merge all increments into the base, so that later reads do not merge them again.

    The merged tables are written aside, and a row of state says that they are whole; only then the base is
    replaced and the merged increments are emptied, oldest first. A run that ends at any point loses nothing:
    until the last row of state is there, readers look at the tables aside too, and a repeated run goes on from
    them. Increments that arrive in between are kept.
    """
    aside = f"{path}/compacted"
    number, upto = _compaction(spark, path)
    if upto is None:
        number += 1
        seen = [read_increments(spark, f"{path}/{name}", schema).agg(F.max("increment")).first()[0] for name, schema in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA))]
        upto = max((n for n in seen if n is not None), default=BASE)
        for df, name in zip(read_graph(spark, path, upto), ("nodes", "edges")):
            df.write.mode("overwrite").parquet(f"{aside}/{name}")
        _mark(spark, path, number, "merged", upto)
    for name, schema in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA)):
        write_increment(spark.read.schema(schema).parquet(f"{aside}/{name}"), f"{path}/{name}", BASE)
        held = read_increments(spark, f"{path}/{name}", schema).select("increment").distinct().where(F.col("increment").between(BASE + 1, upto))
        for n in sorted(r["increment"] for r in held.collect()):
            write_increment(spark.createDataFrame([], schema), f"{path}/{name}", n)
    _mark(spark, path, number, "placed", upto)


def _graph_rows(spark: SparkSession, path: str, upto: int | None) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows with their increments, not merged."""
    nodes = read_increments(spark, f"{path}/nodes", NODE_SCHEMA, None if upto is None else upto + 1)
    edges = read_increments(spark, f"{path}/edges", EDGE_SCHEMA, None if upto is None else upto + 1)
    if _compaction(spark, path)[1] is not None:
        nodes, edges = (df.unionByName(spark.read.schema(schema).parquet(f"{path}/compacted/{name}").withColumn("increment", F.lit(BASE).cast("long")))
                        for df, name, schema in ((nodes, "nodes", NODE_SCHEMA), (edges, "edges", EDGE_SCHEMA)))
    return nodes, edges


def read_graph(spark: SparkSession, path: str, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged nodes and edges over all increments (or those up to one); later article properties win."""
    nodes, edges = _graph_rows(spark, path, upto)
    return G.latest_nodes(nodes, "increment"), G.unique_edges(edges)


def write_counts(spark: SparkSession, path: str, counts_path: str, increment: int) -> None:
    """Keep the counts of the graph at ``path`` up to date with the increment written last.

    Only the part of the graph that the increment touches is counted. A graph from before counts were kept is
    counted whole, once. A repeated run overwrites its own partition, as everywhere here.
    """
    if increment == BASE:
        return write_base(K.count_graph(*read_graph(spark, path, BASE)), counts_path)
    counts = T.StructType.fromDDL(K.COUNT_SCHEMA)
    if read_increments(spark, counts_path, counts, before=increment).isEmpty():
        write_increment(K.count_graph(*read_graph(spark, path, increment - 1)), counts_path, BASE)
    old = _graph_rows(spark, path, increment - 1)
    new = [read_increments(spark, f"{path}/{name}", schema).where(F.col("increment") == increment)
           for name, schema in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA))]
    write_increment(K.count_changes(*old, *new), counts_path, increment)


def read_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    return K.add_up(read_increments(spark, counts_path, T.StructType.fromDDL(K.COUNT_SCHEMA)))
