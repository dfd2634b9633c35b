"""Staged tables, connected components and row keys shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.session import scratch


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder of the shared place and read on from there.

    The table outlives lost executors. The frames read from it stay lazy, so the folder is the
    session's: whoever clears the shared place removes it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key that tells rows apart also where ids are null or recur: the id with a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is the least node it reaches.

    Large-star and small-star steps in turn: each points neighbours at the least node they know of,
    and the number of rounds grows with the logarithm of a component's size. A step reduces on the map
    side and joins, so a node with very many links is split like any skewed join key. Links are staged
    after each round, never brought to the driver, and read in tasks by their size, once for both directions:
    the driver keeps some kilobytes of metrics for a task, and few links in many parts would cost it as much as many.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(down, "a")
        both = near.select(F.inline(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m")))).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(both.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def sorted_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole runs of equal first values, of sorted batches; a run longer than ``limit`` may come in pieces."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if len(cols[0]) - last > limit:
            last = len(cols[0])
        if last:
            yield tuple(c[:last] for c in cols)
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield tuple(rest)
