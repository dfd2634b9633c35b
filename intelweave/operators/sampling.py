"""Deterministic splits and exact-size samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(keys: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def split(df: DataFrame, keys: list[str], fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hash split on a row key: same rows on every run and any partitioning."""
    prefix = F.conv(F.substring(row_hash(keys, seed), 1, 8), 16, 10).cast("long")
    edge = int(fraction * 16**8)
    return df.where(prefix < edge), df.where(prefix >= edge)


def sample_exact(df: DataFrame, n: int | Column, keys: list[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest key hash (all rows if fewer); ``keys`` must be unique.

    No global sort: rows are counted per 16-bit hash prefix, prefixes below the
    cut are taken whole, and only the one prefix the cut falls into is ranked.
    The prefix table has at most 65,536 rows, hence the broadcast.
    """
    n = F.lit(n) if isinstance(n, int) else n
    hashed = df.withColumn("_hash", row_hash(keys, seed)).withColumn("_prefix", F.substring("_hash", 1, 4))
    earlier = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("_prefix").agg(F.count("*").alias("_size"))
    below = sizes.withColumn("_below", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    needed = below.withColumn("_n", n).where("_below < _n")
    near = hashed.join(F.broadcast(needed), "_prefix")
    whole = near.where("_below + _size <= _n")
    rank = F.row_number().over(Window.partitionBy("_prefix").orderBy("_hash", *keys))
    cut = near.where("_below + _size > _n").withColumn("_rank", rank).where("_rank <= _n - _below")
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))
