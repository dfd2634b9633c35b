"""SimHash near-duplicates by meeting in the middle.

Two fingerprints within three bits meet half-way: flip one bit of each, and leave one of three blocks
of bits out. (Three is odd; of three differing bits at least one lies in some block, and without that
block at most two are left, one for each side.) So every distinct fingerprint emits, for each block,
its remaining bits and all their variants within one bit: 132 keys of 42 or 43 bits. Fingerprints that
share a key are compared bit by bit; the key is long enough that few meet by chance.

A key shared by more than ``bucket`` fingerprints, as in a large group of near copies, is not paired
up. Its fingerprints meet again on whole keys instead: all variants within one bit on one side, within
two on the other. There every meeting is a link by itself, so each fingerprint is linked to the least
one of its key, and the number of links stays in proportion to the variants.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.llm.common import components, sorted_runs, staged

RADIUS = 3
BLOCKS = [(0, 21), (21, 42), (42, 64)]
LINKS = "a long, b long"


def fingerprint_of(text: str, size: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; no words: zero."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at exactly space and \t to \r
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        parts = [line]
    else:
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(n) - 1
        starts = ends - n + 1
        parts = [line[a:b] for a, b in zip(starts.tolist(), ends[size - 1:].tolist())]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), parts), np.uint64, len(parts))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint_of).astype("int64")

    return fingerprint(F.coalesce(text, F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block_variants() -> list[tuple[int, int]]:
    """(bits kept, bit flipped) of the 132 keys."""
    out = []
    for low, high in BLOCKS:
        kept = ((1 << 64) - 1) ^ ((1 << high) - (1 << low))
        out += [(_signed(kept), 0)] + [(_signed(kept), _signed(1 << b)) for b in range(64) if not low <= b < high]
    return out


def _ball(radius: int) -> list[int]:
    return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(64), r)]


def _links(a: np.ndarray, b: np.ndarray, lone: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    lone = np.unique(lone)
    first = pa.array(np.concatenate([pairs[:, 0], lone]))
    second = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(lone), np.int64)]), mask=np.arange(len(first)) >= len(pairs))
    return pa.RecordBatch.from_arrays([first, second], names=["a", "b"])


def close_pairs(fingerprints: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) within the radius; b is null for a fingerprint of a key with more than ``bucket`` of them."""
    shape = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(x).cast("long").alias("x")) for m, x in _block_variants()])
    keys = fingerprints.select("fp", F.explode(shape).alias("v")).select(F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.x")).alias("key"), "fp")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = None  # the key of a long run whose first pieces are gone
        for key, fp in sorted_runs(batches, bucket):
            fresh = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
            key, fp = key[fresh], fp[fresh]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            many = (size > bucket) | ((key[start] == hot) if hot is not None else False)
            lone = [fp[np.repeat(many, size)]]
            hot = key[-1] if many[-1] else None
            left, right = [], []
            for n in np.unique(size[~many]):
                if n > 1:
                    block = fp[start[(size == n) & ~many][:, None] + np.arange(n)]
                    i, j = np.triu_indices(n, 1)
                    for k in range(0, len(block), 4096):
                        x, y = block[k:k + 4096, i].ravel(), block[k:k + 4096, j].ravel()
                        near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
                        left.append(x[near])
                        right.append(y[near])
            a, b = (np.concatenate(s) if s else np.empty(0, np.int64) for s in (left, right))
            if len(a) or len(lone[0]):
                yield _links(a, b, lone[0])

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(pair, LINKS)


def star_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius, by whole keys: each to the least one within a bit of the key."""
    def ball(radius: int, side: int) -> DataFrame:
        flips = F.array(*[F.lit(x).cast("long") for x in _ball(radius)])
        return fingerprints.select("fp", F.explode(flips).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("key"), F.lit(side).alias("side"), "fp")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = None  # (key, least fingerprint) of the run before
        for key, side, fp in sorted_runs(batches, 1 << 16):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            least, one = fp[start].copy(), side[start] == 0
            if center is not None and key[0] == center[0]:
                least[0], one[0] = center[1], True
            center = (key[-1], least[-1]) if one[-1] else None
            use = np.repeat(one, size)
            a, b = fp[use], np.repeat(least, size)[use]
            yield _links(a[a != b], b[a != b], np.empty(0, np.int64))

    rows = ball(1, 0).unionByName(ball(2, 1))
    return rows.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(star, LINKS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed 64 bits), ``component_id``: the least id it reaches over links.

    Rows without words, null texts too, have the fingerprint zero and are linked like any other. Ids
    that are null never become a component's id; a component without any other has a null one. Rows
    that repeat an id keep it. Other columns are left out, so their names cannot clash.

    Fingerprints are made distinct, with a partial aggregate, before anything is emitted, so exact
    copies cost one row each and no pairs. One key holds at most one of a fingerprint's 132 rows.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = staged(close_pairs(classes.select("fp"), bucket), "links")
    hot = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    links = found.filter("b IS NOT NULL")
    if not hot.isEmpty():
        links = links.unionByName(star_links(hot))
    roots = components(links)
    joint = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    ids = joint.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staged(joint.join(ids, "root").select("fp", "component_id").unionByName(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))), "components")
    return rows.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
