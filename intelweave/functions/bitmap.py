"""A set of hashes as a bitmap sized from the set: a cheap test inside a row, in front of an exact join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_ITEM, PROBES = 32, 2  # bits in all and bits set for a hash: under 0.4 % of other hashes pass
WORDS = 1 << 22  # of 64 bits, at most; beyond eight million hashes a bitmap fills up, and the join does more
CARRIED, MARKS = 1 << 20, 3  # words of a subquery, at most: two million hashes; bits set for a hash, all in one word


@dataclass
class Bitmap:
    """``words``: the bits as an array of longs, a constant in the plan; ``bits``: how many, a power of two; ``probes``: set for each hash."""

    words: Column
    bits: int
    probes: int = PROBES


def bits_for(n: int, per_item: int = PER_ITEM) -> int:
    """The power of two from ``per_item`` bits a hash on, at least 1,024, at most ``WORDS`` words."""
    return min(max(1 << max(n * per_item - 1, 0).bit_length(), 1024), WORDS * 64)


def _slots(h: Column, bits: int, probes: int) -> list[Column]:
    step = F.shiftrightunsigned(h, 32)
    return [(h.bitwiseAND(bits - 1) + step * i).bitwiseAND(bits - 1) if i else h.bitwiseAND(bits - 1) for i in range(probes)]


def bitmap_of(df: DataFrame, column: str, per_item: int = PER_ITEM, probes: int = PROBES) -> Bitmap:
    """Bitmap of the hashes (longs) in ``column``, sized by their number; at most 32 MB of bits reach the driver.

    With 64 bits and four probes a hash, one other hash in 50,000 passes: for rows of many hashes, of which one
    alone brings the row along. ``df`` is read twice, to be counted and to set bits; bits are merged on the map side.
    They stand in the plan as text, which the driver holds many times over: for large sets see ``asked_in_subquery``.
    """
    bits = bits_for(df.count(), per_item)
    slots = df.select(F.explode(F.array(*_slots(F.col(column), bits, probes))).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return Bitmap(F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>"), bits, probes)


def may_hold(bitmap: Bitmap, h: Column) -> Column:
    """False only for a hash that is not in the set."""
    found = [F.getbit(F.get(bitmap.words, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1 for s in _slots(h, bitmap.bits, bitmap.probes)]
    return reduce(Column.__and__, found)


def asked_in_subquery(df: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is false only for hashes (longs) that are not in ``column``, for rows; Spark allows no subquery in lambdas.

    Tasks of whatever query uses the test put the bits together. They reach the driver as one binary row and go out
    with the tasks, 8 MB at most, and never stand in a plan or its text. All bits of a hash are in one word, so that
    the words are held and sent once for a test. 32 bits a hash let under 0.4 % of others pass, up to two million
    hashes; of eight million still over nine tenths are stopped, and the join does more. Hashes may repeat.
    """
    n = min(bits_for(df.select(column).distinct().count()) // 64, CARRIED)
    one, bit = F.lit(1).cast("long"), lambda h, i: F.shiftrightunsigned(h, 40 + 6 * i).bitwiseAND(63).cast("int")
    word_of = lambda h: h.bitwiseAND(n - 1).cast("int")
    marks_of = lambda h: reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, bit(h, i)) for i in range(MARKS)])
    in_order = lambda by: F.sort_array(F.collect_list(F.struct(by, "bits")))["bits"].alias("bits")

    marked = df.where(F.col(column).isNotNull()).select(word_of(F.col(column)).alias("word"), marks_of(F.col(column)).alias("bits"))
    blank = df.sparkSession.range(n).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # Pieces of 4,096 words first: the task that joins them sorts few rows.
    pieces = words.groupBy(F.shiftright("word", 12).alias("piece")).agg(in_order("word"))
    whole = pieces.agg(in_order("piece")).select(F.flatten("bits")).scalar()
    return lambda h: F.get(whole, word_of(h)).bitwiseAND(marks_of(h)) == marks_of(h)
