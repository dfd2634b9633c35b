"""Quality filters, de-duplication and stage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.text import strip_ws, word_count


def first_per(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each key group in ``order``.

    The rank-1 filter lets Spark cut every group to one row per map task before
    the shuffle, so a key holding a third of all rows costs no more than others.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def not_stored(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is neither blank nor in ``stored``.

    Keys alone meet the store: they are made distinct and anti-joined, and the
    few new ones pick the rows. Texts are read once, behind that, and are not
    shuffled where the new keys are few enough for adaptive execution to
    broadcast them.
    """
    fresh = df.where(F.col(key) != "").select(key).distinct().join(stored.select(key), key, "left_anti")
    return df.join(fresh, key, "left_semi")


def min_words(
    df: DataFrame, n: int = vocab.ARTICLE_MIN_WORDS, inclusive: bool = False, column: str = "clean_text"
) -> DataFrame:
    """Keep rows with more than ``n`` words (``inclusive``: at least ``n``)."""
    words = word_count(column)
    return df.where(words >= n if inclusive else words > n)


def dedupe_text(df: DataFrame, order: str, column: str = "clean_text") -> DataFrame:
    """Drop exact copies of ``column``, keeping the first row by ``order``.

    Groups by a 256-bit digest, so the sort and shuffle key stays short.
    """
    return first_per(df, [F.sha2(F.col(column), 256)], F.col(order).asc())


def has_good_title(title: Column, strict: bool = True) -> Column:
    """``strict``: trimmed title over ten characters and not ``nan``; else just not blank."""
    trimmed = strip_ws(F.coalesce(title, F.lit("")))
    if strict:
        return (F.length(trimmed) > vocab.TITLE_MIN_CHARS) & (title != "nan")
    return trimmed != ""


def good_title(df: DataFrame, strict: bool = True, column: str = "title") -> DataFrame:
    return df.where(has_good_title(F.col(column), strict))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``columns``."""
    return df.na.drop(subset=columns)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def count_steps(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Nested filters counted in one pass: ``(position, step, kept, removed)``.

    Each condition applies to the rows the earlier ones kept; ``loaded`` is the
    unfiltered count.
    """
    names, passed, sums = ["loaded"], F.lit(True), [F.count("*").alias("k0")]
    for i, (name, cond) in enumerate(steps.items(), start=1):
        passed = passed & F.coalesce(cond, F.lit(False))
        names.append(name)
        sums.append(F.count(F.when(passed, 1)).alias(f"k{i}"))
    return _unfold(df.agg(*sums), names)


def _unfold(row: DataFrame, names: list[str]) -> DataFrame:
    steps = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("step"),
            F.col(f"k{i}").alias("kept"),
            (F.col(f"k{i - 1}") - F.col(f"k{i}") if i else F.lit(0).cast("long")).alias("removed"),
        )
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*steps)))


def cleaning_funnel(df: DataFrame, order: str) -> DataFrame:
    """Rows kept and removed by the batch filters: length, exact copies, title.

    One pass without dragging texts along: copies collapse to their digest, and
    each digest keeps whether its first row has a good title.
    """
    flags = df.select(
        (word_count("clean_text") > vocab.ARTICLE_MIN_WORDS).alias("long_enough"),
        F.sha2(F.col("clean_text"), 256).alias("digest"),
        F.struct(F.col(order).alias("o"), has_good_title(F.col("title")).alias("ok")).alias("row"),
    )
    # Rows that are too short share one group per map task after partial aggregation.
    groups = flags.groupBy("long_enough", F.when(F.col("long_enough"), F.col("digest")).alias("digest")).agg(
        F.count("*").alias("n"), F.min("row").alias("first")
    )
    long = F.col("long_enough")
    counts = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("k0"),
        F.coalesce(F.sum(F.when(long, F.col("n"))), F.lit(0)).alias("k1"),
        F.count(F.when(long, 1)).alias("k2"),
        F.count(F.when(long & F.col("first.ok"), 1)).alias("k3"),
    )
    return _unfold(counts, ["loaded", "min_words", "unique_text", "good_title"])
