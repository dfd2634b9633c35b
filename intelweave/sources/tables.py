"""Readers and writers for articles, stage tables, ledger, label maps and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intelweave.functions.text import join_list, parse_list

ARTICLE_FIELDS = ["id", "title", "url", "content", "crawled_at"]
ARTICLE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ARTICLE_FIELDS]
    + [
        T.StructField("source", T.StringType()),
        T.StructField("advisory_id", T.StringType()),
        T.StructField("cves", T.ArrayType(T.StringType())),
        T.StructField("severity", T.StringType()),
        T.StructField("affected", T.StringType()),
    ]
)
LIST_COLUMNS = ["cve_ids", "ip_addresses", "malware_names", "threat_actors"]
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


# -- articles -------------------------------------------------------------


def scan_articles(spark: SparkSession, path: str) -> DataFrame:
    """All JSONL lines; ``is_bad`` marks the malformed ones, missing text is ""."""
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    # A line with one mistyped field still has its other fields; it is not bad.
    unread = reduce(Column.__and__, [F.col(f.name).isNull() for f in ARTICLE_SCHEMA.fields])
    return raw.withColumn("is_bad", F.col("_bad").isNotNull() & unread).drop("_bad").na.fill("")


def read_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed articles, and a one-row frame with the number of malformed lines (``bad_count``)."""
    lines = scan_articles(spark, path)
    # unread lines carry nothing but "" after filling, so counting the flag is enough
    bad = lines.agg(F.sum(F.col("is_bad").cast("long")).alias("n"), F.max("url").alias("_u"))
    return (
        lines.where(~F.col("is_bad")).drop("is_bad"),
        bad.select(F.coalesce("n", F.lit(0)).alias("bad_count")),
    )


def append_articles(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# -- stage tables ---------------------------------------------------------


def _list_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite one stage table; CSV flattens list columns to ``", "``-joined text."""
    if fmt == "csv":
        flat = df.withColumns({c: join_list(c) for c in _list_columns(df)})
        flat.write.mode("overwrite").options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def read_stage(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read a stage table; with CSV the list columns of ``schema`` are parsed back."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if schema is None:
        return spark.read.options(**_CSV).csv(path)
    lists = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in lists else f.dataType) for f in schema.fields]
    )
    return spark.read.schema(flat).options(**_CSV).csv(path).withColumns({c: parse_list(c) for c in lists})


# -- ledger ---------------------------------------------------------------


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Processed URLs, one per text line; blanks dropped. Duplicate lines collapse."""
    url = F.trim(F.col("value"))
    return spark.read.text(path).select(url.alias("url")).where("url <> ''").distinct()


def append_ledger(urls: DataFrame, path: str) -> None:
    urls.select(F.col("url").alias("value")).write.mode("append").text(path)


# -- label map ------------------------------------------------------------


def save_label_map(mapping: DataFrame, path: str) -> None:
    """Write ``(label_id, label)``; one row per class."""
    mapping.select("label_id", "label").write.mode("overwrite").json(path)


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label_id int, label string").json(path)


# -- pages and negatives --------------------------------------------------


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages ``(page_id, url, html[, content_type])``."""
    return spark.read.parquet(path)


def read_negatives(df: DataFrame, column: str = "text") -> DataFrame:
    """Any table with a text column as labelled negatives."""
    return df.select(F.col(column).alias("text")).where(F.col("text").isNotNull())
