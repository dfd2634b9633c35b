"""Continuous ingestion of crawled articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from intelweave.plans.batch import Layout, Models
from intelweave.plans.increment import run_increment
from intelweave.sources.tables import ARTICLE_SCHEMA


def article_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSONL files arriving in a folder; lines without a URL (malformed ones too) are skipped."""
    reader = spark.readStream.schema(ARTICLE_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).na.fill("").where("url <> ''")


def start_increments(
    spark: SparkSession,
    path: str,
    models: Models,
    layout: Layout,
    checkpoint: str,
    available_now: bool = True,
    max_files: int | None = None,
    interval: str = "1 minute",
    first_increment: int = 0,
) -> StreamingQuery:
    """Run one increment per micro-batch.

    The checkpoint hands out each file once; a batch repeated after a failure
    keeps its id and therefore overwrites its own partitions. A failing store
    fails the batch, so the ledger never runs ahead of the tables. With a new
    checkpoint over old tables, set ``first_increment`` past the last one stored.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        run_increment(batch.sparkSession, batch, models, layout, increment=first_increment + batch_id)

    writer = article_stream(spark, path, max_files).writeStream.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.foreachBatch(one).trigger(**trigger).start()
