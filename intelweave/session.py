"""Session defaults, shared folders and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def get_session(app: str = "intelweave", **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; ``conf`` overrides, e.g. ``**{"spark.master": ...}``."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one inside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intelweave").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder; whoever writes there removes it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder and read on from there.

    Survives lost executors, unlike a cache. Spark drops the files with the frame
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, rows: int = 500) -> DataFrame:
    """``df`` dealt out by ``key`` over several tasks a slot, of at least ``rows`` rows on average; counts ``df`` first.

    For costly steps over files: Spark cuts these, like the partitions of a shuffle, into about as many tasks as
    there are slots, often one more, and that one runs alone when all others are done.
    """
    tasks = min(4 * df.sparkSession.sparkContext.defaultParallelism, df.count() // rows)
    return df.repartition(max(tasks, 1), key)
