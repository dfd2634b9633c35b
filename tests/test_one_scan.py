"""Queries that need the documents several times read them once and go on from a staged table."""

import random

import pytest
from pyspark.sql import functions as F

from checks import catalog, views
from intelweave.session import spread

WORDS = "river stone garden market window letter summer number village bridge paper forest group files used".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    draw = random.Random(3)
    folder = str(tmp_path_factory.mktemp("tables"))
    text = lambda n: ". ".join(" ".join(draw.choice(WORDS) + str(draw.randint(0, 9)) for _ in range(12)) for _ in range(n))
    rows = [(i, text(draw.randint(1, 20)), "en", "web", 1) for i in range(60)] + [(60, None, "en", "web", 0), (61, "", "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture()
def reads(monkeypatch):
    """Names of the tables asked for."""
    asked, read = [], views.read_table
    monkeypatch.setattr(views, "read_table", lambda spark, sf, name, key: asked.append(name) or read(spark, sf, name, key))
    return asked


@pytest.mark.parametrize("name", ["incremental_runs", "build_then_increment", "tag_sentences", "gazetteer_large"])
def test_documents_are_read_once(spark, sf, reads, name):
    out = catalog.QUERIES[name](spark, sf)
    assert reads == ["documents"]
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]
    assert out.count() > 0


def test_articles_are_cleaned_once_for_three_models_and_their_use(spark, sf):
    out = catalog.QUERIES["tag_articles"](spark, sf)
    # What cleans texts drops the markup first; the plan that tags reads clean texts.
    assert "<.*?>" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"] for r in out.collect()} <= set(range(62))


def test_costly_steps_are_dealt_over_several_tasks_a_slot(spark):
    """Nine partitions on eight slots take as long as sixteen would; few rows stay in few tasks."""
    slots = spark.sparkContext.defaultParallelism
    many = spread(spark.range(0, 40_000, 1, slots + 1).withColumn("url", F.md5(F.col("id").cast("string"))), "url")
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 * slots and max(sizes) < 1.2 * 40_000 / len(sizes) and sum(sizes) == 40_000
    assert spread(spark.range(0).withColumn("url", F.lit("u")), "url").count() == 0
    assert spread(spark.range(1200).withColumn("url", F.lit("u")), "url").rdd.getNumPartitions() == 2
