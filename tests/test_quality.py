from pyspark.sql import functions as F

from intelweave.operators import quality as Q
from intelweave.operators import sampling as R


def test_word_limits(texts):
    df = texts([" ".join(["word"] * n) for n in (99, 100, 101)])
    assert [r[0] for r in Q.min_words(df).select("doc_id").collect()] == [2]
    assert [r[0] for r in Q.min_words(df, inclusive=True).select("doc_id").collect()] == [1, 2]


def test_titles(spark):
    df = spark.createDataFrame([("nan",), ("  short    ",), ("long enough title",), (" ",), (None,)], "title string")
    assert Q.good_title(df).count() == 1
    assert Q.good_title(df, strict=False).count() == 3


def hot_copies(spark):
    """A third of all rows share one text."""
    return spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("a title long enough").alias("title"),
        F.when(F.col("id") % 3 == 1, F.lit("copy " * 120)).otherwise(F.concat(F.lit("word " * 120), "id")).alias("clean_text"))


def test_dedupe_keeps_the_first_and_cuts_before_the_shuffle(spark):
    out = Q.dedupe_text(hot_copies(spark), "doc_id")
    assert out.count() == 2001
    assert out.where("clean_text like 'copy%'").first()["doc_id"] == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange") and plan.count("WindowGroupLimit") == 2


def test_funnel(spark):
    rows = hot_copies(spark).withColumn("title", F.when(F.col("doc_id") == 1, "nan").otherwise(F.col("title")))
    rows = rows.unionByName(rows.limit(5).withColumn("clean_text", F.lit("short")))
    got = [(r["step"], r["kept"], r["removed"]) for r in Q.cleaning_funnel(rows, "doc_id").collect()]
    assert got == [("loaded", 3005, 0), ("min_words", 3000, 5), ("unique_text", 2001, 999), ("good_title", 2000, 1)]


def test_exact_sample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for n in (0, 1, 777, 4999, 5000, 9000):
        picked = R.sample_exact(df, n, ["k"])
        assert picked.count() == min(n, 5000)
    a = {r[0] for r in R.sample_exact(df, 777, ["k"]).collect()}
    b = {r[0] for r in R.sample_exact(df.repartition(13), 777, ["k"]).collect()}
    hashed = df.withColumn("h", R.row_hash(["k"], 42)).orderBy("h").limit(777)
    assert a == b == {r["k"] for r in hashed.collect()}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    train, test = R.split(df, ["k"])
    assert train.count() + test.count() == 4000
    assert abs(train.count() - 3200) < 150
    again, _ = R.split(df.repartition(11), ["k"])
    assert {r[0] for r in train.collect()} == {r[0] for r in again.collect()}
