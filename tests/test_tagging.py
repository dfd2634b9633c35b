from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.operators import tagging as C


def test_model_input(spark):
    df = spark.createDataFrame([(" T ", " " + "a" * 400)], "title string, clean_text string")
    assert df.select(C.model_input()).first()[0] == "T. " + "a" * 300


def test_scores(spark):
    df = spark.createDataFrame([("a finance bank report",)], "t string")
    one = df.select(C.score_labels(F.col("t"), ["Finance", "ICS"], False).alias("s")).first()["s"]
    assert one[0]["label"] == "Finance" and abs(sum(s["score"] for s in one) - 1) < 1e-9
    many = df.select(C.score_labels(F.col("t"), vocab.INDUSTRIES, True).alias("s")).first()["s"]
    assert [s["label"] for s in many][:2] == ["Finance", "Healthcare"] and len(many) == 7


def test_pick(spark):
    t = "array<struct<label:string,score:double>>"
    rows = [
        ("keep", [("threat", 0.55)], [("ICS", 0.91234567), ("IoT", 0.41)]),
        ("edge", [("threat", 0.9)], [("ICS", 0.9), ("IoT", 0.40)]),
        ("low", [("threat", 0.5499)], [("ICS", 0.9)]),
        ("off", [(vocab.UNRELATED_LABEL, 0.99)], [("ICS", 0.9)]),
        ("one", [("threat", 0.9)], [("ICS", 0.9)]),
    ]
    df = spark.createDataFrame(rows, f"url string, binary {t}, industry {t}")
    got = {r["url"]: (r["industry_score"], r["secondary_industry"]) for r in C.pick_labels(df).collect()}
    assert got == {"keep": (0.9123, "IoT"), "edge": (0.9, ""), "one": (0.9, "")}


def test_user_scorer(spark):
    df = spark.createDataFrame([("x",)], "t string")
    out = C.score_with(df, "t", "s", lambda: lambda ts: [[("a", 0.1), ("b", 0.9)] for _ in ts]).first()
    assert [s["label"] for s in out["s"]] == ["b", "a"]


def test_weights_and_codes(spark):
    df = spark.createDataFrame([("b",)] * 3 + [("a",)] + [(None,)], "y string")
    assert [(r["label_id"], r["label"]) for r in C.label_map(df, "y").orderBy("label_id").collect()] == [(0, "a"), (1, "b")]
    w = {r["y"]: r["weight"] for r in C.class_weights(df, "y").collect()}
    assert w == {"a": 2.0, "b": 4 / 6}
    assert C.encode_labels(df, "y").count() == 4


def test_balanced(spark):
    pos = spark.range(10).select(F.col("id").alias("k"), F.lit("w " * 31).alias("text"))
    neg = spark.range(100, 200).select(F.col("id").alias("k"), F.lit("n").alias("text"))
    got = C.balanced_training_set(pos, neg, "k").groupBy("label").count().orderBy("label").collect()
    assert [tuple(r) for r in got] == [(0, 10), (1, 10)]


def test_minority_class_is_learned(spark):
    rows = [(f"ics plant turbine {i % 7}", 0) for i in range(200)] + [(f"hospital patient clinic {i % 3}", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "text string, label_id int")
    model = C.train_industry(df, features=256, iterations=10)
    pred = C.predict(df, model)
    assert pred.where("label_id = 1 and prediction = 1").count() == 6
    score = C.evaluate(pred, "label_id").first()
    assert score["accuracy"] == 1.0 and score["weighted_f1"] == 1.0


def test_models_are_saved_and_loaded(spark, tmp_path):
    from intelweave.plans import train

    rows = [(f"u{i}", f"bank ransomware {i}", "emotet attack on the bank network " * 30, ["Finance", "ICS"][i % 2]) for i in range(12)]
    tagged = spark.createDataFrame(rows, "url string, title string, clean_text string, primary_industry string")
    negatives = spark.createDataFrame([(f"n{i}", "flowers and a quiet picnic by the river " * 10) for i in range(30)], "url string, text string")
    assert train.binary_training(tagged, negatives).groupBy("label").count().orderBy("label").collect() == [(0, 12), (1, 12)]
    models = train.fit_models(tagged, negatives, features=256, iterations=5)
    train.save_models(models, str(tmp_path / "m"))
    train.save_models(models, str(tmp_path / "m"))
    again = train.load_models(spark, str(tmp_path / "m"))
    same = lambda m: sorted(map(tuple, m.tag(tagged.drop("primary_industry")).select("url", "threat_score", "primary_industry", "industry_score").collect()))
    assert same(models) == same(again) and len(same(again)) == 12
