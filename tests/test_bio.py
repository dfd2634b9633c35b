import random

from intelweave import vocab
from intelweave.operators import bio as B
from pyspark.sql import functions as F


def brute_tags(words):
    tags = ["O"] * len(words)
    for kind, terms in (("MALWARE", vocab.MALWARE_TERMS), ("ACTOR", vocab.ACTOR_TERMS)):
        for term in sorted(terms, key=len, reverse=True):
            n = len(term.split())
            for i in range(len(words) - n + 1):
                if " ".join(words[i:i + n]).lower() == term:
                    tags[i:i + n] = [f"B-{kind}"] + [f"I-{kind}"] * (n - 1)
    return tags


def brute_spans(words, tags):
    spans, cur, kind = [], [], None
    for w, t in [*zip(words, tags), ("", "O")]:
        if t.startswith("I-") and cur and kind == t[2:]:
            cur.append(w)
            continue
        if cur:
            spans.append(("malware" if kind == "MALWARE" else "actor", " ".join(cur).lower()))
        cur, kind = ([w], t[2:]) if t.startswith("B-") else ([], None)
    return spans


def sentences(spark, n, seed):
    rng = random.Random(seed)
    pool = ["Lazarus", "Group", "lazarus", "cl0p", "gang", "Cobalt", "Strike", "strike", "emotet", "vice", "society",
            "cozy", "bear", "fancy", "and", "the", "word", "inc", "ransomware"]
    rows = [(i, 0, [rng.choice(pool) for _ in range(rng.randint(8, 25))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, sent int, words array<string>")


def test_labels_agree_with_brute_force(spark):
    rows, df = sentences(spark, 300, 3)
    got = {r["doc_id"]: r["tags"] for r in B.bio_label(df).collect()}
    assert got == {i: brute_tags(w) for i, _, w in rows}
    flat = B.tokens(B.bio_label(df), ["doc_id"])
    assert flat.count() == sum(len(w) for _, _, w in rows)


def test_decode_agrees_with_brute_force(spark):
    rng = random.Random(5)
    rows, _ = sentences(spark, 200, 4)
    tagged = [(i, s, w, [rng.choice(vocab.BIO_TAGS) for _ in w]) for i, s, w in rows]
    df = spark.createDataFrame(tagged, "doc_id long, sent int, words array<string>, tags array<string>")
    got = {}
    for r in B.decode(df, ["doc_id"]).orderBy("doc_id", "span").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["entity"]))
    assert got == {i: s for i, _, w, t in tagged if (s := brute_spans(w, t))}


def test_orphan_inside_tag_is_dropped(spark):
    df = spark.createDataFrame(
        [(1, 0, ["Wanna", "cry", "now"], ["B-MALWARE", "I-ACTOR", "I-MALWARE"])],
        "doc_id long, sent int, words array<string>, tags array<string>")
    assert [(r["kind"], r["entity"]) for r in B.decode(df, ["doc_id"]).collect()] == [("malware", "wanna")]


def test_sentences(texts):
    df = texts(["one two. three four five\nsix", " . .a b c d"])
    got = [(r["doc_id"], r["sent"], r["words"]) for r in B.sentences(df, ["doc_id"], lo=3, hi=None).collect()]
    assert got == [(0, 1, ["three", "four", "five"]), (1, 2, ["a", "b", "c", "d"])]


def test_training_sample_balances(spark):
    _, df = sentences(spark, 50, 6)
    plain = spark.range(500).select(
        (F.col("id") + 1000).alias("doc_id"), F.lit(0).alias("sent"), F.array_repeat(F.lit("plain"), 9).alias("words"))
    labelled = B.bio_label(df.unionByName(plain))
    n = labelled.where(B.has_entity(F.col("tags"))).count()
    sample = B.ner_training_sample(labelled, ["doc_id"])
    assert sample.count() == 2 * n
    assert B.ner_training_sample(labelled, ["doc_id"], cap=7).count() == n + 7


def test_tag_with_user_model(spark):
    _, df = sentences(spark, 20, 8)
    out = B.tag_with(df, lambda: lambda batch: [["O"] * len(w) for w in batch], ["doc_id"])
    assert out.where(F.size("tags") == F.size("words")).count() == 20


def test_token_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (-100, 5), (3, 3)], "label int, pred int")
    assert B.token_accuracy(df).first()[0] == 0.6667
    assert B.token_accuracy(df.where("label = -100")).first()[0] == 0.0
