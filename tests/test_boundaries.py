import random

import pytest

from intelweave.operators import boundaries as B

WORDS = "river stone garden market window letter summer number village bridge paper forest".split()


@pytest.fixture(scope="module")
def learnt(spark):
    """Texts with planted abbreviations: `approx.`, `e.g.` and `Dr.`, whose periods end no sentence."""
    draw = random.Random(5)
    texts = []
    for i in range(300):
        out = []
        for _ in range(8):
            words = [draw.choice(WORDS) for _ in range(draw.randint(5, 9))]
            if draw.random() < 0.4:
                words.insert(3, draw.choice(["approx.", "e.g.", "Dr. Meyer"]))
            out.append(" ".join([draw.choice(["The", "Then", "It"]), *words]) + draw.choice([".", ".", ".", "?"]))
        texts.append((i, out))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "id long, text string")
    return texts, df, B.learn_boundaries(df)


def test_planted_abbreviations_are_learnt(learnt):
    _, _, model = learnt
    assert {r["word"] for r in model.abbreviations.collect()} == {"approx", "e.g", "dr"}
    assert {r["word"] for r in model.starters.collect()} == {"the", "then", "it"}
    assert ("dr", "meyer") in {tuple(r) for r in model.collocations.collect()}


def test_sentences_are_those_planted(learnt):
    texts, df, model = learnt
    got = {r["id"]: r["sentences"] for r in B.split_sentences(df, model, ["id"]).collect()}
    assert got == dict(texts)


def test_counts_are_whole(learnt):
    texts, df, _ = learnt
    counts = {r["word"]: (r["with_period"], r["without_period"]) for r in B.word_counts(B.pair_counts(df)).collect()}
    tokens = [t for _, s in texts for t in " ".join(s).split()]
    assert sum(map(sum, counts.values())) == len(tokens)
    assert counts["river"] == (sum(t == "river." for t in tokens), sum(t in ("river", "river?") for t in tokens) - sum(t == "river?" for t in tokens))
    assert counts["river?"] == (0, sum(t == "river?" for t in tokens))


def test_odd_texts_and_empty_tables(spark, learnt):
    _, _, model = learnt
    texts = [None, "", "  \n", "one", "He met Dr. The end.", 'It stopped... then went on. "Really?" she said!', "No. 5 came in 1999. The rest of it, e.g. The best. stayed"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["sentences"] for r in B.split_sentences(df, model, ["id"]).collect()}
    assert [got[i] for i in range(4)] == [[], [], [], ["one"]]
    assert got[4] == ["He met Dr.", "The end."]
    assert got[5] == ["It stopped... then went on.", '"Really?"', "she said!"]
    assert got[6] == ["No.", "5 came in 1999.", "The rest of it, e.g.", "The best.", "stayed"]
    none = B.learn_boundaries(df.where("id < 0"))
    assert [t.count() for t in (none.abbreviations, none.starters, none.collocations)] == [0, 0, 0]
    assert B.split_sentences(df.where("id = 3"), none, ["id"]).first()["sentences"] == ["one"]


def test_a_filter_on_the_sentences_does_not_split_texts_for_each_of_them(spark, learnt):
    """Pushed below the result, it would cut the whole text into tokens anew inside the loop over its sentences."""
    texts, df, model = learnt
    found = B.split_sentences(df, model, ["id"]).where("size(sentences) > 0").selectExpr("id", "size(sentences) AS n")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "split(" in line and "slice(" in line]
    assert {r["id"]: r["n"] for r in found.collect()} == {i: len(s) for i, s in texts}
