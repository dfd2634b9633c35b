import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from intelweave import vocab
from intelweave.operators import tagger as N

TAGS = vocab.BIO_TAGS
SCHEMA = "doc_id long, sent int, words array<string>, tags array<string>, key string, slot int"


def brute(scores, follow):
    n, k = scores.shape
    best = None
    for path in itertools.product(range(k), repeat=n):
        value = follow[-1, path[0]] + scores[0, path[0]] + sum(follow[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:])))
        if best is None or value > best[0] + 1e-9:
            best = (value, path)
    return best


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 5, 6)
        scores = rng.standard_normal((lengths.sum(), len(TAGS))).astype(np.float32)
        follow = rng.standard_normal((len(TAGS) + 1, len(TAGS))).astype(np.float32) + N.allowed(TAGS)
        got, at = N.viterbi(scores, lengths, follow), 0
        for n in lengths:
            if n:
                assert tuple(got[at:at + n]) == brute(scores[at:at + n], follow)[1]
            at += n


def test_shapes_and_what_may_follow():
    assert [N.shape_of(w) for w in ("APT29", "Cl0p", "a-B", "", "x86_64")] == ["A0", "Aa0a", "a-A", "", "a0_0"]
    can = {(s, t) for i, s in enumerate([*TAGS, "start"]) for j, t in enumerate(TAGS) if N.allowed(TAGS)[i, j] == 0}
    assert ("start", "I-ACTOR") not in can and ("O", "I-MALWARE") not in can and ("B-ACTOR", "I-MALWARE") not in can
    assert ("B-ACTOR", "I-ACTOR") in can and ("I-ACTOR", "I-ACTOR") in can and len(can) == 6 * 3 + 4


def corpus(n, seed):
    """Names that no other word resembles, and names told by the word in front of them alone."""
    rng = random.Random(seed)
    plain = ["the", "group", "used", "and", "files", "were", "found", "in", "many", "networks", "by", "again"]
    rows = []
    for i in range(n):
        words, tags = [], []
        for _ in range(rng.randint(3, 9)):
            u = rng.random()
            if u < 0.15:
                words += ["malware", "Qx" + "".join(rng.choice("abcdefgh") for _ in range(4))]
                tags += ["O", "B-MALWARE"]
            elif u < 0.25:
                words += ["actor", rng.choice(["Red", "Blue", "Grey"]), rng.choice(["Bear", "Lynx"])]
                tags += ["O", "B-ACTOR", "I-ACTOR"]
            else:
                words.append(rng.choice(plain))
                tags.append("O")
        rows.append((i // 3, i % 3, words, tags, "k", 1))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return N.train_tagger(spark.createDataFrame(corpus(900, 1), SCHEMA), ["doc_id"], shards=4)


def test_held_out_names_are_found(model):
    held = corpus(300, 2)
    pairs = [(t, p) for row, tags in zip(held, model.decode([r[2] for r in held])) for t, p in zip(row[3], tags)]
    right = sum(t == p for t, p in pairs) / len(pairs)
    assert right > 0.99 > sum(t == "O" for t, _ in pairs) / len(pairs)
    named = [(t, p) for t, p in pairs if t != "O"]
    assert sum(t == p for t, p in named) / len(named) > 0.97


def test_partitions_change_nothing_and_models_are_kept(spark, model, tmp_path):
    again = N.train_tagger(spark.createDataFrame(corpus(900, 1), SCHEMA).repartition(7), ["doc_id"], shards=4)
    assert np.abs(again.weights - model.weights).max() < 1e-5
    N.save_tagger(spark, model, str(tmp_path / "tagger"))
    kept = N.load_tagger(spark, str(tmp_path / "tagger"))
    assert kept.tags == model.tags and (kept.weights == model.weights).all()


def test_odd_sentences(spark, model):
    rows = [(1, 0, [], [], "k", 1), (2, 0, ["x"], ["O"], "k", 1), (2, 0, ["x"], ["O"], "k", 1), (3, 0, ["malware", "Qxabab", "é\u3042", ""], ["?"] * 4, "k", 1), (4, 0, ["the"] * 5000, ["O"] * 5000, "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, len(r.words)): r.tags for r in N.tag_sentences(df, model, ["doc_id"]).collect()}
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 0, (2, 1): 1, (3, 4): 4, (4, 5000): 5000}
    assert got[3, 4][1] == "B-MALWARE"
    assert N.train_tagger(df, ["doc_id"], epochs=1).decode([["a", "b"]]) == [["O", "O"]]
    assert N.train_tagger(df.limit(0), ["doc_id"]).decode([["a"], []]) == [["O"], []]


def test_names_of_articles(spark, model):
    text = "\n".join(["many files were found by malware Qxcafe again and the group used networks"] * 2 + ["the networks were used by actor Grey Lynx in many files again"])
    rows = [("u", text), ("u", text), ("v", "nothing of note was found in the many files of the networks"), (None, text), ("w", None)]
    got = N.model_names(spark.createDataFrame(rows, "url string, clean_text string"), model).collect()
    assert sorted((str(r.url), r.model_malware or [], r.model_actors or []) for r in got) == [
        ("None", [], []), ("u", ["qxcafe"], ["grey lynx"]), ("u", ["qxcafe"], ["grey lynx"]), ("v", [], []), ("w", [], [])]


def test_words_looked_up_once_score_as_tokens_do():
    """Bit by bit the sums of the features, sentences without words and slices of a longer column included."""
    rng, draw = np.random.default_rng(3), random.Random(3)
    weights = rng.standard_normal((N.SLOTS + len(TAGS) + 1, len(TAGS))).astype(np.float32)
    sentences = [[draw.choice(["the", "group", "APT29", "", "\u00e9\u3042", "x-y"]) for _ in range(draw.choice([0, 1, 2, 7]))] for _ in range(200)]
    words = sorted({w for s in sentences for w in s})
    number = np.array([words.index(w) for s in sentences for w in s])
    scores = N.token_scores(weights, words, number, np.array([len(s) for s in sentences]))
    assert (scores == weights[N.feature_slots(sentences)].sum(1)).all()
    model = N.Tagger(TAGS, weights)
    column = pa.array(sentences, pa.list_(pa.string()))
    assert model.decode_arrow(column.slice(50, 70)).to_pylist() == [model.decode([s])[0] for s in sentences[50:120]]
    assert model.decode_arrow(column.slice(0, 0)).to_pylist() == []
