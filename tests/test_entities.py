import random
import re

from intelweave import vocab
from intelweave.functions import bitmap
from intelweave.operators import entities as E
import pytest
from pyspark.sql import functions as F


def found(df, column):
    return [r[0] for r in E.extract_entities(df).orderBy("doc_id").select(column).collect()]


def test_whole_words_and_overlaps(texts):
    df = texts(["continuously on display", "the lazarus group met", "plug-and-conti now", "uat-5918 and apt1", "", None])
    assert found(df, "malware_names") == [[], [], ["conti"], [], [], []]
    assert found(df, "threat_actors") == [[], ["lazarus", "lazarus group"], [], ["apt1", "uat-5918"], [], []]


def test_ambiguous_terms_need_context(texts):
    filler = " ".join(["word"] * 10)
    df = texts([
        "the hive ransomware gang", "plug and play", f"hive {filler} ransomware", f"hive {filler[5:]} ransomware",
        "hive, ransomware", "leak site of royal", f"leak site {filler[:39]} royal", f"leak site {filler[:44]} royal",
    ])
    assert found(df, "malware_names") == [["hive"], [], [], ["hive"], [], ["royal"], ["royal"], []]


def brute(text):
    tokens = text.lower().split()

    def whole(term, where):
        return re.search(r"\b" + re.escape(term) + r"\b", where, re.I) is not None

    def backed(term):
        if term not in list(vocab.AMBIGUOUS_CONTEXTS):
            return True
        near = [" ".join(tokens[max(0, i - 10): i + 11]) for i, t in enumerate(tokens) if t == term]
        return any(whole(c, n) for n in near for c in vocab.AMBIGUOUS_CONTEXTS[term])

    return (sorted(t for t in vocab.MALWARE_TERMS if whole(t, text) and backed(t)),
            sorted(t for t in vocab.ACTOR_TERMS if whole(t, text)))


def random_texts(n, seed=7):
    rng = random.Random(seed)
    pool = (vocab.MALWARE_TERMS + vocab.ACTOR_TERMS + list(vocab.AMBIGUOUS_CONTEXTS) * 4 + vocab.AMBIGUOUS_CONTEXTS['play'] * 4
            + ["word", "other", "x-hive", "hive,", "(royal)", "leak", "site", "ransomware."] * 12)
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_agrees_with_brute_force(texts):
    raw = random_texts(300)
    rows = E.extract_entities(texts(raw)).orderBy("doc_id").collect()
    assert [(r["malware_names"], r["threat_actors"]) for r in rows] == [brute(t) for t in raw]


@pytest.mark.parametrize("words", [1 << 16, 1])
def test_gazetteer_table_equals_term_lists(spark, texts, words, monkeypatch):
    monkeypatch.setattr(bitmap, "WORDS", words)  # a full bitmap lets every slice pass
    raw = random_texts(200, seed=11) + ["lapsus$", "lapsus$x", "lapsus$ x", "a$-b", "$-b", "x $-b", "x$-b"]
    terms = [*vocab.ACTOR_TERMS, "$-b"]
    gaz = spark.createDataFrame([("a", t) for t in terms], "kind string, term string")
    found = E.match_gazetteer(texts(raw), "doc_id", gaz)
    by_table = {r["doc_id"]: r["terms"] for r in found.collect()}
    for r in E.extract_entities(texts(raw), actors=terms).collect():
        assert by_table.get(r["doc_id"], []) == r["threat_actors"], raw[r["doc_id"]]


def test_a_gazetteer_of_single_words_looks_up_each_word_of_a_text_once(spark, texts, monkeypatch):
    monkeypatch.setattr(bitmap, "WORDS", 1)  # a full bitmap lets every word pass
    raw = [*random_texts(100, seed=12), "Emotet, emotet; EMOTET", "emotet_x x-ryuk", "", " ", None, "\U0001d4b3\U0001d4b4 \u00e9t\u00e9"]
    words = [("m", t) for t in ("Emotet", "ryuk", "\u00c9T\u00c9", "apt28", "\U0001d4b3\U0001d4b4", "")] + [("n", "emotet")]
    single = E.match_gazetteer(texts(raw), "doc_id", spark.createDataFrame(words, "kind string, term string"))
    assert "regexp_extract_all" not in single._jdf.queryExecution().optimizedPlan().toString()
    several = E.match_gazetteer(texts(raw), "doc_id", spark.createDataFrame([*words, ("z", "no such term")], "kind string, term string"))
    rows = lambda df: sorted((r.doc_id, r.kind, r.terms) for r in df.collect())
    assert rows(single) == rows(several) and (100, "m", ["emotet"]) in rows(single)


def test_combine(spark):
    df = spark.createDataFrame(
        [(["emotet"], ["apt1"], ["Microsoft", "zeus", "12345", "ab"], None)],
        "malware_names array<string>, threat_actors array<string>, mm array<string>, ma array<string>")
    r = E.combine(df, "mm", "ma").first()
    assert (r["malware_names"], r["threat_actors"]) == (["emotet", "zeus"], ["apt1"])
    assert E.combine(df).first()["malware_names"] == ["emotet"]


def test_totals(texts):
    df = E.extract_entities(texts(["CVE-2024-1234 emotet ryuk", "apt28", "nothing"]))
    got = {r["kind"]: (r["total"], r["articles"]) for r in E.entity_totals(df).collect()}
    assert got == {"cve_ids": (1, 1), "ip_addresses": (0, 0), "malware_names": (2, 1), "threat_actors": (1, 1), "any": (4, 2)}


def test_text_work_runs_once(texts):
    """The gate over all four arrays must not be pushed below their computation."""
    from intelweave.operators import graph as G

    df = E.extract_entities(texts(["emotet"])).select(
        F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("i").alias("primary_industry"),
        F.lit(1.0).alias("threat_score"), *E.KINDS)
    plan = G.graph_edges(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}\\p{N}_]+") == 1


def test_terms_in_capitals_and_contexts_per_term(texts):
    df = texts(["the lockbit crew and apt28 near play music", "hive honey", "hive gang", "play on stage"])
    out = E.extract_entities(df, malware=["LockBit", "Play", "Hive"], actors=["APT28"], ambiguous={"Play": ["Music"], "HIVE": ["gang"]})
    got = {r["doc_id"]: (r["malware_names"], r["threat_actors"]) for r in out.collect()}
    assert got == {0: (["lockbit", "play"], ["apt28"]), 1: ([], []), 2: (["hive"], []), 3: ([], [])}


def test_empty_gazetteer(spark, texts):
    assert E.match_gazetteer(texts(["a"]), "doc_id", spark.createDataFrame([], "kind string, term string")).count() == 0


def test_bitmaps_are_sized_from_the_set(spark, monkeypatch):
    for n in (1, 5_000, 1_040_000):
        held = spark.range(n).select(F.xxhash64("id").alias("h"))
        found = bitmap.bitmap_of(held, "h")
        assert 32 * n <= max(found.bits, 1024) <= max(64 * n, 1024)
        assert held.where(~bitmap.may_hold(found, F.col("h"))).isEmpty()
        others = spark.range(1 << 40, (1 << 40) + 100_000).where(bitmap.may_hold(found, F.xxhash64("id")))
        assert others.count() < 1000  # under one in a hundred


def test_a_gazetteer_of_over_a_million_terms(spark, texts):
    # two-word terms whose first word is rare among the texts' words, and texts with one, none and several
    gaz = spark.range(1_040_000).select((F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("kind"),
                                        F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x"), (F.col("id") % 7).cast("string")).alias("term"))
    raw = ["w5 x5 and w5 x4", "W14 X0, w1039999 x" + str(1039999 % 7), "w1040000 x0", "x5 w5", "", None]
    got = {(r.doc_id, r.kind): r.terms for r in E.match_gazetteer(texts(raw), "doc_id", gaz).collect()}
    assert got == {(0, "odd"): ["w5 x5"], (1, "even"): ["w14 x0"], (1, "odd"): ["w1039999 x" + str(1039999 % 7)]}


def test_more_probes_let_fewer_others_pass(spark):
    held = spark.range(40_000).select(F.xxhash64("id").alias("h"))
    found = bitmap.bitmap_of(held, "h", per_item=64, probes=4)
    assert held.where(~bitmap.may_hold(found, F.col("h"))).isEmpty()
    assert spark.range(1 << 40, (1 << 40) + 400_000).where(bitmap.may_hold(found, F.xxhash64("id"))).count() < 40


@pytest.mark.parametrize("tail", ["", " x"])
def test_bits_of_a_large_gazetteer_stay_out_of_the_plan(spark, texts, tail):
    """The driver writes a plan's text for each stage: it must not grow with the terms."""
    gaz = spark.range(100_000).select(F.lit("k").alias("kind"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(tail)).alias("term"))
    found = E.match_gazetteer(texts(["w5 x and w100000 x", "w99999 x, W99999 X", "", None]), "doc_id", gaz)
    assert len(found._jdf.queryExecution().toString()) < 100_000
    assert {(r.doc_id, r.kind): r.terms for r in found.collect()} == {(0, "k"): ["w5" + tail], (1, "k"): ["w99999" + tail]}


def test_a_test_in_a_subquery_is_sized_from_the_set(spark):
    for n in (1, 5_000, 1_040_000):
        held = spark.range(n).select(F.xxhash64("id").alias("h"))
        asked = bitmap.asked_in_subquery(held.union(held), "h")
        assert held.where(~asked(F.col("h"))).isEmpty()
        others = spark.range(1 << 40, (1 << 40) + 100_000).where(asked(F.xxhash64("id")))
        assert others.count() < 1000  # under one in a hundred
    empty = bitmap.asked_in_subquery(spark.range(0).select(F.xxhash64("id").alias("h")), "h")
    assert spark.range(1000).where(empty(F.xxhash64("id"))).isEmpty()


def test_terms_of_all_shapes_at_the_ends_of_a_text(spark, texts):
    raw = ["a b", "a b c", " a b ", "-a b-", "$ a", "a $", "$ a$", "x$ a$ y", "a-b-a b", "b", "$", "", None]
    terms = ["a b", "a", "b c", "$ a", "a $", "$ a$", "-a", "b-", "$", "a b c", "-", "- a"]
    gaz = spark.createDataFrame([("k", t) for t in terms] + [("l", "A B"), ("l", None)], "kind string, term string")
    got = {(r.doc_id, r.kind): r.terms for r in E.match_gazetteer(texts(raw), "doc_id", gaz).collect()}
    want = {}
    for i, text in enumerate(raw):
        whole = sorted(t for t in terms if text and re.search(r"\b" + re.escape(t) + r"\b", text))
        want |= ({(i, "k"): whole} if whole else {}) | ({(i, "l"): ["a b"]} if "a b" in whole else {})
    assert got == want
