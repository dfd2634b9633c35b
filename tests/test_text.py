import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions import text as X


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_strip_tags_keeps_tags_over_lines(texts):
    df = texts(["a<b>c", "a<b\n>c", "x <i>y</i> z", None])
    assert values(df, X.strip_tags("clean_text")) == ["a c", "a<b\n>c", "x  y  z", None]


def test_indicators(texts):
    df = texts(["see cve-2024-1234, CVE-2024-1234 and Cve-2021-44228999; 8.8.8.8 10.0.0.8 256.1.1.1 1.2.3.4"])
    assert values(df, X.extract_cves("clean_text")) == [["CVE-2021-4422899", "CVE-2024-1234"]]
    assert values(df, X.extract_ips("clean_text")) == [["1.2.3.4", "8.8.8.8"]]


def test_private_prefixes(texts):
    df = texts(["10.0.0.8", "172.16.0.1", "172.32.0.1", "010.1.1.1", "8.8.8.8", "169.254.1.1"])
    assert values(df, X.is_private_ip("clean_text")) == [True, True, False, False, False, True]


def test_word_count(texts):
    df = texts(["", None, "  \n", "one", " two  words\t"])
    assert values(df, X.word_count("clean_text")) == [0, 0, 0, 1, 2]


def test_clean_text_cases(texts):
    df = texts([
        None,
        "The CVE-2024-1234 flaw, at 45.33.32.156. It cannot wait...",
        "Costs 1,000 dollars,then more--or less. We gonna go",
        "Don't <b>panic</b>_now (please)",
    ])
    assert values(df, X.clean_text("clean_text")) == [
        "",
        "cve-2024-1234 flaw 45.33.32.156 wait ... cve-2024-1234 45.33.32.156",
        "costs 1,000 dollars less gon",
        "panic please",
    ]


def plain_clean(raw: str) -> str:
    """The same rules in plain Python."""
    t = re.sub(r"<.*?>", " ", raw)
    cves = sorted({c.upper() for c in re.findall(vocab.CVE_PATTERN, t)})
    ips = sorted({i for i in re.findall(vocab.IPV4_PATTERN, t, re.ASCII) if not i.startswith(tuple(vocab.PRIVATE_IP_PREFIXES))})
    t = re.sub(r"[^a-zA-Z0-9., \-]", " ", t)
    t = " ".join(" ".join([t, *cves, *ips]).split()).lower()
    t = re.sub(r",([^0-9]|$)", r" , \1", t)
    t = re.sub(r"(\.\.+|--)", r" \1 ", t)
    t = re.sub(r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))(?:not|me|na|ta)\b", r"\1 ", t)
    t = re.sub(r"([^. ])\.( |$)", r"\1\2", t)
    return " ".join(w for w in t.split(" ") if len(w) > 2 and w not in set(vocab.STOP_WORDS))


@settings(max_examples=5, deadline=None)
@given(st.lists(
    st.lists(st.sampled_from(
        ["hive", "the", "cannot", "wanna", "CVE-2024-12345", "8.8.8.8", "10.1.1.1", "a.b.", "...", ",", "1,5", "x--y",
         "<p>", "</p", "_", "é", "\n", "Play.", "don't", "U.S.", "end.", "-", "uat-5918"]), max_size=30),
    min_size=20, max_size=40))
def test_clean_text_agrees_with_plain_python(spark, parts):
    raws = [" ".join(p) for p in parts]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, t string")
    got = [r[1] for r in df.select("i", X.clean_text("t")).orderBy("i").collect()]
    assert got == [plain_clean(r) for r in raws]


def test_codec(texts):
    df = texts(["a, b,,nan, NaN ,c", "", None])
    assert values(df, X.parse_list("clean_text")) == [["a", "b", "c"], [], []]
    assert values(df, X.join_list(F.array(F.lit("x"), F.lit("y"))))[0] == "x, y"
