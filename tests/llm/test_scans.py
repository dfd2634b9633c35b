"""Licenses, urls, quality, secrets and repetition against brute force, and their odd rows."""
import base64
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pytest

from intelweave.llm import licenses, quality_gam, repetition, secret_scan, url_filter

from .conftest import prose

# == licenses


def brute_match(templates, words, threshold):
    found = {}
    for t, (_, ws) in enumerate(templates):
        stretches = [words[i:i + 2 * len(ws)] for i in range(len(words))]
        share = max((len(set(ws) & set(x)) / len(set(ws)) for x in stretches), default=0)
        if share >= (1 if len(set(ws)) < licenses.SHORT else threshold - 1e-9):
            found[t] = share
    return found


def test_filters_lose_no_template():
    rng = random.Random(1)
    vocabulary = [bytes([97 + i]) for i in range(20)]
    templates = [("l", rng.sample(vocabulary, rng.randint(1, 18))) for _ in range(16)]
    counts = {w: rng.randint(0, 50) for w in vocabulary[:14]}
    met = set()
    for threshold in (0.5, 0.8, 1.0):
        index = licenses.Index(templates, counts, threshold)
        for _ in range(300):
            words = [rng.choice(vocabulary + [b"zz"] * rng.choice([1, 20])) for _ in range(rng.randint(0, 120))]
            want = brute_match(templates, words, threshold)
            assert index.match(words) == pytest.approx(want)
            assert not want or not index.rare.isdisjoint(words)
            met |= want.keys()
    assert any(len(templates[t][1]) >= licenses.SHORT for t in met)


def test_common_words_are_no_license(docs_of):
    filler = " ".join(f"w{i}" for i in range(40))
    spread = filler.join(" you may not use this file except in compliance with the License You obtain a copy of at ".split(" "))
    none = ["The album was released under the license of a small label.", spread, " ".join(w for _, t in licenses.TEMPLATES for w in t.split()[:3])]
    edited = [" ".join("X" if i == 7 else w for i, w in enumerate(t.split())) for _, t in licenses.TEMPLATES if len(set(t.lower().split())) > licenses.SHORT + 2]
    wrapped = ["before " * 200 + "\n" + t.replace(" ", "\n", 5) + "\n" + "behind " * 200 for _, t in licenses.TEMPLATES]
    rows = licenses.scan_licenses(docs_of(none + edited + wrapped)).collect()
    labels = [r.labels for r in rows]
    assert labels[:len(none)] == [""] * len(none)
    assert labels[len(none):-len(wrapped)] == [label for label, t in licenses.TEMPLATES if len(set(t.lower().split())) > licenses.SHORT + 2]
    assert all(label in got.split(",") for (label, _), got in zip(licenses.TEMPLATES, labels[-len(wrapped):]))


def test_license_scan(docs_of, odd_texts):
    texts = ["Under the MIT License, mit-license\n", "no mit, License", "GNU General Public\nLICENSE v3", "Apache\x00License MIT license", "licensed under apache license version 2",
             "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation", "ＭＩＴ license émit license"]
    docs = docs_of(texts + odd_texts)
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    for r, text in zip(rows, [d.text or "" for d in docs.collect()]):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert rows[5].labels == "mit" and rows[5].base_labels == ""
    assert licenses.scan_licenses(docs_of([])).count() == 0


# == urls


def test_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/1?x=/de/", "https://example.net/EN/", "x://net", "https://net/", "https://a.net?x", "http://b.example.com/de/#y", "http://org/fr/", "http://xorg/fr/",
            None, "nothing", "://q.org/fr/a://b", "http://ÄB.net/é"]
    pages = spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, blocked string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = {r.page_id: r for r in url_filter.judge_urls(pages, none).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0]) if rest is not None else ""
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]):])[0] if rest is not None else ""
        fits = [(len(r), a, r) for a, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fits)[1:] if fits else ("allow", None)
        assert (rows[i].host, rows[i].path, rows[i].verdict, rows[i].rule) == (host, path, *want), url
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks_few_labels_and_blocks_many(spark):
    rows = [("one.bad.example", 1)] + [("many.worse.example", 1)] * 60 + [("good.fine.example", 0)] * 200 + [("half.fine.example", i % 2) for i in range(40)] + [(None, 1), ("x.y", None)]
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["many.worse.example"].low > 0.5 > got["one.bad.example"].low
    assert 0 < got["good.fine.example"].rate < 0.1 and set(got) == {"one.bad.example", "many.worse.example", "good.fine.example", "half.fine.example"}
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(rows) if h], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (h, b) in enumerate(rows) if h], "page_id long, bad int")
    blocked = url_filter.judge_urls(pages, outcomes).filter("verdict = 'block'").select("host").distinct().collect()
    assert [r.host for r in blocked] == ["many.worse.example"]


# == quality


def test_classifier_learns_on_other_rows_only(spark, docs_of):
    good = [(i, prose(60 + i % 50, i)) for i in range(200)]
    bad = [(1000 + i, re.sub(" ", "### ", prose(60 + i % 50, i))) for i in range(100)]
    docs = docs_of(good + bad + [(2000, None), (2001, ""), (None, "x"), (1000, "again")])
    rows = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (5, None), (3, 7), (99999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality_gam.train(docs, labels, rounds=20, pair_rounds=5)
    got = quality_gam.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(rows)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id != 1000]
    assert len(held) > 30 and sum(p == y for p, y in held) / len(held) > 0.95
    known = quality_gam.labelled_features(docs, labels, 10**6, "doc_id", "text", "quality")
    assert not any(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in known.select("id").collect())
    assert quality_gam.labelled_features(docs, labels, 7, "doc_id", "text", "quality").count() <= 7


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y, rounds=10, pair_rounds=60)
    b = model.bins(x)
    raw = [model.intercept + sum(t[b[i, j]] for j, t in enumerate(model.tables)) + sum(t[b[i, j], b[i, k]] for j, k, t in model.pairs) for i in range(len(x))]
    assert np.allclose(model.raw(b), raw)
    assert (0, 1) in [(j, k) for j, k, _ in model.pairs] and ((model.score(x) > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_and_no_labels(spark, docs_of, label):
    docs = docs_of(["a", "b", "c", "d", "e"])
    labels = spark.createDataFrame([(i, label) for i in range(5)], "doc_id long, quality int")
    got = quality_gam.score_quality(docs, quality_gam.train(docs, labels)).collect()
    assert len({r.score for r in got}) == 1 and (got[0].score > 0.5) == bool(label)
    assert quality_gam.score_quality(docs, quality_gam.train(docs, labels.limit(0))).first().score == 0.5
    assert quality_gam.score_quality(docs.limit(0), quality_gam.train(docs, labels)).count() == 0


# == secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes([65 + i]) * 40) for i in range(8)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
OPENSSH = b"openssh-key-v1\0" + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1) + b"".join(struct.pack(">I", len(x)) + x for x in (b"k" * 50, b"p" * 90))


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


JWT = ".".join([b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode(), True), b64(json.dumps({"sub": "1"}).encode(), True), "c2lnbmF0dXJl"])


def test_only_structure_is_confirmed():
    for data, kind in ((RSA, "der"), (PKCS8, "der"), (OPENSSH, "openssh")):
        for text in (b64(data), data.hex(), b64(data, True)):
            assert secret_scan.confirmed_spans(f"x {text} y") == [(kind, 2, 2 + len(text))]
        broken = bytearray(data)
        broken[3] ^= 0x55
        assert secret_scan.confirmed_spans(b64(bytes(broken))) == []
        assert secret_scan.confirmed_spans(b64(data[:-1])) == []
    assert secret_scan.confirmed_spans(f"é {JWT}") == [("jwt", 2, 2 + len(JWT))]
    assert secret_scan.confirmed_spans(JWT.replace("eyJ", "eyK", 1)) == []
    pem = "-----BEGIN PRIVATE KEY-----\n" + b64(PKCS8) + "\n-----END PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(pem) == [("pem", 0, len(pem))]
    assert secret_scan.confirmed_spans(b64(random.Random(1).randbytes(300))) == []


def test_keys_behind_other_digits_and_over_lines():
    """A path or a single hex digit in front, text behind, wrapped lines, spelled-out line ends, encrypted blocks."""
    spans = secret_scan.confirmed_spans
    for data, kind in ((RSA, "der"), (PKCS8, "der"), (OPENSSH, "openssh")):
        for text in (b64(data), data.hex()):
            for lead in ("path/", "a", "abc", "x/yz/"):
                lead = lead if text != data.hex() else "a" * len(lead)
                assert spans(f"{lead}{text} y") == [(kind, len(lead), len(lead) + len(text))]
        lines = re.findall(".{1,64}", b64(data))
        for end in ("\n", "\r\n", "\n    ", "\\n"):
            text = end.join(lines)
            assert spans(f"key:\n{text}\nafter") == [(kind, 5, 5 + len(text))]
        pem = "\\n".join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
        assert spans(f"{{{pem}}}") == [("pem", 1, 1 + len(pem))]
    two = b64(RSA) + "\n\n" + b64(PKCS8)
    assert [k for k, *_ in spans(two)] == ["der", "der"]

    def encrypted(size, fields="Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16):
        body = "\n".join(re.findall(".{1,64}", b64(random.Random(3).randbytes(size))))
        return f"-----BEGIN RSA PRIVATE KEY-----\n{fields}\n\n{body}\n-----END RSA PRIVATE KEY-----"

    assert spans(encrypted(608)) == [("pem", 0, len(encrypted(608)))]
    assert spans(encrypted(607)) == [] and spans(encrypted(608, "Comment: none")) == []
    assert spans(der(0x30, *[der(2, b"\1")] * 9, der(4, b"x" * 40)).hex()) == []  # integers of a byte are no modulus


def test_long_runs_cost_linear_time():
    import time

    rng = random.Random(4)
    for make in (lambda n: b64(rng.randbytes(n)), lambda n: rng.randbytes(n).hex(), lambda n: b64(b"openssh-key-v1\0" * (n // 15)),
                 lambda n: "-----BEGIN PRIVATE KEY-----" * (n // 27), lambda n: b64(b"0\x82\xff\xff\x02\x01\0" * (n // 7))):
        start = time.monotonic()
        assert secret_scan.confirmed_spans(make(1_000_000)) == []
        assert time.monotonic() - start < 20


def test_secret_scan(docs_of, odd_texts):
    texts = ["Secret: token = abcdefgh", "PASSWORD='12345' api-key=zzzzzz apikey:=abc.def/1", "ſecret=abcdefgh toKen=abcdefghſ", "AKIA" + "B" * 16 + " AKIA" + "C" * 15 + " xAKIAKIA" + "D" * 14,
             "é " + "deadbeef" * 3 + " " + "a" * 23 + " token=" + "0f" * 20, JWT] + odd_texts
    docs = docs_of(texts)
    rows = secret_scan.scan_secrets(docs).collect()
    base = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
            "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)}
    assert len(rows) == len(texts)
    for r, text in zip(rows, [d.text or "" for d in docs.collect()]):
        want = sorted(((m.start(), k, kind, m.end()) for k, (kind, (p, f, keep)) in enumerate(base.items()) for m in re.finditer(p, text, f) if keep(m)))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[2] == k for w in want) for k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
        assert {(k, a, b) for a, _, k, b in want} <= {tuple(s) for s in r.spans}
    assert secret_scan.scan_secrets(docs_of([])).count() == 0


def test_masks_leave_no_secret(docs_of):
    from pyspark.sql import functions as F

    text = f"a token = abcdefgh1234 b {'0f' * 16} c"
    got = [r[0] for r in docs_of([text, None, "clean"]).select(secret_scan.mask_column(F.col("text"))).collect()]
    assert got == ["a [SECRET] b [SECRET] c", None, "clean"]
    assert secret_scan.mask_text("token=" + "0f" * 16) == "[SECRET]"


# == repetition


def test_longest_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(0, 25) for _ in range(4)]
        words = [rng.randint(0, rng.choice([0, 1, 3, 9])) for _ in range(sum(sizes))]
        want, at = [], 0
        for size in sizes:
            x = words[at:at + size]
            at += size
            for i in range(size):
                best = 0
                for j in range(size):
                    k = 0
                    while j != i and max(i, j) + k < size and x[i + k] == x[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert repetition.longest_repeats(np.array(words, np.int64), np.array(sizes)).tolist() == want


def test_repetition_rules(docs_of, odd_texts, monkeypatch):
    block = prose(80, 9)
    texts = ["a b\n\na b\n \na b", "# $ | < x\x0b%", block, block + "\n" + prose(400, 8) + "\n" + block, "a\x85b c\x1cd"] + odd_texts
    docs = docs_of(texts)
    monkeypatch.setattr(repetition, "CHUNK_WORDS", 100)
    rows = repetition.judge_repetition(docs).collect()
    assert len(rows) == len(texts)
    for r, text in zip(rows, [d.text or "" for d in docs.collect()]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(words) < 1500 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if inside is not None:
            assert r.n_repeat_words == len(inside)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert rows[2].kept and not rows[3].kept and rows[3].longest_repeat >= 80
    assert repetition.judge_repetition(docs_of([])).count() == 0


def test_the_methods_own_limits(docs_of):
    """Texts that the base rules keep: a long repeat in a long text, one in a short text, and neither."""
    far = [prose(5000, 21), prose(5000, 22)]
    texts = ["\n".join([far[0], prose(n, 23), far[1], prose(n, 23)]) for n in (150, 250)]
    texts.append("\n".join([prose(60, 24), prose(520, 25), prose(60, 24)]))
    for r, kept in zip(repetition.judge_repetition(docs_of(texts)).collect(), (True, False, False)):
        assert not r.base_failed and r.kept == kept and r.covered <= 0.2, r


def test_very_long_texts_of_few_words(docs_of):
    rows = repetition.judge_repetition(docs_of(["a b " * 200_000, " ".join(map(str, range(300_000)))])).collect()
    assert [(r.n_words, r.longest_repeat, r.kept) for r in rows] == [(400_000, 399_998, False), (300_000, 0, True)]
