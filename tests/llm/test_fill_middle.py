import hashlib
import re

import numpy as np

from intelweave.llm import fill_middle
from intelweave.llm.fill_middle import MIDDLE, PREFIX, SUFFIX

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm_rate=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, len(units), "spm", len(p), len(m), SUFFIX + s + PREFIX + p + MIDDLE + m
    return doc_id, len(units), "psm", len(p), len(m), PREFIX + p + SUFFIX + s + MIDDLE + m


def test_marks_of_every_byte():
    data = np.frombuffer(bytes(range(256)), np.uint8)
    words = fill_middle.as_words(data)
    space = (fill_middle.space_marks(words).view(np.uint8) > 0)[:256]
    assert np.flatnonzero(space).tolist() == [9, 10, 11, 12, 13, 32]
    first = (fill_middle.first_marks(words).view(np.uint8) > 0)[:256]
    assert first.tolist() == [b >> 6 != 2 for b in range(256)]


def test_rank_and_select_at_every_place():
    rng = np.random.default_rng(1)
    marks = np.where(rng.random(400) < 0.3, 0x80, 0).astype(np.uint8)
    marks[64:160] = 0
    found = fill_middle.Marks(fill_middle.as_words(marks))
    places = np.flatnonzero(marks)
    assert found.rank(np.arange(400)).tolist() == [int((places < i).sum()) for i in range(400)]
    assert found.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()


def odd(odd_texts):
    rng = np.random.default_rng(2)
    more = ["".join(rng.choice(list("ab é\t\n\u3000日\x1f\x0b😀"), rng.integers(0, 40))) for _ in range(300)]
    return odd_texts + more + [" ", "  x", "x  ", " \n", "a <P> b", "<S>", "x<M", "<", "a<", "<P", "\u0085 x\u00a0y", "z" * 100_000, " " * 9999]


def test_rows_equal_brute_force(docs_of, odd_texts):
    docs = docs_of(odd(odd_texts))
    for rate, spm_rate in ((50, 80), (100, 50), (0, 50)):
        made = fill_middle.transform_texts(docs, rate, spm_rate)
        assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        got = sorted(map(repr, map(tuple, made.collect())))
        assert got == sorted(repr(brute(r.doc_id, r.text, rate, spm_rate)) for r in docs.collect())


def test_outputs_give_the_texts_back(docs_of, odd_texts):
    docs = docs_of(odd(odd_texts) + ["<x <y <", "a< b< S> <"])
    made = fill_middle.transform_texts(docs, 100, 50)
    back = made.select("doc_id", fill_middle.restored(made.output, made.form).alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


def test_slices_and_partitions_change_nothing(docs_of, odd_texts, monkeypatch):
    docs = docs_of(odd(odd_texts))
    want = sorted(map(str, fill_middle.transform_texts(docs).collect()))
    monkeypatch.setattr(fill_middle, "_SLICE", 50)
    assert sorted(map(str, fill_middle.transform_texts(docs.repartition(7)).collect())) == want


def test_an_empty_table_gives_no_rows(docs_of):
    assert fill_middle.transform_texts(docs_of(["x"]).limit(0)).count() == 0
