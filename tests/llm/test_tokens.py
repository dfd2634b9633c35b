import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from intelweave.llm import packing, token_store
from intelweave.llm.tokens import Encoder

ODD = ["", " ", ", a", "a\x00b, c", "  a  b", "a\n\nb c", "it's don't 'tis", "x., y", "x_, y", "a,\nb", "a. \nb", "3. 4, b.", "é, ê. q.\nw", "tab\there \n there ",
       "İstanbul ΣΑΣ ﬁ é", "<|endoftext|> hi", "a\x1cb c", "12 3a4 _foo_ a_b", "日本語 テスト。 ok", " lead", "end ", "end  ", "a \n b", "ab's'll cd,'s", "Ⅷ ª º ʰ", " \n x"]
KINDS = [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")]


@pytest.mark.parametrize("name,kind", KINDS)
def test_ids_equal_the_tokenizers_also_when_the_cache_starts_anew(name, kind, monkeypatch, odd_texts):
    tok = Tokenizer.from_file(P.path(name))
    monkeypatch.setattr("intelweave.llm.tokens._WORDS", 20)
    enc = Encoder(P.path(name), kind)
    texts = ODD + [x[1] if isinstance(x, tuple) else x for x in odd_texts]
    texts = [t for t in texts if t is not None]
    for part in (texts, texts[::-1]):
        ids, counts, ends = enc.encode(part, 9)
        want = [tok.encode(t, add_special_tokens=False).ids + [9] for t in part]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
        assert (np.diff(ends) > 0).all() and (not len(ends) or ends[-1] <= len(ids))


def brute_best(places, penalty, size, fixed):
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + packing.padding(places[j] - places[i], size) for i in range(j) if places[j] - places[i] <= size) + fixed + penalty[j]
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = rng.integers(1, 60, rng.integers(1, 12))
        total = int(counts.sum())
        sentences = np.unique(rng.integers(1, total + 1, 5))
        places, penalty = packing.cut_places(counts, sentences, 32, 8, 3, 9)
        cuts, cost = packing.best_cuts(places.tolist(), penalty.tolist(), 32, 4)
        assert cost == brute_best(places.tolist(), penalty.tolist(), 32, 4)
        at = dict(zip(places.tolist(), penalty.tolist()))
        assert cost == sum(packing.padding(b - a, 32) + 4 + at[b] for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_each_id_lies_in_one_piece(docs_of, odd_texts, block):
    docs = docs_of(odd_texts)
    rows = packing.pack(docs, P.path("word_bpe_49k.json"), size=64, block=block).orderBy("sequence_id", "offset").collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((str(r.doc_id), tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    whole, open_ = [], None
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        if r.start == 0:
            open_ = []
            whole.append((str(r.doc_id), open_))
        assert r.start == len(open_)
        open_ += ids
    assert sorted(whole) == want
    assert all(len(w) == n for (_, w), n in zip(whole, [r.doc_tokens for r in rows if r.start == 0]))
    by = {}
    for r in rows:
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(by[r.sequence_id] == r.sequence_length <= 64 and r.padding == packing.padding(r.sequence_length, 64) for r in rows)
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)


def test_no_documents(docs_of):
    assert packing.pack(docs_of([]), P.path("word_bpe_49k.json")).count() == 0


def test_store_round_trip(spark, docs_of, odd_texts, tmp_path):
    folder = f"file://{tmp_path}/store"
    docs = docs_of(odd_texts)
    manifest = token_store.write_store(docs, folder, P.path("byte_bpe_50k.json"), frame_ids=100)
    assert manifest.agg(F.sum("documents")).first()[0] == len(odd_texts)
    rows = token_store.read_store(spark, folder).orderBy("start").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    some = token_store.read_store(spark, folder, only=[90]).collect()
    assert [r.doc_id for r in some] == [90] and zlib.crc32(some[0].ids) == zlib.crc32(next(r.ids for r in rows if r.doc_id == 90))


def test_reader_decompresses_only_what_it_needs_and_checks_it(spark, docs_of, odd_texts, tmp_path):
    folder = f"{tmp_path}/store"
    token_store.write_store(docs_of(odd_texts).coalesce(1), folder, P.path("byte_bpe_50k.json"), frame_ids=50)
    path = max(tmp_path.glob("store/part-*.zst"), key=lambda p: p.stat().st_size)
    file = token_store.TokenFile(str(path))
    assert len(file.entries) > 20
    before = file.frames_read
    row = int(np.argmin(np.diff(file.ends, prepend=0)))
    next(file.documents([row]))
    assert file.frames_read - before <= 2
    raw = bytearray(path.read_bytes())
    raw[int(file.at[0]) + 12] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception):
        list(token_store.TokenFile(str(path)).documents())


def test_empty_store(spark, docs_of, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_store.write_store(docs_of([]), folder, P.path("byte_bpe_50k.json")).count() == 0
    assert token_store.read_store(spark, folder).count() == 0


def test_files_are_read_back_in_parallel(spark, docs_of, tmp_path):
    docs = docs_of([f"document {i} of many words " * (i % 7) for i in range(60)])
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files of a small table
        token_store.write_store(docs, str(tmp_path), P.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/_manifest").count()
    rows = token_store.read_store(spark, str(tmp_path)).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert files > 2 and len({r.task for r in rows}) == files and len(rows) == 60


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "date", "string", "double"])
def test_ids_of_other_types(spark, docs_of, tmp_path, kind):
    docs = docs_of(["a", "b c", None]).withColumn("doc_id", F.expr(f"cast({'date_add(date\'2024-01-01\', cast(doc_id AS int))' if kind == 'date' else 'doc_id'} AS {kind})"))
    token_store.write_store(docs, str(tmp_path), P.path("byte_bpe_50k.json"))
    rows = token_store.read_store(spark, str(tmp_path))
    assert rows.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(str, (r.doc_id for r in rows.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
