"""Near-duplicates, passages, contamination and the pipeline against brute force."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from intelweave.functions import bitmap
from intelweave.llm import decontam, passages, simhash_dedup
from intelweave.llm.common import components
from intelweave.llm.licenses import words_of

from .conftest import prose


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots_of(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_reads_few_links_in_few_tasks(spark):
    """Each round's links are read by their size: a round costs its shuffles' tasks, and no more for every part they were written in."""
    parts, links = 24, [(i, i + 1) for i in range(0, 16)]
    own, tracker = spark.newSession(), spark.sparkContext.statusTracker()
    for key, value in {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64k"}.items():
        own.conf.set(key, value)
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert {r.root for r in components(own.createDataFrame(links, "a long, b long")).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("few links") for s in tracker.getJobInfo(j).stageIds}
    done = [i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i]
    assert not [n for n in done if n >= 2 * parts]


# == SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_duplicates(docs_of, odd_texts, bucket):
    base = prose(400, 11)
    copies = [re.sub(r"\S+", "zz", base, count=1), base + " end", base.replace("ba", "BA"), base[5:], base + " a b", base]
    docs = docs_of(odd_texts + copies + [prose(200, 12 + i) for i in range(5)])
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_dedup.near_duplicates(docs, bucket=bucket).collect()]
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert sorted((str(i), f) for i, f, _ in got) == sorted((str(i), f) for i, f in rows)
    fps = sorted({f for _, f in rows})
    root = roots_of(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert all(c == least.get(root[f]) for _, f, c in got)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_every_link_is_found_in_a_dense_ball(spark, bucket):
    rng = random.Random(bucket)
    centers = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centers for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [simhash_dedup._signed(f) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash_dedup.close_pairs(frame, bucket)
    hot = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    links = found.filter("b IS NOT NULL").unionByName(simhash_dedup.star_links(hot))
    got = {r.node: r.root for r in components(links).collect()}
    want = roots_of(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert {n: got.get(n, n) for n in signed} == want
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in links.collect())


# == Contamination


def brute_windows(text, item, threshold):
    w, v = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (text, item))
    k = min(5, len(v))
    a, b = ([tuple(x[i:i + k]) for i in range(len(x) - k + 1)] if k else [] for x in (w, v))
    best = 0.0
    for i in range(max(len(a) - len(b) + 1, 1)):
        win, it = collections.Counter(a[i:i + len(b)]), collections.Counter(b)
        both = sum((win & it).values())
        if both:
            best = max(best, both / (sum(win.values()) + len(b) - both))
    return best if best >= threshold else 0.0


@pytest.mark.parametrize("bits", [None, 1])
def test_contamination(spark, docs_of, odd_texts, bits, monkeypatch):
    if bits:
        monkeypatch.setattr(bitmap, "WORDS", bits)  # a full bitmap lets all rows pass
    item = prose(40, 50)
    words = item.split()
    edited = " ".join(words[:3] + ["zzz"] + words[4:])
    items = [(1, item), (2, prose(25, 51)), (3, "alpha beta"), (4, None), (5, ""), (6, "x x x x x x x x x x"), (1, item), (None, prose(30, 52)), (7, "...")]
    benchmark = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, key string")
    texts = odd_texts + [prose(100, 60) + " " + item.upper() + "! " + prose(50, 61), edited, " ".join(words[:30]), " ".join(words[4:]), prose(9, 1) + " alpha, BETA", items[7][1] + item, "x x x x x x x x x x x x"]
    docs = docs_of(texts)
    got = {(r.doc_id, r.item_id): r for r in decontam.find_contamination(docs, benchmark).collect()}
    want = {(d.doc_id, i): s for d in docs.collect() for i, t in items if (s := brute_windows(d.text, t, 0.8))}
    assert got.keys() == want.keys() and len(want) >= 6
    assert all(got[k].similarity == pytest.approx(s) for k, s in want.items())
    assert decontam.find_contamination(docs.limit(0), benchmark).count() == 0
    assert decontam.find_contamination(docs, benchmark.limit(0)).count() == 0


def test_contamination_runs_no_python(spark, docs_of):
    benchmark = spark.createDataFrame([(1, prose(30, 1))], "item_id long, text string")
    plan = decontam.find_contamination(docs_of(["a"]), benchmark)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_packed_fingerprint_counts(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300, 2000):
        h = rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64)
        got = spark.createDataFrame([(h.tolist(),)], "h array<long>").select(decontam.simhash_of(F.col("h"))).first()[0]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        assert got == int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def test_long_windows_and_items(spark, docs_of):
    h = np.random.default_rng(7).integers(-2**63, 2**63 - 1, 40_000, dtype=np.int64)
    h[:15_000] = h[0]
    got = spark.createDataFrame([(h.tolist(),)], "h array<long>").select(decontam.simhash_of(F.col("h"))).first()[0]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    assert got == int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])
    long, item = " ".join(f"w{i}" for i in range(33_000)), prose(40, 50)
    benchmark = spark.createDataFrame([(1, long), (2, item)], "item_id long, text string")
    found = decontam.find_contamination(docs_of([long + " end", prose(50, 51) + " " + item, "w1 w2 w3 w4 w5"]), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in found} == {(0, 1, 1.0), (1, 2, 1.0)}


# == Passages


@pytest.mark.parametrize("group", [64, 2])
def test_repeated_passages(docs_of, odd_texts, group):
    shared, line = prose(70, 70), "the same short line stands everywhere here."
    edited = shared.split()
    edited[10] = "zzzz"
    texts = odd_texts + [f"{prose(60, 80 + i)} {shared if i % 2 else ''} {line} {prose(60, 90 + i)}" for i in range(8)] + [prose(30, 71) + " " + " ".join(edited)] + [shared, prose(49, 72), prose(49, 72)]
    docs = docs_of(texts)
    rows = passages.repeated_passages(docs, group=group).collect()
    words = [(d.doc_id, words_of(d.text or "")) for d in docs.collect()]
    where = collections.defaultdict(set)
    for n, (_, w) in enumerate(words):
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].add(n)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    for n, (i, w) in enumerate(words):
        again = {k for j in range(len(w) - 49) if len(where[tuple(w[j:j + 50])]) > 1 for k in range(j, j + 50)}
        assert again <= got[i]
    alone = {i for i, _ in words} - {r.doc_id for r in rows}
    assert {len(odd_texts) + i for i in (0, 2, 4, 6)} <= alone and {0, 1, 2, 3, 4, 94} <= alone and {len(texts) - 1, len(texts) - 2} <= alone
    assert len(odd_texts) + 8 in got  # one word of the passage differs
    classes = {r.class_id for r in rows if r.doc_id in {len(odd_texts) + i for i in (1, 3, 5, 7)}}
    assert len(classes) == 1
    assert passages.repeated_passages(docs.limit(0)).count() == 0


class _OneTask:
    """A frame of one partition whose rows are sorted already: what is done to its batches is what a task does."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, run, _):
        return run


def test_shared_windows_over_any_cut_of_the_batches():
    run = passages.shared_windows(_OneTask(), limit=4)
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        sig = np.sort(rng.integers(0, 8, n))
        t = rng.integers(0, 3, n) * rng.integers(0, 2, 8)[sig]  # in any order within a signature
        table = pa.table({"sig": sig, "t": t, "c": np.arange(n), "near": np.zeros(n, np.int32)})
        found = [c for b in run(iter(table.to_batches(max_chunksize=int(rng.integers(1, 20))))) for c in b.column(2).to_pylist()]
        assert sorted(found) == [i for i in range(n) if len(set(t[sig == sig[i]])) > 1]


def test_shingles_of_many_texts_are_those_of_their_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab C9é. \n") for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(200)]
    h, sizes = passages.shingles_of(texts)
    number, at = {}, 0
    for text, size in zip(texts, sizes.tolist()):
        words = words_of(text)
        assert size == max(len(words) - passages.SHINGLE + 1, 0)
        for k in range(size):
            assert number.setdefault(tuple(words[k:k + passages.SHINGLE]), h[at + k]) == h[at + k]
        at += size
    assert at == len(h) and len(set(number.values())) == len(number)


def test_compact_windows_hold_each_long_subsequence_once():
    rng = np.random.default_rng(1)
    for size in (1, 5, 30, 60):
        for values in (rng.permutation(size), rng.integers(0, 4, size), np.zeros(size, int)):
            found = passages.compact_windows(values.astype(np.uint64), 5)
            for i in range(size):
                for j in range(i + 4, size):
                    holding = [c for c, low, high in found if low <= i <= c <= j <= high]
                    assert len(holding) == 1 and values[holding[0]] == values[i:j + 1].min()


def test_passages_with_one_word_in_a_row(docs_of):
    head, tail = prose(60, 300).split(), prose(60, 301).split()
    cases = [head[:20] + ["na"] * 12 + tail[:18], head[:12] + ["na"] * 38, ["na"] * 38 + tail[:12], head[:5] + ["na"] * 40 + tail[:5], ["0"] * 70, head[:1] + ["na"] * 49, ["na", "no"] * 25]
    for n, case in enumerate(cases):
        around = [(["na"] * 9 if n in (1, 2, 5) and i else []) for i in range(2)]
        texts = [" ".join(prose(60, 310 + i).split() + around[i] + case + around[i] + prose(60, 320 + i).split()) for i in range(2)]
        rows = passages.repeated_passages(docs_of(texts)).collect()
        for i in range(2):
            start = 60 + len(around[i])
            assert any(r.doc_id == i and r.start_word <= start and r.end_word >= start + len(case) for r in rows), n
        assert {r.class_id for r in rows} == {0}


def test_verify_looks_at_every_window_across_an_edit():
    rng = np.random.default_rng(6)
    width, unit, least = 2 * passages.SIDE + 1, passages.UNIT, passages.need(0.8)
    x = rng.integers(0, 2**32, (40, width), dtype=np.uint32)
    y = x.copy()
    for i in range(40):  # a word put in replaces four shingles by five and moves the rest
        at = rng.integers(20, 80)
        y[i] = np.concatenate([x[i, :at], rng.integers(0, 2**32, 5, dtype=np.uint32), x[i, at + 4:]])[:width]
    y[:5] = rng.integers(0, 3, (5, width))
    x[:5] = rng.integers(0, 3, (5, width))
    full = np.ones(x.shape, bool)
    ok, first, last = passages.verify(x, full, y, full, least)
    across = 0
    for i in range(40):
        both = [sum((collections.Counter(x[i, k:k + unit].tolist()) & collections.Counter(y[i, k:k + unit].tolist())).values()) for k in range(width - unit + 1)]
        place = [int((x[i, k:k + unit] == y[i, k:k + unit]).sum()) for k in range(width - unit + 1)]
        want = [k for k, n in enumerate(both) if n >= least]
        assert ok[i] == bool(want) and (not want or (first[i], last[i]) == (want[0], want[-1]))
        across += max(place) >= least and want[-1] != max(k for k, n in enumerate(place) if n >= least)
    assert across > 5


def test_large_groups_link_what_pairs_link(docs_of):
    shared = prose(60, 400).split()
    edited = shared[:30] + ["zzzz"] + shared[31:]
    texts = [" ".join(prose(50, 410 + i).split() + (edited if i > 13 else shared) + prose(50, 440 + i).split()) for i in range(18)]
    found = [{(r.doc_id, r.class_id) for r in passages.repeated_passages(docs_of(texts), group=group).collect()} for group in (256, 4)]
    assert found[0] == {(i, 0) for i in range(18)} and found[1] == found[0]


# == Pipeline


@pytest.fixture()
def sf_dir(spark, docs_of, odd_texts, tmp_path):
    item = prose(40, 50)
    texts = odd_texts + [prose(150, 300 + i) for i in range(60)]
    texts += [(500 + i, re.sub(" ", "### ", prose(80, 400 + i))) for i in range(40)] + [(600, prose(80, 600) + " " + item), (601, "token = abcdefgh1234 " + prose(80, 601))]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(15, 75)] + [(500 + i, 0) for i in range(40)] + [(7, 1), (90, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds, seen = docs.dtypes, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = docs.collect()
        out = stage(spark, docs, sf_dir)
        assert n == 4 or out.dtypes == kinds
        out.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
    before = {k: {(r.doc_id, r.text) for r in rows} for k, rows in seen.items()}
    rejected = before["quality_classifier"] - before["simhash_near_dedup"]
    assert {i for i, _ in rejected if i is not None} >= set(range(500, 540)) and not {i for i, _ in rejected if i is not None} & set(range(15, 75))
    kept, given = seen["benchmark_decontamination"], seen["simhash_near_dedup"]
    fps = {brute_fingerprint(r.text) for r in given}
    root = roots_of(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    assert len(kept) == len(set(root.values())) == len({root[brute_fingerprint(r.text)] for r in kept})
    clean = before["secret_scans"]
    assert before["benchmark_decontamination"] - clean == {x for x in before["benchmark_decontamination"] if x[0] == 600}
    masked = {r.doc_id: r for r in seen["packing"]}
    assert masked[601].text.startswith("[SECRET] ") and masked[601].n_chars == len(masked[601].text)
    assert before["packing"] - clean == {x for x in before["packing"] if x[0] == 601}
    pieces = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert pieces <= 2048 and docs.filter("start = 0").count() == len(seen["packing"])


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


# == Recall of passages


def edited(words, how):
    at = len(words) // 2
    return {"equal": words, "replaced": words[:at] + ["zzzz"] + words[at + 1:], "inserted": words[:at] + ["zzzz"] + words[at:], "deleted": words[:at] + words[at + 1:]}[how]


def holds_similar_windows(a, b):
    a, b = (list(zip(*[w[i:] for i in range(passages.SHINGLE)])) for w in (a, b))
    unit, least = passages.UNIT, passages.need(0.8)
    return any(sum((collections.Counter(a[i:i + unit]) & collections.Counter(b[j:j + unit])).values()) >= least
               for i in range(len(a) - unit + 1) for j in range(len(b) - unit + 1))


def test_recall_of_edited_passages(docs_of):
    cells, texts, pairs = {}, [], []
    for length in (52, 60, 80):
        for how in ("equal", "replaced", "inserted", "deleted"):
            for n in range(25):
                words = prose(length, 10_000 + 1000 * length + n).split()
                seed = 50_000 + 4 * len(texts)
                two = [prose(70, seed).split() + words + prose(70, seed + 1).split(), prose(70, seed + 2).split() + edited(words, how) + prose(70, seed + 3).split()]
                if holds_similar_windows(*[words_of(" ".join(t)) for t in two]):
                    pairs.append((length, how, len(texts), len(texts) + 1))
                    texts += [" ".join(t) for t in two]
    classes = collections.defaultdict(set)
    for r in passages.repeated_passages(docs_of(texts)).collect():
        classes[r.doc_id].add(r.class_id)
    for length, how, a, b in pairs:
        found, total = cells.get((length, how), (0, 0))
        cells[length, how] = (found + bool(classes[a] & classes[b]), total + 1)
    print({k: f"{f}/{n}" for k, (f, n) in cells.items()})
    assert len(cells) == 12
    for (_, how), (f, n) in cells.items():
        assert n >= 20 and f >= (n if how == "equal" else 0.9 * n)
    # unrelated pairs share no class
    assert all(not classes[a] & classes[c] for (*_, a, _), (*_, c, _) in zip(pairs, pairs[1:]))


def test_boilerplate_costs_what_its_documents_are_many(spark, docs_of, monkeypatch):
    line, counted = prose(36, 900), {}

    def compared(pairs, threshold, real=passages.compared):
        pairs = pairs.persist()
        counted[n] = counted.get(n, 0) + pairs.count()
        return real(pairs, threshold)

    monkeypatch.setattr(passages, "compared", compared)
    for n in (150, 300):
        texts = [f"{prose(60, 20_000 + i)} {line} {prose(60, 30_000 + i)}" for i in range(n)]
        assert passages.repeated_passages(docs_of(texts), group=16).count() == 0
    assert 0 < counted[300] <= 3 * counted[150] and counted[300] < 300 * 60


def test_groups_of_any_size_give_the_same_classes(docs_of):
    shared, line = prose(70, 500).split(), prose(36, 501)
    texts = []
    for i in range(24):
        own = shared[:]
        if i % 3:
            own[20 + i] = f"edit{i}"
        texts.append(" ".join(prose(50, 510 + i).split() + own + prose(20, 540 + i).split()) + " " + line + " " + prose(50, 570 + i))
    found = [{(r.doc_id, r.class_id) for r in passages.repeated_passages(docs_of(texts), group=group).collect()} for group in (256, 8, 2)]
    assert found[0] == found[1] == found[2] and {c for _, c in found[0]} == {0}


# == Filters of the decontamination


def test_blocks_find_all_pairs_within_the_radius_and_few_others(spark):
    rng = random.Random(4)
    items = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    near = []
    for i, fp in enumerate(items):
        for n in (0, 3, 9, 14, 15, 16, 22):
            bits = rng.sample(range(64), n)
            near.append((i, 10, n, fp ^ sum((1 << b) if b < 63 else -(1 << 63) for b in bits)))
    index = spark.createDataFrame([(i, 10, fp) for i, fp in enumerate(items)] + [(i, 11, fp) for i, fp in enumerate(items)], "number long, n int, item_fp long")
    windows = spark.createDataFrame(near, "key long, n int, start_word int, fp long")
    got = {(r.key, r.start_word, r.number): r.hamming for r in decontam.candidates(windows, index).collect()}
    mask = (1 << 64) - 1
    want = {(k, w, i): ((fp ^ other) & mask).bit_count() for k, _, w, fp in near for i, other in enumerate(items) if ((fp ^ other) & mask).bit_count() <= 15}
    assert got == want and len(want) >= 60 * 5
    blocks = windows.select("n", F.inline(decontam._blocks(F.col("fp")))).join(index.select("n", F.inline(decontam._near_blocks(F.col("item_fp")))), ["n", "b", "v"])
    assert blocks.count() < 0.06 * len(near) * len(items) + 4 * len(near)


def test_recall_at_the_threshold(spark, docs_of):
    cases, texts = [], []
    for i in range(150):
        item = prose(50, 40_000 + i).split()
        changed = item[:25] + ["zzzz"] + item[26:]  # five of 46 shingles differ: 41 of 51 are shared
        cases.append((i, " ".join(item)))
        texts.append(prose(40, 41_000 + i) + " " + " ".join(changed) + " " + prose(40, 42_000 + i))
    found = decontam.find_contamination(docs_of(texts), spark.createDataFrame(cases, "item_id long, text string")).collect()
    hits = {r.doc_id for r in found if r.item_id == r.doc_id}
    print(f"found at a similarity of {41 / 51:.3f}: {len(hits)} of {len(cases)}")
    assert len(hits) >= 0.94 * len(cases) and all(r.item_id == r.doc_id for r in found)


def test_pipeline_leaves_columns_of_any_name_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    added = {c: F.concat(F.lit(c), F.coalesce(F.col("text"), F.lit("")).substr(1, 3)) for c in ("__row_key", "__row_note", "key", "row", "score", "n", "a.b", "text2")}
    wide = docs.drop("key").withColumns(added)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, sf_dir)
        assert out.dtypes == wide.dtypes, name
        assert out.filter(F.col("__row_key") != F.concat(F.lit("__row_key"), F.coalesce(F.col("text"), F.lit("")).substr(1, 3))).filter("text NOT LIKE '[SECRET]%'").isEmpty()


def some_contexts(rng, n):
    """Contexts around one boilerplate, of a few kinds with edits, some cut short: (before, context, matrix, filled)."""
    width, side = 2 * passages.SIDE + 1, passages.SIDE
    kinds = rng.integers(0, 2**32, (6, width), dtype=np.uint32)
    kinds[:, side - 10:side + 10] = kinds[0, side - 10:side + 10]
    before, context = [], []
    for i in range(n):
        x = kinds[rng.integers(0, 6)].copy() if i % 3 else np.where(np.abs(np.arange(width) - side) < 10, kinds[0], rng.integers(0, 2**32, width, dtype=np.uint32))
        at = rng.integers(0, width, rng.integers(0, 8))
        x[at] = rng.integers(0, 2**32, len(at), dtype=np.uint32)
        if i % 4 == 0:  # words put in move the rest
            x = np.concatenate([x[:60], rng.integers(0, 2**32, 5, dtype=np.uint32), x[60:]])[:width]
        low, high = rng.integers(0, 20), rng.integers(70, width + 1)
        before.append(side - low)
        context.append(x[low:high].astype("<u4").tobytes())
    before, context = np.array(before, np.int64), np.array(context, object)
    return before, context, *passages.matrix(before, context)


def test_windows_share_what_multisets_share():
    rng = np.random.default_rng(8)
    width, unit = 2 * passages.SIDE + 1, passages.UNIT
    x, y = rng.integers(0, 30, (20, width), dtype=np.uint32), rng.integers(0, 30, (20, width), dtype=np.uint32)
    y[10:, 3:] = x[10:, :-3]
    fx, fy = np.ones(x.shape, bool), np.ones(x.shape, bool)
    fx[::2, :10], fy[::3, -7:] = False, False
    found = passages.shared_in_windows(x, fx, y, fy)
    for i in range(20):
        for k in range(width - unit + 1):
            a, b = (collections.Counter(v[i, k:k + unit][f[i, k:k + unit]].tolist()) for v, f in ((x, fx), (y, fy)))
            assert found[i, k] == (a & b).total()


def test_contexts_meet_by_rare_shingles_and_no_boilerplate_brings_them_together():
    rng, least = np.random.default_rng(9), passages.need(0.8)
    _, _, m, filled = some_contexts(rng, 150)
    i, j = np.triu_indices(150, 1)
    ok = passages.verify(m[i], filled[i], m[j], filled[j], least)[0]
    root = rng.integers(-50, 50, 150)
    want = {(a, b) if root[a] < root[b] else (b, a) for a, b in zip(i[ok].tolist(), j[ok].tolist()) if root[a] != root[b]}
    for together in (1 << 19, 7):
        got = {(a, b) for p, q in passages.likely_pairs(m, filled, root, least, together) for a, b in zip(p.tolist(), q.tolist())}
        assert want <= got and len(want) > 100 and all(root[a] < root[b] for a, b in got)
    alone = np.flatnonzero(np.arange(150) % 3 == 0)
    assert not sum(len(p) for p, _ in passages.likely_pairs(m[alone], filled[alone], np.arange(len(alone)), least))


@pytest.mark.parametrize("limit", [4096, 20])
def test_similar_contexts_of_a_signature(spark, limit):
    """One group or many: the pairs are the similar ones of different classes."""
    rng, least = np.random.default_rng(10), passages.need(0.8)
    before, context, m, filled = some_contexts(rng, 90)
    root = rng.integers(0, 60, 90)
    rows = [(7, i, int(b), bytes(c), int(r)) for i, (b, c, r) in enumerate(zip(before, context, root))] + [(8, 100, 45, bytes(context[0]), 1), (8, 101, 45, bytes(context[1]), 1)]
    frame = spark.createDataFrame(rows, "sig long, kind long, before long, context binary, root long")
    i, j = np.triu_indices(90, 1)
    i, j = (np.where(root[i] < root[j], a, b) for a, b in ((i, j), (j, i)))
    ok, first, last = passages.verify(m[i], filled[i], m[j], filled[j], least)
    ok &= root[i] != root[j]
    found = passages.similar_kinds(frame, 0.8, limit).collect()
    assert sorted(map(tuple, found)) == sorted(zip(i[ok].tolist(), j[ok].tolist(), first[ok].tolist(), last[ok].tolist()))


def test_ranges_are_those_of_contexts_not_of_windows(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 2**32, (2, 2 * passages.SIDE + 1), dtype=np.uint32).astype("<u4")
    rows = [(7, t, 100 + t, passages.SIDE, x[t % 2].tobytes(), t % 2) for t in range(40)]
    kinds = passages.distinct_contexts(spark.createDataFrame(rows, passages.CONTEXT))
    found = passages.exact_ranges(kinds).collect()
    assert len(found) == 2 * len(range(0, passages.SIDE + 1, passages.STEP)) and {(r.kind, r.least, r.most) for r in found} == {(0, 0, 38), (1, 1, 39)}
    assert min(r.first for r in found) == -passages.SIDE and max(r.last for r in found) == passages.SIDE + passages.SHINGLE
