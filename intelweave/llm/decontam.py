"""Benchmark decontamination with item-sized SimHash windows, in DataFrame operations only.

For each benchmark item, windows of its size slide over the documents. A window and an item are
candidates if their SimHash fingerprints differ in at most ``RADIUS`` bits: fingerprints are cut into four
blocks of 16 bits, and two within the radius differ in at most ``NEAR`` bits of one block at least. So items
are listed under all values near each of their blocks, windows under their blocks as they are, and an
equi-join on (size, block number, value) finds every such pair, and few others: 4 % of unrelated ones.
Only fingerprints travel in that join. Candidates get their shingles back and are verified by the exact
weighted Jaccard similarity, where a shingle weighs as often as it stands there.

Which windows are fingerprinted: a window that verifies shares shingles with its item, and moving its
start on to its first shared shingle loses none of them. So windows begin at shared shingles (or end
with the document), and documents without any are left out early: a bitmap of the items' shingles, sized by
their number, is looked up while the row is read, and an exact join follows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave.functions.bitmap import Bitmap, bitmap_of, may_hold
from intelweave.functions.flow import bind, with_computed
from intelweave.llm.common import row_key, staged

SHINGLE = 5
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
NEAR = RADIUS // BLOCKS  # bits: were all blocks further apart, the fingerprints would be so by BLOCKS * (NEAR + 1) > RADIUS
SHORT = 32_767  # shingles that counters of 16 bits hold; more are counted in 32 bits


def words_of(text: Column) -> Column:
    """Runs of letters and digits in the lower-cased text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words."""
    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return bind(words, lambda w: bind(F.transform(w, lambda x: F.xxhash64(x)), runs))


def simhash_of(shingles: Column) -> Column:
    """64-bit SimHash: a bit is set if it is set in over half of the hashes. Counted four bits to a long, of long windows two."""
    return F.when(F.size(shingles) <= SHORT, _majority(shingles, 16)).otherwise(_majority(shingles, 32))


def _majority(shingles: Column, width: int) -> Column:
    lanes, top = sum(1 << i for i in range(0, 64, width)), width - 2

    def majority(counts: Column) -> Column:
        half = (F.lit((1 << top) - 1) - F.floor(F.size(shingles) / 2)).cast("long") * F.lit(lanes)
        bits = [F.shiftleft(F.shiftrightunsigned((counts[t] + half), top).bitwiseAND(lanes), t) for t in range(width)]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    zero = F.array(*[F.lit(0).cast("long")] * width)
    counted = F.aggregate(shingles, zero, lambda acc, h: F.array(*[acc[t] + F.shiftrightunsigned(h, t).bitwiseAND(lanes) for t in range(width)]))
    return bind(counted, majority)


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("b"), _block(fp, b).alias("v")) for b in range(BLOCKS)])


def _near_blocks(fp: Column) -> Column:
    """All (block number, value) that a fingerprint with a block within ``NEAR`` bits of this one's may hold."""
    masks = [sum(1 << i for i in bits) for n in range(NEAR + 1) for bits in combinations(range(BLOCK_BITS), n)]
    flips = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
    return F.flatten(F.transform(_blocks(fp), lambda x: F.transform(flips, lambda m: F.struct(x["b"].alias("b"), x["v"].bitwiseXOR(m).alias("v")))))


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the lesser count in the two arrays."""
    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    both = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x))))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (id, item, similarity, hamming, start_word, n_words): the best window of each document for each item it holds.

    ``n_words`` is the item's size. Items of fewer than five words are compared by their whole word
    sequence; null, empty and wordless items match nothing, and neither do null or empty texts. A
    document shorter than an item is compared whole. Repeated documents, and rows that share an id or
    have none, are looked at one by one and reported under their id; repeated items are all reported.
    Items may be of any length. Other columns are left out, so their names cannot clash.

    Work: one pass over the texts; what leaves it are documents with a shared shingle. A passage that
    very many documents share is one join key, which adaptive execution splits on the documents' side.
    """
    found = find_windows(docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text")), benchmark, threshold, item_col, item_text_col)
    best = found.groupBy(F.col("key.id").alias("id"), "item").agg(F.max(F.struct("similarity", -F.col("hamming"), -F.col("start_word"), "n_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("hamming"),
                       (-F.col("b.col3")).alias("start_word"), F.col("b.n_words").alias("n_words"))


def find_windows(keyed: DataFrame, benchmark: DataFrame, threshold: float, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All verified windows (key, item, similarity, hamming, start_word, n_words) of rows (key, text)."""
    items = staged(with_computed(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), {"words": words_of(F.col("text"))})
                   .filter(F.size("words") > 0).select("item", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k")), "items")
    parts = [_windows_of_size(keyed, items.filter(F.col("k") == r["k"]), r["k"], threshold) for r in items.select("k").distinct().collect()]  # at most five
    if not parts:
        return keyed.limit(0).select("key", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0.0).alias("similarity"),
                                     F.lit(0).alias("hamming"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _windows_of_size(keyed: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    items = with_computed(items.select("item", "n", "words"), {"item_sh": shingles_of(F.col("words"), k)}).select("item", "n", "item_sh")
    items = with_computed(items, {"item_fp": simhash_of(F.col("item_sh"))}).withColumn("number", F.monotonically_increasing_id())
    items = staged(items, "item-shingles")  # numbered once and for all: items may repeat
    wanted = items.select("n", F.explode("item_sh").alias("s")).distinct()
    bitmap = bitmap_of(wanted, "s", per_item=64, probes=4)  # one shingle of a document's hundreds is enough to keep it

    rows = with_computed(keyed, {"sh": shingles_of(words_of(F.col("text")), k)}).select("key", "sh")
    held = lambda w: F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: may_hold(Bitmap(w, bitmap.bits, bitmap.probes), F.col("sh")[i]))
    places = F.when(F.size("sh") > 0, bind(bitmap.words, held)).otherwise(F.array().cast("array<int>"))
    rows = staged(with_computed(rows, {"hits": places}).filter(F.size("hits") > 0), "shingled")

    hits = rows.select("key", F.size("sh").alias("m"), F.explode(F.transform("hits", lambda i: F.struct(i.alias("at"), F.col("sh")[i].alias("s")))).alias("h"))
    starts = hits.select("key", "m", F.col("h.at").alias("at"), F.col("h.s").alias("s")).join(wanted, "s")
    starts = starts.select("key", "n", F.greatest(F.lit(0), F.least("at", F.col("m") - F.col("n") + k - 1)).alias("start_word")).distinct()
    windows = starts.join(rows.select("key", "sh"), "key")
    windows = with_computed(windows.select("key", "n", "start_word", F.slice("sh", F.col("start_word") + 1, F.col("n") - k + 1).alias("win")), {"fp": simhash_of(F.col("win"))})

    # Of copies of a row one is enough.
    windows = windows.select("key", "n", "start_word", "fp").distinct()
    pairs = candidates(windows, items.select("number", "n", "item_fp"))
    pairs = staged(pairs, "candidates")
    texts = rows.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "sh").dropDuplicates(["key"])
    pairs = pairs.join(texts, "key").join(items.select("number", "item", "item_sh"), "number")
    pairs = with_computed(pairs, {"win": F.slice("sh", F.col("start_word") + 1, F.col("n") - k + 1)}).drop("sh")
    pairs = with_computed(pairs, {"shared": shared_weight(F.col("win"), F.col("item_sh"))})
    similarity = F.col("shared") / (F.size("win") + F.size("item_sh") - F.col("shared"))
    return pairs.select("key", "item", similarity.alias("similarity"), "hamming", "start_word", F.col("n").alias("n_words")).filter(F.col("similarity") >= threshold)


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n, start_word, number, hamming) of all windows and items of one size within the radius, each pair once."""
    blocks = windows.select("key", "n", "start_word", "fp", F.inline(_blocks(F.col("fp"))))
    index = items.select("number", "n", "item_fp", F.inline(_near_blocks(F.col("item_fp"))))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = blocks.join(index, ["n", "b", "v"]).withColumn("hamming", F.bit_count(apart)).filter(F.col("hamming") <= RADIUS)
    # of the blocks that are near each other, the first one reports the pair
    return met.filter(_first_near(apart) == F.col("b")).select("key", "n", "start_word", "number", "hamming")


def _first_near(difference: Column) -> Column:
    """Number of the first block in which two fingerprints are near each other, from their exclusive or."""
    out = F.lit(None).cast("int")
    for b in range(BLOCKS - 1, -1, -1):
        out = F.when(F.bit_count(_block(difference, b)) <= NEAR, b).otherwise(out)
    return out
