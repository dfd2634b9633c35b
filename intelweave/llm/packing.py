"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents stand in the order of their ids. Within a block of consecutive documents the cuts
between sequences minimise the sum, over all sequences, of

* padding: ``size`` minus the length, and nothing where the length is a power of two,
* a fixed cost a sequence,
* a penalty for the place of the cut: none between documents, some between sentences, more elsewhere.

``best[j] = place(j) + min over i of best[i] + padding(i, j)``. The padded form is a minimum of
``best[i] + position[i]`` over a sliding window, which a monotone queue holds; the lengths that are
powers of two add at most twelve transitions to a cut. Places to cut are document and sentence ends,
every ``gap`` ids where none is nearer, and every id of a block's last ``size`` ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("{id} {type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, padding long")


def padding(length: int, size: int) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def cut_places(counts: np.ndarray, sentences: np.ndarray, size: int, gap: int, at_sentence: int, elsewhere: int):
    """Positions where a block may be cut, the first one 0 and the last its end, and their penalties."""
    docs = np.cumsum(counts)
    total = int(docs[-1])
    sure = np.union1d(np.append(0, docs), sentences)
    holes = np.flatnonzero(np.diff(sure) > gap)
    more = [np.arange(a + gap, b, gap) for a, b in zip(sure[holes].tolist(), sure[holes + 1].tolist())]
    places = np.unique(np.concatenate([sure, *more, np.arange(max(0, total - size), total)]))
    penalty = np.full(len(places), elsewhere, np.int64)
    penalty[np.searchsorted(places, sentences)] = at_sentence
    penalty[np.searchsorted(places, docs)] = 0
    return places, penalty


def best_cuts(places: list[int], penalty: list[int], size: int, fixed: int) -> tuple[list[int], int]:
    """The cheapest cuts among ``places`` (both ends included) and their cost."""
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    index = {p: i for i, p in enumerate(places)}
    best, back = [0] * len(places), [0] * len(places)
    queue = deque([(0, 0, 0)])  # (best + position, position, index), the first entry the least
    for i in range(1, len(places)):
        p = places[i]
        while queue[0][1] < p - size:
            queue.popleft()
        key, _, j = queue[0]
        cost = key + size - p
        for power in powers:
            k = index.get(p - power)
            if k is not None and best[k] < cost:
                cost, j = best[k], k
        best[i] = cost = cost + fixed + penalty[i]
        back[i] = j
        key = cost + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, i))
    cuts, i = [places[-1]], len(places) - 1
    while i:
        i = back[i]
        cuts.append(places[i])
    return cuts[::-1], best[-1]


def pack_block(ids: np.ndarray, counts: np.ndarray, sentences: np.ndarray, size: int, gap: int, fixed: int, at_sentence: int, elsewhere: int):
    """Pieces of a block: (document's index, start in it, length, sequence's index, offset in it, sequence's length)."""
    places, penalty = cut_places(counts, sentences, size, gap, at_sentence, elsewhere)
    cuts = np.array(best_cuts(places.tolist(), penalty.tolist(), size, fixed)[0])
    docs = np.append(0, np.cumsum(counts))
    edges = np.union1d(cuts, docs)
    doc = np.searchsorted(docs, edges[:-1], "right") - 1
    seq = np.searchsorted(cuts, edges[:-1], "right") - 1
    return doc, edges[:-1] - docs[doc], np.diff(edges), seq, edges[:-1] - cuts[seq], np.diff(cuts)[seq]


def pack(
    docs: DataFrame,
    tokenizer: str,
    kind: str = "word",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    size: int = 2048,
    block: int = 1 << 20,
    gap: int = 64,
    fixed: int = 16,
    at_sentence: int = 12,
    elsewhere: int = 48,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` ids, ``ids`` as little-endian 32-bit integers.

    A null or empty text is the end id alone. Rows with one id, or with none, are documents of
    their own, in the order of their texts. Other columns are dropped, so their names cannot clash;
    an empty table gives no rows. ``sequence_id`` is unique; it numbers the sequences of a partition
    upward from the partition's number times 2**33.

    Documents are range-partitioned by (id, text), each partition is read as a stream, and the
    dynamic programme runs over blocks that end at the first document end past ``block`` ids: memory
    holds a block and one batch, whatever the size of a partition, and the blocks' ends cost less than
    a sequence in 500.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.select("id", "text", (F.spark_partition_id().cast("long") * (1 << 33)).alias("part"))
    schema = SCHEMA.format(id="id", type=id_type.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from intelweave.llm.tokens import encoder

        enc = encoder(tokenizer, kind)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        held_ids, done, first = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal done, held_ids
            ids = np.concatenate([h[1] for h in held])
            counts = np.concatenate([h[2] for h in held])
            at, sentences = 0, []
            for h in held:
                sentences.append(h[3] + at)
                at += len(h[1])
            doc, start, length, seq, offset, whole = pack_block(ids, counts, np.concatenate(sentences), size, gap, fixed, at_sentence, elsewhere)
            names = pa.chunked_array([h[0] for h in held]).combine_chunks()
            if isinstance(names, pa.ChunkedArray):
                names = pa.concat_arrays(names.chunks)
            bounds = np.append(0, np.cumsum(length) * 4).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            pads = np.where(whole & (whole - 1) == 0, 0, size - whole)
            cols = [names.take(pa.array(doc)), *map(pa.array, (start, length)), raw, *map(pa.array, (counts[doc], first + done + seq, offset, whole, pads))]
            done += int(seq[-1]) + 1
            held.clear()
            held_ids = 0
            return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "padding"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            first = batch.column(2)[0].as_py()
            texts, names = batch.column(1), batch.column(0)
            for a in range(0, batch.num_rows, 500):
                ids, counts, sentences = enc.encode(texts.slice(a, 500).to_pylist(), end_id)
                # close blocks at the document ends past `block` ids
                upto, low, low_id = np.cumsum(counts), 0, 0
                while low < len(counts):
                    high = min(int(np.searchsorted(upto, low_id + block - held_ids)) + 1, len(counts))
                    high_id = int(upto[high - 1])
                    mine = sentences[(sentences > low_id) & (sentences <= high_id)] - low_id
                    held.append((names.slice(a + low, high - low), ids[low_id:high_id], counts[low:high], mine))
                    held_ids += high_id - low_id
                    low, low_id = high, high_id
                    if held_ids >= block:
                        yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
