"""Near-duplicate passages across documents by compact windows.

Every text is a row of word shingles. For each of a few hash functions a Cartesian tree over the
shingles' hashes cuts all its subsequences of a passage's length or more into compact windows
(l, c, r): the subsequences that lie in [l, r] and hold c all have the shingle at c as their minimum.
Their number is about twice the text's length over a passage's length. Only nodes of the tree that hold a
passage matter, and they are the minima of sliding windows of that length; the tree is built over those.

One shared minimum is no evidence: a short line that very many documents share would bring all their windows
together. So the windows of two hash functions are joined where their intervals overlap, and the signature
of an overlap holds both minima. Two unit windows (one passage length) of similarity j share a signature with
a probability of j², wherever in them words differ, were put in or left out; ``hashes`` such pairs of functions
miss a passage with a similarity of 0.8 with a probability of 0.36 to the power of ``hashes``. Equal passages
share all of them. Windows of different texts with one signature are laid over each other at c, and the unit
windows inside their overlap are verified by the exact Jaccard similarity of their shingles.
Whole unit windows of one shingle (a word repeated on and on) are grouped by it.

A signature that more than ``group`` windows share is not paired up, nor brought into one task: its windows are
grouped by the exact shingles of ten fixed ranges around c, one of which two windows with a whole passage in
common always share; its distinct contexts are compared with the most frequent ones; and those that this
leaves in different classes are compared where they share one of their rarest shingles, as two similar windows
must (prefix filter). A boilerplate too short for a passage thus costs what its documents are many, not their pairs.
Groups, not pairs, are the result: each has a number, and a passage is linked to the groups it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intelweave.llm.common import components, sorted_runs, staged
from intelweave.llm.licenses import word_bytes

SHINGLE = 5
PASSAGE = 50  # words
UNIT = PASSAGE - SHINGLE + 1  # shingles of a unit window
SIDE = UNIT - 1  # shingles of a context before and behind c
STEP = 5  # between the ranges of a window in a large group
RANGE = UNIT - STEP + 1  # shingles of such a range
_PRIME = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the 64-bit mixing function
_SEED = 0xD1B54A32D192ED03
_TOGETHER = 1 << 20  # characters of texts worked on at a time, unless one text has more
_CHUNK = 1 << 20  # bytes hashed at a time
_PLACE = 20  # low bits that hold a shingle's place while minima are sought, more for longer texts
WINDOW = "sig long, t long, c long, near int"
CONTEXT = "sig long, t long, c long, before int, context binary, kind long"
MEMBER = "t long, first long, last long, hub long"
WHOLE = -(1 << 31)  # as ``near``: the row of a whole text, with its words as c


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64; a worker keeps them."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, _CHUNK + 1024)
        _POWERS = tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x & 0xFFFFFFFFFFFFFFFF, np.uint64))) for x in (_PRIME, pow(_PRIME, -1, 1 << 64)))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64),) * 2
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))  # a number for each byte


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``raw``, where blanks stand between words, and the place where each begins.

    The sums of byte numbers times rising powers are taken once over a chunk; a word's hash is a difference of two,
    brought back to its own start. Chunks end at blanks, so memory does not grow with the text.
    """
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = raw.find(b" ", at + _CHUNK)
        end = len(raw) if end < 0 else end
        x = np.frombuffer(raw, np.uint8, end - at, at)
        word = np.concatenate([[False], x != 32, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        power, inverse = _powers(len(x))
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[x] * power[:len(x)], dtype=np.uint64))
        start, stop = edge[::2], edge[1::2]
        hashes.append(mix((sums[stop] - sums[start]) * inverse[start]))
        places.append(start + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of five words of each text, in a row, and how many each text has; none for shorter texts."""
    raws = [word_bytes(text) for text in texts]
    h, place = word_hashes(b" ".join(raws))
    ends = np.cumsum([len(raw) + 1 for raw in raws])
    words = np.diff(np.searchsorted(place, ends), prepend=0)
    n = max(len(h) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out = out * np.uint64(_PRIME) + h[j:j + n]
    left = np.repeat(np.cumsum(words), words)[:n] - np.arange(n)  # words of the text from here on
    return mix(out[left >= SHINGLE]), np.maximum(words - SHINGLE + 1, 0)


def chunks(rows: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows in lists of about ``_TOGETHER`` characters, or of one longer text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[text])
        if n >= _TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def window_minima(values: np.ndarray, length: int) -> np.ndarray:
    """Place of the first minimum of each run of ``length`` values, by doubling."""
    least, at, size = values, np.arange(len(values)), 1

    def joined(k: int) -> tuple[np.ndarray, np.ndarray]:
        later = least[k:] < least[:-k]
        return np.where(later, least[k:], least[:-k]), np.where(later, at[k:], at[:-k])

    while 2 * size <= length:
        least, at = joined(size)
        size *= 2
    return joined(length - size)[1] if size < length else at


def least_of_runs(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of each run of ``length`` values."""
    size = 1
    while 2 * size <= length:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:size - length], values[length - size:]) if size < length else values


def compact_windows(values: np.ndarray, length: int, ends: np.ndarray | None = None, placed: int = 0) -> np.ndarray:
    """Rows (c, l, r) of all compact windows that hold a subsequence of ``length``, in order of c.

    ``placed`` low bits of each value may hold its place: no two are equal then, and a minimum says where it stands.

    Of equal minima c is the first one, so it depends on the subsequence alone and not on what is around it.
    ``ends`` are the ends of several texts in a row; windows stay inside a text. The nodes of the Cartesian
    tree that hold ``length`` values are the minima of the runs of that length, and so are all nodes above them;
    one pass with a stack over these few nodes gives their intervals.
    """
    ends = np.array([len(values)]) if ends is None else ends
    if len(values) < length:
        return np.zeros((0, 3), np.int64)
    begins = np.append(0, ends[:-1])
    minima = (least_of_runs(values, length) & np.uint64((1 << placed) - 1)).astype(np.int64) if placed else window_minima(values, length)
    end = np.repeat(ends, ends - begins)[:len(minima)]
    nodes = minima[np.arange(len(minima)) + length <= end]  # in rising order, as a run's minimum never moves back
    nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])[:len(nodes)]]
    of = np.searchsorted(ends, nodes, "right")
    low, high, open_ = begins[of].tolist(), (ends[of] - 1).tolist(), []
    before = -1
    for k, (i, v, d) in enumerate(zip(nodes.tolist(), values[nodes].tolist(), of.tolist())):
        if d != before:
            open_, before = [], d
        while open_ and open_[-1][1] > v:
            high[open_.pop()[2]] = i - 1
        if open_:
            low[k] = open_[-1][0] + 1
        open_.append((i, v, k))
    return np.stack([nodes, np.array(low, np.int64), np.array(high, np.int64)], 1)


def joint_windows(h: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(signature, c, first start, last start) where compact windows of two hash functions overlap.

    Each unit window begins in exactly one compact window of each function, so both cut the starts into
    intervals; the overlaps are what both leave whole. c is the first function's minimum.
    """
    sides = []
    bits = np.uint64(max(_PLACE, len(h).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    for f in (0, 1):
        values = mix(h + np.uint64((_SEED * (2 * seed + f + 1)) & 0xFFFFFFFFFFFFFFFF)) >> bits << bits | place
        c, low, high = compact_windows(values, UNIT, ends, int(bits)).T
        first, last = np.maximum(low, c - UNIT + 1), np.minimum(c, high - UNIT + 1)
        order = np.argsort(first, kind="stable")
        sides.append((c[order], first[order], last[order]))
    (c, first, last), (d, first2, last2) = sides
    if not len(c):
        return (np.empty(0, np.int64),) * 4
    start = np.union1d(first, first2)
    i, j = np.searchsorted(first, start, "right") - 1, np.searchsorted(first2, start, "right") - 1
    sig = mix(mix(h[c[i]] + np.uint64(seed)) ^ h[d[j]])
    return sig.view(np.int64), c[i], start, np.minimum(last[i], last2[j])


def text_windows(texts: DataFrame, hashes: int) -> DataFrame:
    """Signatures of the joint windows of each distinct text (t, text); a task looks at equal texts once.

    ``near`` holds how far the unit windows reach before and behind c. Whole unit windows of one shingle are
    one row with their run's length, negative, as ``near``. A text that is long enough for a passage has one
    more row, with ``WHOLE`` as ``near``.
    """
    def of_texts(ts: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        h, size = shingles_of(texts)
        h, ts, size = h[np.repeat(size >= UNIT, size)], np.array(ts, np.int64)[size >= UNIT], size[size >= UNIT]
        if not len(size):
            return
        ends = np.cumsum(size)
        t = np.repeat(ts, size)
        edge = np.zeros(len(h), np.uint64)
        edge[ends - size] = 1
        new = np.append(True, (h[1:] != h[:-1]) | (edge[1:] > 0))
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        head = np.flatnonzero(new)[run >= UNIT]
        cols = [(mix(h[head]).view(np.int64), t[head], (head - (ends - size)[np.searchsorted(ends, head, "right")]), -run[run >= UNIT].astype(np.int32))]
        cols.append((mix(mix(ts.view(np.uint64))).view(np.int64), ts, size + SHINGLE - 1, np.full(len(ts), WHOLE, np.int32)))
        left = np.append(np.flatnonzero(new), len(h))
        rest = left[np.searchsorted(left, np.arange(len(h)), "right")] - np.arange(len(h))  # equal shingles from here on
        for f in range(hashes):
            sig, c, first, last = joint_windows(h, ends, f)
            # starts whose whole unit window is one shingle have the row above; they come one by one
            some = rest[first] < UNIT
            sig, c, first, last = sig[some], c[some], first[some], last[some]
            begin = (ends - size)[np.searchsorted(ends, c, "right")]
            cols.append((sig, t[c], c - begin, ((c - first) << 8 | (last + UNIT - 1 - c)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*cols)], names=["sig", "t", "c", "near"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def fresh() -> Iterator[tuple[int, str]]:
            for batch in batches:
                for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if t not in seen:
                        seen.add(t)
                        yield t, text

        for rows in chunks(fresh(), 1):
            yield from of_texts(*map(list, zip(*rows)))

    return texts.select("t", "text").mapInArrow(windows, WINDOW)


def shared_windows(windows: DataFrame, limit: int = 4096) -> DataFrame:
    """The windows whose signature stands in two texts at least, and the rows of whole texts."""
    names = ["sig", "t", "c", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = None, []  # (signature, text, whether shared) of the row before, and rows of that text that may yet be shared
        for sig, t, c, near in sorted_runs(batches, limit):
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(start, len(sig)))
            least = np.minimum.reduceat(t, start)
            many = least != np.maximum.reduceat(t, start)
            joins = before is not None and before[0] == sig[0]
            if joins and (before[2] or before[1] != least[0]):
                many[0] = True
            keep = np.repeat(many, size) | (near == WHOLE)
            if joins and many[0]:
                # the pieces before were taken for one text's: their rows come after all
                for piece in held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in piece], names=names)
            if not joins or many[0]:
                held = []
            if len(start) > 1:
                held = []
            if not many[-1]:
                held.append([x[start[-1]:] for x in (sig, t, c, near)])
            before = (sig[-1], t[-1], bool(many[-1]))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, t, c, near)], names=names)

    return windows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, WINDOW)  # one long key: a radix sort


def contexts(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with the shingles around c, 32 bits of each, as far as a unit window can reach.

    ``kind`` is a hash of the signature, the place of c and these shingles: equal for windows with one context.
    """
    lists = windows.groupBy("t").agg(F.collect_list(F.struct("sig", "c", "near")).alias("w"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            ends = np.cumsum([len(x) for x in batch.column(2)])
            sig, c, near = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))

            def fresh() -> Iterator[tuple[int, str, int]]:
                for k, (t, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    if t not in seen:
                        seen.add(t)
                        yield t, text, k

            out: list[list] = [[] for _ in range(6)]
            for rows in chunks(fresh(), 1):
                h, size = shingles_of([text for _, text, _ in rows])
                raw = (h >> np.uint64(32)).astype("<u4").tobytes()
                for (t, _, k), start in zip(rows, (np.cumsum(size) - size).tolist()):
                    own = slice(ends[k - 1] if k else 0, ends[k])
                    before = near[own] >> 8
                    low, high = 4 * (start + c[own] - before), 4 * (start + c[own] + (near[own] & 255) + 1)
                    parts = [raw[i:j] for i, j in zip(low.tolist(), high.tolist())]
                    kinds = [xxhash.xxh3_64_intdigest(p, s & 0xFFFFFFFFFFFFFF00 | b) for p, s, b in zip(parts, sig[own].tolist(), before.tolist())]
                    for x, y in zip(out, (sig[own], np.full(len(parts), t, np.int64), c[own], before, parts, np.array(kinds, np.uint64).view(np.int64))):
                        x.append(y)
                    if len(out[0]) >= 500:
                        yield packed(out)
                        out = [[] for _ in range(6)]
            if out[0]:
                yield packed(out)

    def packed(out: list[list]) -> pa.RecordBatch:
        cols = [pa.array([p for parts in x for p in parts], pa.binary()) if i == 4 else pa.array(np.concatenate(x)) for i, x in enumerate(out)]
        return pa.RecordBatch.from_arrays(cols, names=["sig", "t", "c", "before", "context", "kind"])

    return texts.join(lists, "t").select("t", "text", "w.sig", "w.c", "w.near").mapInArrow(run, CONTEXT)


def matrix(before: np.ndarray, context: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in rows with c in one column, and which cells are filled; rows not in ``use`` stay empty."""
    m = np.zeros((len(context), 2 * SIDE + 1), np.uint32)
    filled = np.zeros(m.shape, bool)
    for i in range(len(m)) if use is None else np.flatnonzero(use).tolist():
        b, h = before[i], np.frombuffer(context[i], "<u4")
        m[i, SIDE - b:SIDE - b + len(h)] = h
        filled[i, SIDE - b:SIDE - b + len(h)] = True
    return m, filled


def need(threshold: float) -> int:
    """Shared shingles of two unit windows whose Jaccard similarity reaches ``threshold``."""
    return int(np.ceil(2 * UNIT * threshold / (1 + threshold) - 1e-9))


def may_hold(row: np.ndarray, filled: np.ndarray, asked: np.ndarray, bits: int = 512) -> np.ndarray:
    """For each cell of ``asked`` whether a filled cell of the same line of ``row`` has its last bits."""
    line = np.arange(len(row))[:, None] * (bits + 1)
    held = np.zeros(len(row) * (bits + 1), bool)
    held[line + np.where(filled, row & np.uint32(bits - 1), np.uint32(bits))] = True
    return held[line + (asked & np.uint32(bits - 1))]


def shared_in_windows(x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """[pair, start]: how many shingles the unit windows of both rows that begin there share, as multisets.

    Each pair's shingles are numbered; as the windows move on by one place, a shingle of each side leaves and one
    comes, and the count of what both have follows. Empty cells match nothing.
    """
    n, width = x.shape
    value = np.concatenate([np.where(fx, x, np.uint64(1 << 32)), np.where(fy, y, np.uint64((1 << 32) + 1))], 1).astype(np.uint64)
    key = np.sort(value << np.uint64(8) | np.arange(2 * width, dtype=np.uint64), 1)
    number = np.zeros((n, 2 * width), np.int64)
    np.cumsum(key[:, 1:] >> np.uint64(8) != key[:, :-1] >> np.uint64(8), 1, out=number[:, 1:])
    number += np.arange(n)[:, None] * (2 * width)
    cells = np.empty_like(number)
    np.put_along_axis(cells, (key & np.uint64(255)).astype(np.int64), number, 1)
    ours, theirs = (np.ascontiguousarray(c.T) for c in (cells[:, :width], cells[:, width:]))
    have, other = (np.bincount(c[:UNIT].ravel(), minlength=cells.size).astype(np.int16) for c in (ours, theirs))
    out = np.empty((width - UNIT + 1, n), np.int16)
    out[0] = np.minimum(have, other).reshape(n, -1).sum(1)
    for k in range(width - UNIT):
        now = out[k].copy()
        for i, a, b in ((ours[k], have, other), (theirs[k], other, have)):
            now -= a[i] <= b[i]
            a[i] -= 1
        for i, a, b in ((ours[k + UNIT], have, other), (theirs[k + UNIT], other, have)):
            now += a[i] < b[i]
            a[i] += 1
        out[k + 1] = now
    return out.T


def verify(x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows: whether some unit window is similar enough, and the first and last start of one, as columns."""
    def sums(a: np.ndarray) -> np.ndarray:
        s = np.pad(np.cumsum(a, 1, dtype=np.int16), ((0, 0), (1, 0)))
        return s[:, UNIT:] - s[:, :-UNIT]

    both = fx & fy  # filled cells stand in one run
    begin, start = both.argmax(1)[:, None], np.arange(x.shape[1] - UNIT + 1)
    whole = (start >= begin) & (start <= begin + both.sum(1)[:, None] - UNIT)
    good = whole & (sums(both & (x == y)) >= least)
    # Equal in place is enough; where words were put in or left out, each other window is compared as a multiset. A bit
    # for each shingle of the other side tells of most windows that they share too few.
    rest = np.flatnonzero((whole & ~good).any(1))
    for a, fa, b, fb in ((x, fx, y, fy), (y, fy, x, fx)):
        bound = sums(may_hold(a[rest], fa[rest], b[rest]) & fb[rest])
        rest = rest[(whole[rest] & ~good[rest] & (bound >= least)).any(1)]
    for a in range(0, len(rest), 2048):
        some = rest[a:a + 2048]
        good[some] |= whole[some] & (shared_in_windows(x[some], fx[some], y[some], fy[some]) >= least)
    return good.any(1), good.argmax(1), good.shape[1] - 1 - good[:, ::-1].argmax(1)


def _members(t: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray, hub: np.ndarray) -> list[pa.Array]:
    """Columns of MEMBER, in words, from the first and last columns of unit windows."""
    return [pa.array(t), pa.array(c - SIDE + first), pa.array(c - SIDE + last + PASSAGE), pa.array(hub)]


def group_windows(found: DataFrame, threshold: float, group: int) -> DataFrame:
    """MEMBER rows of signatures that at most ``group`` windows share, by comparing all their distinct contexts.

    Windows with one context are alike without a look; between contexts, all pairs of different texts are verified.
    """
    least = need(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, t, c, before, context, kind in sorted_runs(batches, group):
            # rows are sorted by signature, context and text: ``at`` holds the first row of each context
            new = np.append(True, (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1]))
            at, of = np.flatnonzero(new), np.cumsum(new) - 1
            last_row = np.append(at[1:], len(sig)) - 1
            single = t[at] == t[last_row]
            start = np.flatnonzero(np.append(True, sig[at][1:] != sig[at][:-1]))
            size = np.diff(np.append(start, len(at)))
            m, filled = matrix(before[at], context[at], np.repeat(size > 1, size))
            left, right = [], []
            for n in np.unique(size):
                if n > 1:
                    block = start[size == n][:, None] + np.arange(n)
                    i, j = np.triu_indices(n, 1)
                    left.append(block[:, i].ravel())
                    right.append(block[:, j].ravel())
            # a context of several texts is similar to itself, over all its unit windows
            lo = np.where(single, 1 << 30, SIDE - before[at])
            hi = np.where(single, -1, SIDE - before[at] + np.array([len(x) // 4 for x in context[at]]) - UNIT)
            root, links = np.arange(len(at)), []
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                apart = ~(single[i] & single[j] & (t[at][i] == t[at][j]))
                i, j = i[apart], j[apart]
                for k in range(0, len(i), 4096):
                    p, q = i[k:k + 4096], j[k:k + 4096]
                    ok, first, last = verify(m[p], filled[p], m[q], filled[q], least)
                    links.append((p[ok], q[ok]))
                    for side in links[-1]:
                        np.minimum.at(lo, side, first[ok])
                        np.maximum.at(hi, side, last[ok])
            if links:
                i, j = (np.concatenate(x) for x in zip(*links))
                was = None
                while was is None or (was != root).any():  # the least context that each one reaches
                    was = root.copy()
                    np.minimum.at(root, i, root[j])
                    np.minimum.at(root, j, root[i])
                    root = root[root]
            on = np.flatnonzero((hi >= 0)[of])
            if len(on):
                one = at[root[of[on]]]
                hub = mix(mix(sig[on].view(np.uint64)) + c[one].astype(np.uint64) + t[one].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(_members(t[on], c[on], lo[of[on]], hi[of[on]], hub), names=["t", "first", "last", "hub"])

    return found.repartition("sig").sortWithinPartitions("sig", "kind", "t", "c").mapInArrow(run, MEMBER)


def distinct_contexts(large: DataFrame) -> DataFrame:
    """The distinct contexts (kinds) of each signature, with their number of texts and their least and greatest window."""
    kinds = large.groupBy("sig", "kind").agg(F.countDistinct("t").alias("n"), F.min(F.struct("t", "c", "before", "context")).alias("one"), F.max(F.struct("t", "c")).alias("two"))
    return staged(kinds.select("sig", "kind", "n", "one.before", "one.context", F.struct("one.t", "one.c").alias("one"), "two"), "contexts")


def exact_ranges(kinds: DataFrame) -> DataFrame:
    """(hub, kind, first, last, least, most): the ranges of each distinct context, with a hash of their shingles as hub.

    ``first`` and ``last`` are those of the unit windows around the range, which share it and so are similar enough,
    in words from c; ``least`` and ``most`` are the context's texts. All windows of a context have its ranges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, kind, before, context, least, most = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            for a in range(0, len(sig), 2048):
                part = slice(a, a + 2048)
                m, filled = matrix(before[part], context[part])
                for at in range(0, SIDE + 1, STEP):
                    on = filled[:, at:at + RANGE].all(1)
                    h = sig[part][on].view(np.uint64) + np.uint64(at)
                    for k in range(at, at + RANGE):
                        h = (h ^ m[on, k]) * np.uint64(_PRIME)
                    left = SIDE - before[part][on].astype(np.int64)
                    right = left + filled[on].sum(1) - 1
                    first = np.maximum(at - STEP + 1, left) - SIDE
                    last = np.minimum(at + UNIT - 1, right) - SIDE + SHINGLE
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix(h).view(np.int64), kind[part][on], first, last, least[part][on], most[part][on])],
                                                     names=["hub", "kind", "first", "last", "least", "most"])

    plain = kinds.select("sig", "kind", "before", "context", F.col("one.t").alias("least"), F.col("two.t").alias("most"))
    return plain.mapInArrow(run, "hub long, kind long, first long, last long, least long, most long")


PAIR = ["t", "c", "before", "context", "kind", "t2", "c2", "before2", "context2", "kind2"]


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """Two MEMBER rows for each verified pair of windows, with the kinds of both."""
    least = need(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for a in range(0, batch.num_rows, 2048):
                t, c, before, context, kind, t2, c2, before2, context2, kind2 = (x[a:a + 2048] for x in cols)
                ok, first, last = verify(*matrix(before, context), *matrix(before2, context2), least)
                hub = mix(mix(t.view(np.uint64)) + c.astype(np.uint64)).view(np.int64)
                for x, y in ((t, c), (t2, c2)):
                    yield pa.RecordBatch.from_arrays([*_members(x[ok], y[ok], first[ok], last[ok], hub[ok]), *(pa.array(v[ok]) for v in (kind, kind2))],
                                                     names=["t", "first", "last", "hub", "kind", "kind2"])

    return pairs.select(*PAIR).mapInArrow(run, MEMBER + ", kind long, kind2 long")


def rarest(rank: np.ndarray, filled: np.ndarray, prefix: int) -> np.ndarray:
    """The filled cells that are among the ``prefix`` least of a whole unit window of their row, with their equals."""
    cells = np.zeros(filled.shape, bool)
    runs = np.lib.stride_tricks.sliding_window_view
    for a in range(0, len(rank), 512):
        part = slice(a, a + 512)
        limit = np.partition(runs(rank[part], UNIT, 1), prefix - 1, 2)[:, :, prefix - 1]
        limit = np.pad(np.where(runs(filled[part], UNIT, 1).all(2), limit, -1), ((0, 0), (SIDE, SIDE)), constant_values=-1)
        cells[part] = filled[part] & (rank[part] <= runs(limit, UNIT, 1).max(2))
    return cells


def likely_pairs(m: np.ndarray, filled: np.ndarray, root: np.ndarray, least: int, together: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different ``root``, the lesser root first, that share one of their rarest shingles.

    Two unit windows that share ``least`` shingles share one of the rarest UNIT - least + 1 of each, whatever the
    order of rarity is; it is the number of cells that hold a shingle. Some pairs may come twice.
    """
    owner = np.nonzero(filled)[0]
    value, of, n = np.unique(m[filled], return_inverse=True, return_counts=True)
    order = np.empty(len(value), np.int32)
    order[np.argsort(n, kind="stable")] = np.arange(len(value), dtype=np.int32)
    low, high = np.full(len(value), np.iinfo(np.int64).max), np.full(len(value), np.iinfo(np.int64).min)
    np.minimum.at(low, of, root[owner])
    np.maximum.at(high, of, root[owner])
    rank = np.zeros(m.shape, np.int32)
    rank[filled] = order[of]
    cells = rarest(rank, filled, UNIT - least + 1)[filled] & (low != high)[of]  # a shingle of one class alone brings nobody together
    key = np.unique(order[of][cells].astype(np.int64) * len(m) + owner[cells])
    shingle, row = key // len(m), key % len(m)
    partners = np.searchsorted(shingle, shingle, "right") - np.arange(len(key)) - 1
    total = np.cumsum(partners)
    at = 0
    while at < len(key):
        end = max(int(np.searchsorted(total, total[at] - partners[at] + together, "right")), at + 1)
        n = partners[at:end]
        left = np.repeat(np.arange(at, end), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        i, j = row[left], row[right]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        pair = np.unique(np.where(root[i] < root[j], i * len(m) + j, j * len(m) + i))
        yield pair // len(m), pair % len(m)
        at = end


def similar_kinds(classed: DataFrame, threshold: float, limit: int = 4096) -> DataFrame:
    """(kind, kind2, first, last): the similar contexts of a signature that are in different classes (root).

    A signature of up to ``limit`` contexts is one group, whose task pairs those that share a rare shingle and
    verifies them. The contexts of larger ones are dealt out by their rarest shingles, as two similar ones share one:
    rarity is then the number of a sample of contexts that hold a shingle, which any order may replace, so no pair is lost by it.
    """
    least = need(threshold)

    def of_group(table: pa.Table) -> pa.Table:
        kind, before, context, root = (table.column(x).to_numpy() for x in ("kind", "before", "context", "root"))
        m, filled = matrix(before, context)
        out: list[list] = [[np.empty(0, np.int64)] for _ in range(4)]
        for i, j in likely_pairs(m, filled, root, least):
            for a in range(0, len(i), 2048):
                p, q = i[a:a + 2048], j[a:a + 2048]
                ok, first, last = verify(m[p], filled[p], m[q], filled[q], least)
                for x, y in zip(out, (kind[p[ok]], kind[q[ok]], first[ok], last[ok])):
                    x.append(y)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["kind", "kind2", "first", "last"])

    def sampled(table: pa.Table) -> pa.Table:
        value, n = np.unique(np.frombuffer(b"".join(table.column("context").to_pylist()), "<u4"), return_counts=True)
        return pa.table({"sig": table.column("sig")[:1], "shingles": pa.array([value[n > 1].astype(np.int64)], pa.list_(pa.int64())), "counts": pa.array([n[n > 1]], pa.list_(pa.int64()))})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, before, context, root, sig = (left.column(x).to_numpy() for x in ("kind", "before", "context", "root", "sig"))
        m, filled = matrix(before, context)
        known, counts = (np.array(right.column(x)[0].as_py() if len(right) else [], np.int64) for x in ("shingles", "counts"))
        value, of = np.unique(m[filled], return_inverse=True)
        at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
        n = np.where(known[at] == value, counts[at], 0) if len(known) else np.zeros(len(value), np.int64)
        rank = np.zeros(m.shape, np.int64)
        rank[filled] = (n << 32 | value)[of]  # the same in every task
        row, place = np.nonzero(rarest(rank, filled, UNIT - least + 1))
        return pa.table({"sig": sig[row], "kind": kind[row], "root": root[row], "shingle": m[row, place].astype(np.int64)})

    plain = ["sig", "kind", "before", "context", "root"]
    sizes = classed.groupBy("sig").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    sizes = staged(sizes.select("sig", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "sizes")
    groups = classed.join(sizes.filter("parts = 1").select("sig", F.lit(0).alias("part")), "sig").select(*plain, "part")
    large = sizes.filter("parts > 1")
    if not large.isEmpty():
        kinds = classed.join(large, "sig")
        rank = F.row_number().over(Window.partitionBy("sig").orderBy("kind"))  # cut off on the map side
        sample = kinds.withColumn("rank", rank).filter(F.col("rank") <= max(limit // 4, 2)).groupBy("sig").applyInArrow(sampled, "sig long, shingles array<long>, counts array<long>")
        sample = sample.join(large, "sig").select("sig", "shingles", "counts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = kinds.withColumn("part", F.pmod("kind", "parts").cast("int"))
        rare = dealt.groupBy("sig", "part").cogroup(sample.groupBy("sig", "part")).applyInArrow(choose, "sig long, kind long, root long, shingle long")
        rare = staged(rare.distinct(), "rare")
        both = rare.groupBy("sig", "shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("sig", "shingle")
        met = rare.join(both, ["sig", "shingle"], "left_semi").join(large, "sig")
        met = met.select("kind", F.pmod(F.xxhash64("shingle"), 4 * F.col("parts")).cast("int").alias("part")).distinct()
        groups = groups.unionByName(kinds.select(*plain).join(met, "kind"))
    return groups.groupBy("sig", "part").applyInArrow(of_group, "kind long, kind2 long, first long, last long").distinct()


def across_kinds(large: DataFrame, kinds: DataFrame, exact: DataFrame, threshold: float, leaders: int = 4) -> DataFrame:
    """MEMBER rows of windows of large groups by comparing the distinct contexts (kinds) of each signature.

    All kinds meet the most frequent ones first: an edited copy is near the text that most others still
    have. Then kinds that neither this nor a shared exact range (``exact``) has brought into one class are
    compared where they share a rare shingle, and only those found similar are joined with their windows. A kind of one text stands for all its windows; one of several
    texts is compared once, as its windows share all their ranges anyway.
    """
    # Ranks are cut off on the map side, so a signature's window sees a few rows of each task.
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("n"), "one.t", "one.c"))
    first = kinds.withColumn("rank", rank).filter(F.col("rank") <= leaders).drop("rank")
    plain = ["sig", "kind", "t", "c", "before", "context"]
    single = large.join(kinds.filter("n = 1").select("kind"), "kind", "left_semi").select(*plain)
    rows = staged(single.unionByName(kinds.filter("n > 1").select("sig", "kind", "one.t", "one.c", "before", "context")), "kinds")

    def beside(left: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
        """Windows with the contexts of other texts; of two texts that have it one is not the window's own."""
        other = some.select(*on, *[F.col(x).alias(x + "2") for x in ("kind", "before", "context")], "one", "two")
        pairs = left.join(other, on).filter("kind <> kind2").withColumn("at", F.when(F.col("one.t") == F.col("t"), F.col("two")).otherwise(F.col("one")))
        return pairs.withColumns({"t2": F.col("at.t"), "c2": F.col("at.c")}).filter("t <> t2")

    led = staged(compared(beside(rows, first, ["sig"]), threshold), "led")
    found = led.select("t", "first", "last", "hub")
    links = exact.select(F.col("kind").alias("a"), F.col("hub").alias("b")).unionByName(led.select(F.col("kind").alias("a"), F.col("kind2").alias("b"))).distinct()
    roots = components(links).select(F.col("node").alias("kind"), "root")
    classed = staged(kinds.select("sig", "kind", "before", "context").join(roots, "kind", "left").withColumn("root", F.coalesce("root", "kind")), "classes")
    pairs = staged(similar_kinds(classed, threshold), "pairs")
    rest = rows.join(pairs, "kind").join(kinds.select(F.col("kind").alias("kind2"), "one", "two"), "kind2")
    rest = rest.withColumn("at", F.when(F.col("one.t") == F.col("t"), F.col("two")).otherwise(F.col("one")))
    rest = rest.withColumns({"t2": F.col("at.t"), "c2": F.col("at.c"), "hub": F.xxhash64("t", "c", F.lit("rest"))}).filter("t <> t2")

    def member(t: str, c: str) -> Column:
        return F.struct(F.col(t).alias("t"), (F.col(c) - SIDE + F.col("first")).alias("first"), (F.col(c) - SIDE + F.col("last") + PASSAGE).alias("last"), "hub")

    return found.unionByName(staged(rest.select(F.inline(F.array(member("t", "c"), member("t2", "c2")))), "rest"))


def repeated_passages(docs: DataFrame, threshold: float = 0.8, hashes: int = 3, group: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start_word, end_word, class_id): the maximal runs of words that lie in near-duplicate passages of other documents.

    Words are runs of letters, digits and characters beyond ASCII, lower-cased (A-Z); ``end_word`` is
    exclusive. ``class_id`` is the least id that a passage reaches over near-duplicate passages. A text
    of at least fifty words that stands in several rows is a passage as a whole. Null, empty and shorter
    texts have no passages; repeats inside one text do not count. Rows that share an id are looked at
    one by one and reported under it; ids that are null are reported, but name no class unless all are.
    Other columns are left out, so their names cannot clash. Texts are told apart by a 64-bit hash.

    Copies of a text are worked on once and joined at the end, where a text with very many rows is a
    join key like any other that adaptive execution splits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    shared = staged(shared_windows(text_windows(rows, hashes)), "windows")
    texts_of = rows.select("t", "text")
    windows = shared.filter("near >= 0")
    hot = staged(windows.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("sig"), "hot")
    members = group_windows(contexts(texts_of, windows.join(hot, "sig", "left_anti")), threshold, group)
    members = staged(members, "groups").unionByName(shared.filter(f"near < 0 AND near <> {WHOLE}").select("t", F.col("c").alias("first"), (F.col("c") - F.col("near") + SHINGLE - 1).alias("last"), F.col("sig").alias("hub")))
    large = contexts(texts_of, windows.join(hot, "sig", "left_semi")).dropDuplicates(["sig", "t", "c", "kind"])
    large = large if hot.isEmpty() else staged(large, "large")
    if not hot.isEmpty():
        kinds = distinct_contexts(large)
        ranges = staged(exact_ranges(kinds), "ranges")
        both = ranges.groupBy("hub").agg(F.min("least").alias("a"), F.max("most").alias("b")).filter("a <> b").select("hub")
        exact = staged(ranges.join(both, "hub", "left_semi").select("hub", "kind", "first", "last"), "exact")
        # A window's shared ranges all reach c, so they are one passage; the context brings it to their hubs.
        reach = exact.groupBy("kind").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        reach = large.select("t", "c", "kind").join(reach, "kind").select("t", (F.col("c") + F.col("first")).alias("first"), (F.col("c") + F.col("last")).alias("last"), F.col("kind").alias("hub"))
        members = members.unionByName(reach).unionByName(across_kinds(large, kinds, exact, threshold))
    texts = staged(rows.groupBy("t").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "texts")
    words = shared.filter(f"near = {WHOLE}").groupBy("t").agg(F.min("c").alias("words"))
    copies = texts.filter("copies > 1").join(words, "t")
    members = members.unionByName(copies.select("t", F.lit(0).cast("long").alias("first"), F.col("words").alias("last"), F.xxhash64("t", F.lit("copies")).alias("hub")))
    members = staged(members.groupBy("t", "first", "hub").agg(F.max("last").alias("last")), "members")

    order = Window.partitionBy("t").orderBy("first", "last")  # of one text
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = members.withColumn("new", F.when(reach.isNull() | (reach < F.col("first")), 1).otherwise(0))
    marked = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = staged(marked.select("t", "first", "last", "hub", F.xxhash64("t", "n").alias("node")), "marked")
    passages = marked.groupBy("t", "node").agg(F.min("first").alias("start_word"), F.max("last").alias("end_word"))
    links = marked.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = components(links if hot.isEmpty() else links.unionByName(exact.select(F.col("kind").alias("a"), F.col("hub").alias("b"))))
    classed = passages.join(roots, "node").join(texts.select("t", "least"), "t")
    names = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    out = staged(classed.join(names, "root").select("t", "start_word", "end_word", "class_id"), "passages")
    return rows.select("id", "t").join(out, "t").select(F.col("id").alias(id_col), "start_word", "end_word", "class_id")
