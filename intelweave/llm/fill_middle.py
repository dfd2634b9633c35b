"""Fill-in-the-middle transformation: texts cut at unit ends found by word-parallel byte arithmetic.

A unit is a run of white space with the run of other characters behind it; white space at a text's end
is a unit of its own. White space is ASCII, so units end at bytes and UTF-8 need not be decoded. The
bytes of a whole batch of texts are viewed as 64-bit words. Eight bytes at a time, additions mark white
space in each byte's top bit, a shift finds bytes whose successor is white space, and the marks of unit
ends are counted by ``bitwise_count``. A running sum over the words answers "how many units end before
this byte" and, by binary search, "in which word does the k-th unit end"; a multiplication by
0x0101… then gives the running counts inside that word, and comparing them all at once selects the byte.
No loop runs over characters or units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"
_SLICE = 1 << 24  # bytes of text worked on at a time, unless one text has more

_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_LOWS = np.uint64(0x7F7F7F7F7F7F7F7F)
_SPACES = np.uint64(0x2020202020202020)
_FROM_TAB = np.uint64(0x7777777777777777)  # added to a byte below 128, carries into the top bit from 9 on
_PAST_RETURN = np.uint64(0x7272727272727272)  # the same from 14 on
_7, _8, _56 = np.uint64(7), np.uint64(8), np.uint64(56)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with a word of zeros at least behind them."""
    out = np.zeros(len(data) // 8 + 2, "<u8")
    out.view(np.uint8)[:len(data)] = data
    return out


def space_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a blank or one of 9 to 13."""
    low = words & _LOWS
    other = (low ^ _SPACES) + _LOWS
    return ((low + _FROM_TAB & ~(low + _PAST_RETURN)) | ~other) & ~words & _TOPS


def end_marks(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The top bit of each byte that ends a unit; ``last`` holds the places of the texts' last bytes."""
    space = space_marks(words)
    behind = space >> _8
    behind[:-1] |= space[1:] << _56
    ends = ~space & behind & _TOPS
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << (last.astype(np.uint64) & _7) * _8)
    return ends


def first_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that begins a code point."""
    return ~(words & ~(words << np.uint64(1))) & _TOPS


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, inside = at >> 3, (at & 7).astype(np.uint64) * _8
        below = self.marks[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the ``k``-th marked byte, from 1."""
        word = np.searchsorted(self.upto, k, "left")
        nth = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(np.uint64)
        counts = (self.marks[word] >> _7) * _ONES  # in each byte, the marks up to it
        reached = ((counts | _TOPS) - nth * _ONES) & _TOPS
        return word * 8 + 8 - np.bitwise_count(reached)


def cut_texts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, the two cuts as byte places, and the code points before and between them.

    ``data`` holds the texts' bytes in a row, ``offsets`` their bounds, ``h1`` and ``h2`` two random
    numbers for each text, whose remainders by one more than its units say behind how many to cut.
    """
    words, start, end = as_words(data), offsets[:-1], offsets[1:]
    ends = Marks(end_marks(words, end[end > start] - 1))
    before = ends.rank(start)
    n = ends.rank(end) - before
    low, high = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), 0)
    if not len(ends.upto) or not ends.upto[-1]:
        cuts = [start, start]
    else:
        cuts = [np.where(k > 0, ends.select(np.maximum(before + k, 1)) + 1, start) for k in (low, high)]
    points = Marks(first_marks(words))
    first, second, third = (points.rank(x) for x in (start, *cuts))
    return n, cuts[0], cuts[1], second - first, third - second


def draws(id_col: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of an id: the first groups of sha256(``seed:id``); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(digest), lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))[0]


def transform_texts(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    ``n`` units; ``form`` is ``plain`` (the output is the text), ``psm`` (``<P>`` prefix ``<S>`` suffix
    ``<M>`` middle) or ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). ``rate`` texts of a hundred
    are cut, ``spm_rate`` of a hundred of those in the form spm; draws depend on the id alone, so rows with
    one id draw alike and any partitioning gives the same rows. Null and empty texts, and texts that hold a
    mark already, are plain; where plain, the two counts are null. A null id draws as an empty one. Texts of
    any length are cut whole. Other columns are left out, so their names cannot clash; an empty table gives
    no rows. Every row is worked on by itself: nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), draws(F.col(id_col), seed).alias("h"))
    id_field = docs.schema[id_col]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        h = part.column(2).flatten().to_numpy().reshape(-1, 4)
        n, a, b, prefix, middle = cut_texts(data, offsets, h[:, 0], h[:, 1])
        raw, forms, out = data.tobytes(), [], []
        cut = (h[:, 2] % 100 < rate) & (n > 0)
        spm = h[:, 3] % 100 < spm_rate
        for i, (s, x, y, e) in enumerate(zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist())):
            text = raw[s:e]
            if not cut[i] or any(m in text for m in marks):
                forms.append("plain")
                out.append(text)
                continue
            p, m, t = raw[s:x], raw[x:y], raw[y:e]
            forms.append("spm" if spm[i] else "psm")
            out.append(b"".join([marks[1], t, marks[0], p, marks[2], m] if spm[i] else [marks[0], p, marks[1], t, marks[2], m]))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain),
             pa.array(out, pa.binary()).cast(pa.string())],
            names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            reach = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SLICE, "right")))
                yield work(batch.slice(at, until - at))
                at = until

    out = rows.mapInArrow(run, f"id {id_field.dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transform_texts` was made from."""
    def between(text: Column, left: str, right: str) -> Column:
        return F.substring_index(_behind(text, left), right, 1)

    psm = F.concat(between(output, PREFIX, SUFFIX), _behind(output, MIDDLE), between(output, SUFFIX, MIDDLE))
    spm = F.concat(between(output, PREFIX, MIDDLE), _behind(output, MIDDLE), between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _behind(text: Column, mark: str) -> Column:
    """What follows the only ``mark`` of a text."""
    return F.substring_index(text, mark, -1)
