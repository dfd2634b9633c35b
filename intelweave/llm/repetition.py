"""Repetition rules from a suffix array over the words of a text.

The suffixes of all texts of a chunk are sorted together by prefix doubling (numpy, only the groups
that are not yet single), text by text since the text's number leads the key. Longest common prefixes
of neighbours give, for each word, the longest string from there that occurs again in its text; these
are the right-maximal members of the array's longest-common-prefix intervals. The union of their spans
and the longest of them are what the rules limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "covered double, longest_repeat long, kept boolean")
# Fixed values of the base rules.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
CHUNK_WORDS = 200_000


def longest_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word string from there that stands elsewhere in its text.

    ``words`` are the numbered words of all texts in a row, ``sizes`` the texts' lengths.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    _, rank, count = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    # Of each group, the place of its first suffix; a level is kept for each doubling, so in as few bytes as will do.
    rank = (np.cumsum(count) - count)[rank].astype(np.int32 if n < 2**31 - 1 else np.int64)
    levels, h = [rank], 1
    live = np.flatnonzero(count[np.searchsorted(np.cumsum(count), rank, "right")] > 1)
    while len(live):
        behind = live + h
        second = np.where(behind < end[live], rank[np.minimum(behind, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        old = rank[live]
        fresh = np.append(True, (old[1:] != old[:-1]) | (second[1:] != second[:-1]))
        group = np.append(True, old[1:] != old[:-1])
        at = np.arange(len(live))
        new = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[live] = new
        levels.append(rank)
        single = fresh & np.append(fresh[1:], True)
        live = live[~single]
        h *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1].copy(), array[1:].copy()
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    common, end_a, end_b = np.zeros(len(pair), np.int64), end[a], end[b]
    for k in range(len(levels) - 1, -1, -1):
        rank, step = levels[k], 1 << k
        fits = (a + step <= end_a) & (b + step <= end_b)
        same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a, b, common = a + same * step, b + same * step, common + same * step
    both = np.zeros(n + 1, np.int64)
    both[pair + 1] = common
    longest = np.empty(n, np.int64)
    longest[array] = np.maximum(both[:-1], np.append(both[1:-1], 0)) if n > 1 else 0
    return longest


def covered(longest: np.ndarray, least: int, whole: bool) -> np.ndarray:
    """Words inside a repeated string of ``least`` words or more: of its whole span, or of its first ``least``."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (longest[at] if whole else least), -1)
    return np.cumsum(edge[:-1]) > 0


def plain_counts(text: str) -> tuple[int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def judge(texts: list[str], least: int, share: float, limit: int, limit_share: float, most: int) -> pd.DataFrame:
    codes: dict[bytes, int] = {}
    rows, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six spaces
        sizes.append(len(words))
        rows.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
    sizes = np.array(sizes, np.int64)
    longest = longest_repeats(np.concatenate(rows), sizes)
    upto = np.append(0, np.cumsum(sizes))

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[upto[1:]] - sums[upto[:-1]]

    some = sizes > 0
    top = np.zeros(len(sizes), np.int64)
    if some.any():
        top[some] = np.maximum.reduceat(longest, upto[:-1][some])
    out = pd.DataFrame([plain_counts(t) for t in texts], columns=["word_chars", "n_symbols", "n_dup_lines"])
    out.insert(0, "n_words", sizes)
    out["n_repeat_words"] = per_text(covered(longest, WINDOW, False))
    out["base_failed"] = (out.n_words < LEAST_WORDS) | (100 * out.n_repeat_words > REPEAT_PERCENT * out.n_words)
    out["covered"] = per_text(covered(longest, least, True)) / np.maximum(sizes, 1)
    out["longest_repeat"] = top
    out["kept"] = ~out.base_failed & (out.covered <= share) & ~((top > limit) & (top > limit_share * sizes)) & (top <= most)
    return out


def judge_column(text: Column, least: int = 10, share: float = 0.2, limit: int = 50, limit_share: float = 0.08, most: int = 200) -> Column:
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > 6 * CHUNK_WORDS:
                out.append(judge(some, least, share, limit, limit_share, most))
                some, size = [], 0
        if some:
            out.append(judge(some, least, share, limit, limit_share, most))
        return pd.concat(out, ignore_index=True)

    return run(F.coalesce(text, F.lit("")))


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: counts, share of words in repeats of ``least`` words or more, longest repeat, verdict.

    A text fails if the base rules fail it, if more than ``share`` of its words lie in repeats of
    ``least`` words or more, if its longest repeat has over ``limit`` words and over ``limit_share``
    of the text, or over ``most`` words in a text of any length. Null and empty texts have no words and fail. Repeated rows and null ids stay as they
    are; other columns are left out, so their names cannot clash.
    """
    verdict = judge_column(F.col(text_col), **limits)
    return docs.select(F.col(id_col).alias("id"), verdict.alias("found")).select(F.col("id").alias(id_col), "found.*")
