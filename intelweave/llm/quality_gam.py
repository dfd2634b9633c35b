"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Boosting goes round the features in a
cycle: one shallow tree on one feature at a time, fitted to the current gradients and added, damped,
to that feature's lookup table. Pairs that explain most of what is left get two-way tables in the same
manner. A score is the sum of one table entry per feature and pair, through the logistic function.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["log_chars", "log_words", "word_length", "upper", "symbols", "bangs", "pipes", "digits", "stops", "other_marks",
            "unique_words", "twin_words", "line_words", "twin_lines", "beyond_ascii"]
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_HIGH = bytes(range(0x80, 0x100))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())


def features_of(text: str) -> tuple[float, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    size, words = max(len(raw), 1), raw.split()
    n = max(len(words), 1)

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols, bangs, pipes, stops = share(b"#*$%&"), share(b"!"), share(b"|<>"), share(b".,;:?")
    return (
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, share(_UPPER), symbols, bangs, pipes, share(_DIGITS), stops,
        share(_MARKS) - symbols - bangs - pipes - stops, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
        n / max(len(lines), 1), (len(lines) - len(set(lines))) / max(len(lines), 1), share(_HIGH))


@dataclass
class GamModel:
    """Bin edges and lookup tables; ``score`` adds one entry of each."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for j, k, table in self.pairs:
            total += table[bins[:, j], bins[:, k]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.bins(x)))) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree on one feature's bins: greedy best cuts of the gradient sums; the leaf value of each bin."""
    bounds = [0, len(g)]
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best, place = 1e-9, None
        for a, b in zip(bounds, bounds[1:]):
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            gl, hl, gr, hr = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[cut], ch[b] - ch[cut]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (cg[b] - cg[a])**2 / (ch[b] - ch[a] + 1)
            gain[(hl < least) | (hr < least)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, place = gain[i], int(cut[i])
        if place is None:
            break
        bounds = sorted([*bounds, place])
    out = np.empty(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """One cut on the rows, then one on the columns of each side: the value of each cell, and the gain."""
    best, out = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        cells, gain = np.empty_like(g), 0.0
        for part in (slice(0, cut), slice(cut, None)):
            cg, ch = g[part].sum(0), h[part].sum(0)
            row = _tree(cg, ch, 2, least)
            cells[part] = row
            gain += float((row * cg).sum())
        if gain > best:
            best, out = gain, cells
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, leaves: int = 3, pairs: int = 4, pair_rounds: int = 30,
        least: float = 2.0) -> GamModel:
    """Fit to rows ``x`` and 0/1 labels ``y``. One class only, or no rows: a constant that says so."""
    width = len(FEATURES)
    rate0 = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for j in range(width)]
    model = GamModel(edges, float(np.log(rate0 / (1 - rate0))), [np.zeros(len(e) + 1) for e in edges])
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    raw = model.raw(b)

    def sums() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = sums()
                step = rate * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)), leaves, least)
                table += step
                raw += step[b[:, j]]

    def cells(j: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[j]), len(model.tables[k]))
        flat = b[:, j] * shape[1] + b[:, k]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = sums()
    gains = [(_pair_tree(*cells(j, k, g, h), least)[1], j, k) for j in range(width) for k in range(j + 1, width)]
    model.pairs = [(j, k, np.zeros((len(model.tables[j]), len(model.tables[k])))) for gain, j, k in sorted(gains, reverse=True)[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for j, k, table in model.pairs:
            g, h = sums()
            step = rate * _pair_tree(*cells(j, k, g, h), least)[0]
            table += step
            raw += step[b[:, j], b[:, k]]
    return model


def features_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(features_of)

    return features(text)


def labelled_features(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """One (id, label, features) row for at most ``max_rows`` labelled ids outside the held-out fold.

    The ids are the first ones in the order of a hash. An id with both labels counts as 0; an id that
    stands in several documents counts once. The join's small side has at most ``max_rows`` rows.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("id", "label", features_column(F.col("text")).alias("x"))
    return rows.groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x"))


def held_out(id_column: Column) -> Column:
    """One fold in five, by the crc32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **params) -> GamModel:
    """Fit on a bounded sample: at most ``max_rows`` rows of fifteen numbers reach the driver."""
    rows = labelled_features(docs, labels, max_rows, id_col, text_col, label_col).orderBy("id").select("label", "x").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float), **params)


def score_column(text: Column, model: GamModel) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features_of(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, model: GamModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: fold, score between 0 and 1, and whether it reaches ``threshold``.

    Only the text is looked at. Null and empty texts are scored like any other; repeated rows and null
    ids stay as they are; other columns are left out, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), score_column(F.col(text_col), model).alias("score"))
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
