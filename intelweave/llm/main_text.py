"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block becomes a vector: learned vectors of its element and of its
tag path (tags and the words of classes, ids and roles, hashed), the mean of learned vectors of its hashed
words, and a few numbers. A bidirectional LSTM reads the whole sequence both ways and labels every block in
the light of all others. It is trained on the driver from a bounded sample of pages: as they are where they
name their article by an element, and their texts in drawn layouts (``page_layouts``). Pages are then parsed
and labelled in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intelweave.llm import page_layouts
from intelweave.llm.html_blocks import Paths, blocks_of
from intelweave.llm.recurrent import Adam, Labeller

NAME_SLOTS, WORD_SLOTS = 1 << 11, 1 << 12
OWN, PATH, WORD, NUMBERS = 8, 16, 8, 10
UNITS = 20
_TOGETHER = 4_000_000  # characters of pages worked on at a time, unless one page has more
_WORDS = 200_000  # slots of words that a worker keeps

Block = tuple[str, int, int]


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _WORDS:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
        return h


_SLOTS = _Slots()


@dataclass
class Features:
    """Blocks of pages in flat arrays: path nodes, word slots with their bounds, numbers."""

    node: np.ndarray
    words: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray


def numbers_of(text: str, words: list[str], links: int, place: float) -> tuple[float, ...]:
    n, k = len(text), len(words)
    return (np.log1p(n) / 5, np.log1p(k) / 4, links / n, float(text[-1] in ".!?…。\"”»"), text.count(",") / k, min(text.count(".") / k, 1.0),
            sum(map(text.count, "0123456789")) / n, sum(w[0].isupper() for w in words) / k, place, float(k < 4))


def features(pages: list[list[Block]]) -> Features:
    node, words, ends, numbers = [], [], [], []
    for blocks in pages:
        for i, (text, at, links) in enumerate(blocks):
            found = text.split()
            node.append(at)
            words.extend(map(_SLOTS.__getitem__, text.lower().split()))
            ends.append(len(words))
            numbers.append(numbers_of(text, found, links, i / len(blocks)))
    return Features(np.array(node, np.int64), np.array(words, np.int64), np.array(ends, np.int64), np.array(numbers, np.float32).reshape(-1, NUMBERS))


def _slots(tokens: tuple[str, ...]) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % NAME_SLOTS for t in tokens]


def _sums(table: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of table rows ``at`` up to each of ``ends``; every stretch holds one at least."""
    return np.add.reduceat(table[at], np.append(0, ends[:-1]), 0) if len(ends) else np.zeros((0, table.shape[1]), table.dtype)


@dataclass
class Example:
    """A training page: its features with the name slots of each block's element and whole path, and labels."""

    f: Features
    own: np.ndarray
    own_ends: np.ndarray
    path: np.ndarray
    path_ends: np.ndarray
    y: np.ndarray


def example(blocks: list[Block], labels: list[int], paths: Paths) -> Example:
    own, path, own_ends, path_ends = [], [], [], []
    for _, node, _ in blocks:
        # text outside of any element has the name of nothing
        own.extend(_slots(paths.tokens[node] or ("",)))
        path.extend(_slots(("",)) if not node else [])
        while node:
            path.extend(_slots(paths.tokens[node]))
            node = paths.parent[node]
        own_ends.append(len(own))
        path_ends.append(len(path))
    return Example(features([blocks]), *(np.array(x, np.int64) for x in (own, own_ends, path, path_ends)), np.array(labels, np.float32))


def joined(parts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Bounds of several arrays as bounds of all of them in a row."""
    return np.concatenate([p + s for p, s in zip(parts, np.cumsum([0, *sizes[:-1]]))])


class BlockLabeller:
    """Tables of name and word vectors in front of the recurrent labeller."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.net = Labeller(OWN + PATH + WORD + NUMBERS, UNITS, seed)
        self.tables = {"own": rng.standard_normal((NAME_SLOTS, OWN)).astype(np.float32) * 0.3, "path": rng.standard_normal((NAME_SLOTS, PATH)).astype(np.float32) * 0.3,
                       "word": rng.standard_normal((WORD_SLOTS, WORD)).astype(np.float32) * 0.1}

    def scores(self, pages: list[list[Block]], paths: Paths) -> list[np.ndarray]:
        """Probability of each block of each page to belong to the main text."""
        own = np.zeros((len(paths.parent), OWN), np.float32)
        path = np.zeros((len(paths.parent), PATH), np.float32)
        own[0], path[0] = self.tables["own"][_slots(("",))].sum(0), 0
        for i in range(1, len(own)):  # parents stand before their children
            slots = _slots(paths.tokens[i])
            own[i] = self.tables["own"][slots].sum(0)
            path[i] = path[paths.parent[i]] + self.tables["path"][slots].sum(0)
        path[0] = self.tables["path"][_slots(("",))].sum(0)
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        lengths = np.array([len(pages[i]) for i in order], np.int64)
        f = features([pages[i] for i in order])
        x = np.hstack([own[f.node], np.tanh(path[f.node]), self._means(f), f.numbers])
        logit, _ = self.net.forward(x, lengths[lengths > 0])
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        for i, part in zip(order, np.split(p, np.cumsum(lengths)[:-1])):
            out[i] = part
        return out

    def _means(self, f: Features) -> np.ndarray:
        return _sums(self.tables["word"], f.words, f.ends) / np.diff(f.ends, prepend=0)[:, None]

    def fit(self, pages: list[Example], epochs: int = 16, batch: int = 32, rate: float = 0.012, seed: int = 5) -> None:
        """Adam on the log-loss of all blocks; a tenth of the inputs is left out at random, so that none is relied on alone."""
        rng = np.random.default_rng(seed)
        adam = Adam(self.net.p | self.tables, rate)
        pages = [p for p in pages if len(p.y)]
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 5e-4
            # batches of pages of like length, drawn in any order
            order = np.argsort([len(p.y) + rng.random() * 8 for p in pages])[::-1]
            cut = np.array_split(order, max(len(order) // batch, 1))
            for k in rng.permutation(len(cut)):
                self._step(adam, sorted((pages[i] for i in cut[k]), key=lambda p: -len(p.y)), rng)

    def _step(self, adam: Adam, some: list[Example], rng: np.random.Generator) -> None:
        own, path = np.concatenate([p.own for p in some]), np.concatenate([p.path for p in some])
        own_ends, path_ends = joined([p.own_ends for p in some], [len(p.own) for p in some]), joined([p.path_ends for p in some], [len(p.path) for p in some])
        f = Features(np.empty(0), np.concatenate([p.f.words for p in some]), joined([p.f.ends for p in some], [len(p.f.words) for p in some]), np.concatenate([p.f.numbers for p in some]))
        reach = np.tanh(_sums(self.tables["path"], path, path_ends))
        y = np.concatenate([p.y for p in some])
        mask = (rng.random((len(y), OWN + PATH + WORD + NUMBERS)) > 0.1).astype(np.float32)
        x = np.hstack([_sums(self.tables["own"], own, own_ends), reach, self._means(f), f.numbers]) * mask
        logit, state = self.net.forward(x, np.array([len(p.y) for p in some]), keep=True)
        grads, dx = self.net.gradients(x, (1 / (1 + np.exp(-logit)) - y) / len(y), state)
        dx = dx * mask
        n = np.diff(f.ends, prepend=0)
        spread = {"own": (own, dx[:, :OWN], np.diff(own_ends, prepend=0)), "path": (path, dx[:, OWN:OWN + PATH] * (1 - reach * reach), np.diff(path_ends, prepend=0)),
                  "word": (f.words, dx[:, OWN + PATH:OWN + PATH + WORD] / n[:, None], n)}
        for name, (at, d, times) in spread.items():
            d = np.repeat(d, times, 0)
            grads[name] = np.stack([np.bincount(at, d[:, j], len(self.tables[name])) for j in range(d.shape[1])], 1).astype(np.float32)
        adam.step(grads)


_BESIDES = {"nav", "aside", "header", "footer", "form", "menu"}
_NAMED = {"." + w for w in [*page_layouts.NOTICE, *page_layouts.ADVERT, *page_layouts.COMMENTS, *page_layouts.SIDE, *page_layouts.MENU, *page_layouts.FORM]}


def weak_labels(blocks: list[Block], paths: Paths) -> list[int] | None:
    """1 for blocks inside an article element and nothing besides it; null where a page has no such element."""
    inside, besides = [False] * len(paths.parent), [False] * len(paths.parent)
    for i in range(1, len(inside)):
        tokens = paths.tokens[i]
        inside[i] = inside[paths.parent[i]] or tokens[0] in ("article", "main")
        besides[i] = besides[paths.parent[i]] or tokens[0] in _BESIDES or not _NAMED.isdisjoint(tokens[1:])
    labels = [int(inside[node] and not besides[node]) for _, node, _ in blocks]
    return labels if any(labels) else None


def train(pages: DataFrame, max_pages: int = 300, max_chars: int = 60_000, drawn: int = 1800, url_col: str = "url", html_col: str = "html") -> BlockLabeller:
    """Fit a labeller from at most ``max_pages`` pages of at most ``max_chars`` characters, those whose urls have the least hashes.

    ``drawn`` more pages carry the sample's texts in drawn layouts, or made-up words where there are none;
    so an empty table, or one of null pages, gives a labeller too.
    """
    rows = pages.filter((F.length(html_col) <= max_chars) & F.col(html_col).contains("<")).select(F.xxhash64(url_col).alias("h"), F.col(html_col).alias("html"))
    least = rows.select("h").distinct().orderBy("h").limit(max_pages)
    bound = least.agg(F.max("h")).first()[0]
    sample = [] if bound is None else [r["html"] for r in rows.filter(F.col("h") <= bound).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()]

    paths, seen, texts = Paths(), [], []
    for html in sample:
        blocks = blocks_of(html, paths)
        weak = weak_labels(blocks, paths)
        if weak is not None:
            seen += [example(blocks, weak, paths)] * 2
        texts.extend(t for (t, _, _), keep in zip(blocks, weak or [1] * len(blocks)) if keep)
    dresser = page_layouts.Dresser(texts[:5000], 3)
    for _ in range(drawn):
        seen.append(example(*page_layouts.labelled(dresser.page(), paths), paths))
    model = BlockLabeller()
    model.fit(seen)
    return model


def extract(pages: DataFrame, model: BlockLabeller, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, url, text, n_blocks, n_kept) for each row of ``pages``.

    The text holds the kept blocks in page order with an empty line between them. A null or empty page, and
    one without a block of main text, has an empty text. Broken markup is read as far as it goes; pages of any
    length are labelled whole. Null urls and ids and repeated rows stay as they are. Other columns are left
    out, so their names cannot clash; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size, under a megabyte
    schema = f"id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_blocks long, n_kept long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            html = batch.column(2).to_pylist()
            while at < len(html):
                until, size = at, 0
                while until < len(html) and (until == at or size + len(html[until] or "") <= _TOGETHER):
                    size += len(html[until] or "")
                    until += 1
                paths = Paths()
                blocks = [blocks_of(h or "", paths) for h in html[at:until]]
                texts, kept = [], []
                for found, p in zip(blocks, shared.value.scores(blocks, paths)):
                    keep = [t for (t, _, _), s in zip(found, p.tolist()) if s >= threshold]
                    texts.append("\n\n".join(keep))
                    kept.append(len(keep))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, until - at), batch.column(1).slice(at, until - at), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, blocks)), pa.int64()), pa.array(kept, pa.int64())], names=["id", "url", "text", "n_blocks", "n_kept"])
                at = until

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
