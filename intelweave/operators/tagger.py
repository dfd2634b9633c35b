"""A name tagger trained here: a linear-chain structured perceptron over hashed word features.

Training is iterative parameter mixing. In each round every shard starts from the same weights, makes one
averaged-perceptron pass over its own sentences (decode with the weights so far, then add the features of
the right tags and take away those of the decoded ones), and reports how its weights changed; the changes
are averaged by one aggregate, and the next round starts from there. Weights have a fixed number of slots,
however large the corpus; sentences never leave their shard. Decoding is Viterbi over Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.operators import bio as B

SLOTS = 1 << 17
PER_SHARD = 500  # sentences
_WORDS = 300_000  # word types that a worker keeps the slots of
_FORBIDDEN = np.float32(-1e9)


def shape_of(word: str) -> str:
    """Classes of characters, runs of one class as one: ``APT29`` is ``A0``."""
    out = ""
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out.endswith(kind):
            out += kind
    return out


def _slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SLOTS


class _WordSlots(dict):
    """For each word the slots of its own features, and of it as a neighbour before and behind."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _WORDS:
            self.clear()
        low, shape = word.lower(), shape_of(word)
        own = (f"w={low}", f"p={low[:3]}", f"s={low[-3:]}", f"h={shape}", f"n={min(len(word), 9)}")
        self[word] = out = tuple(map(_slot, (*own, f"-w={low}", f"-h={shape}", f"+w={low}", f"+h={shape}")))
        return out


_OWN, _BEFORE, _BEHIND = slice(0, 5), slice(5, 7), slice(7, 9)
_KNOWN = _WordSlots()
_EDGE = _KNOWN[""]


def _table(words: list[str]) -> np.ndarray:
    """Slots (words x 9) of words as tokens and as neighbours; the last row is the edge of a sentence."""
    return np.fromiter(chain.from_iterable(chain(map(_KNOWN.__getitem__, words), [_EDGE])), np.int64, (len(words) + 1) * len(_EDGE)).reshape(-1, len(_EDGE))


def _around(lengths: np.ndarray, number: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words before and behind each token, ``edge`` at a sentence's ends."""
    ends = np.cumsum(lengths)[lengths > 0]
    before, behind = np.append(edge, number[:-1])[:len(number)], np.append(number[1:], edge)[:len(number)]
    behind[ends - 1] = edge
    before[(ends - lengths[lengths > 0])] = edge
    return before, behind


def _pairs(own: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the pairs with the words before and behind, from the slots of the words themselves."""
    return (before * 31 + own * 7 + 1) % SLOTS, (behind * 37 + own * 11 + 2) % SLOTS


def feature_slots(sentences: list[list[str]]) -> np.ndarray:
    """Slots (tokens x features) of all sentences in a row: the word, its neighbours, both word pairs, and a constant."""
    words = [w for s in sentences for w in s]
    table = _table(words)
    number = np.arange(len(words))
    at_before, at_behind = _around(np.array([len(s) for s in sentences], np.int64), number, len(words))
    own, before, behind = table[number][:, _OWN], table[at_before][:, _BEFORE], table[at_behind][:, _BEHIND]
    pairs = np.stack(_pairs(own[:, 0], before[:, 0], behind[:, 0]), 1)
    return np.hstack([own, before, behind, pairs, np.full((len(words), 1), SLOTS - 1)])


def token_scores(weights: np.ndarray, words: list[str], number: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``weights[feature_slots].sum(1)`` of tokens given as numbers of different ``words``, which are looked up once.

    Features are added in the same order, so that sums round alike.
    """
    table = _table(words)
    before, behind = _around(lengths, number, len(words))
    own = weights[table[:, 0]]
    for j in range(1, _OWN.stop):
        own = own + weights[table[:, j]]
    first, second = _pairs(table[number, 0], table[before, _BEFORE.start], table[behind, _BEHIND.start])
    out = own[number]
    for at, columns in ((before, _BEFORE), (behind, _BEHIND)):
        for j in range(columns.start, columns.stop):
            out += weights[table[:, j]][at]
    out += weights[first]
    out += weights[second]
    out += weights[SLOTS - 1]
    return out


def allowed(tags: list[str]) -> np.ndarray:
    """(tags + 1) x tags: 0 where a tag may follow another (last row: begin a sentence), else a very low score."""
    follows = [[not t.startswith("I-") or (s[:2] in ("B-", "I-") and s[2:] == t[2:]) for t in tags] for s in [*tags, "O"]]
    return np.where(follows, np.float32(0), _FORBIDDEN)


def viterbi(scores: np.ndarray, lengths: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Best tag of each token; sentences stand in a row, ``follow`` scores transitions, its last row the first tags.

    All sentences advance together: step t works on those that are longer than t. Of equal paths the one
    with the smaller tags, read from the end, wins.
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    start = (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    best, back = np.zeros((0, follow.shape[1]), np.float32), []
    final = np.zeros(len(size), np.int64)
    for t, b in enumerate(alive):
        if t == 0:
            best = scores[start[:b]] + follow[-1]
        else:
            ways = best[:b, :, None] + follow[None, :-1]
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[start[:b] + t]
        ends = size[:b] == t + 1
        final[:b][ends] = best[ends].argmax(1)
    out = np.zeros(len(scores), np.int64)
    tag = final.copy()
    for t in range(len(alive) - 1, -1, -1):
        b = alive[t]
        longer = size[:b] > t + 1
        if t < len(back):
            rows = np.flatnonzero(longer)
            tag[rows] = back[t][rows, tag[rows]]
        out[start[:b] + t] = tag[:b]
    return out


@dataclass
class Tagger:
    """Weights (slots x tags), then one row of transition scores for each tag before, and one for a sentence's start."""

    tags: list[str]
    weights: np.ndarray

    def decode(self, sentences: list[list[str]]) -> list[list[str]]:
        return self.decode_arrow(pa.array(sentences, pa.list_(pa.string()))).to_pylist()

    def decode_arrow(self, sentences: pa.ListArray) -> pa.ListArray:
        """Tags of sentences, without a Python object a token: only different words are looked at one by one."""
        lengths = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy().astype(np.int64)
        offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        names = pa.array(self.tags, pa.string())
        if not lengths.sum():
            return pa.ListArray.from_arrays(offsets, names.slice(0, 0))
        words = pc.dictionary_encode(sentences.flatten())
        scores = token_scores(self.weights, words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), lengths)
        found = viterbi(scores, lengths, self.weights[SLOTS:] + allowed(self.tags))
        return pa.ListArray.from_arrays(offsets, names.take(pa.array(found)))


def _pass(batches: Iterator[pa.RecordBatch], tags: list[str], start: np.ndarray, together: int) -> Iterator[pa.RecordBatch]:
    """One averaged-perceptron pass; rows (slot, weight of the shard, change at the end, mean change) of what changed."""
    number = {t: i for i, t in enumerate(tags)}
    k, limit = len(tags), allowed(tags)
    w, late, step, seen = start.copy(), np.zeros_like(start), 1, 0
    for batch in batches:
        for a in range(0, batch.num_rows, together):
            part = batch.slice(a, together)
            sentences = part.column(0).to_pylist()
            right = np.array([number.get(t, 0) for row in part.column(1).to_pylist() for t in row], np.int64)
            lengths = np.array([len(s) for s in sentences], np.int64)
            seen += len(sentences)
            if not lengths.sum():
                continue
            slots = feature_slots(sentences)
            found = viterbi(w[slots].sum(1), lengths, w[SLOTS:] + limit)
            first = np.zeros(len(right), bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            change = []
            for path, sign in ((right, 1.0), (found, -1.0)):
                previous = np.where(first, k, np.append(0, path[:-1]))
                change.append((np.hstack([slots, SLOTS + previous[:, None]]), path, sign))
            # tokens whose tag and tag before agree cancel out
            same = (change[0][1] == change[1][1]) & (change[0][0][:, -1] == change[1][0][:, -1])
            for rows, path, sign in change:
                at = (rows[~same] * k + path[~same][:, None]).ravel()
                np.add.at(w.reshape(-1), at, np.float32(sign))
                np.add.at(late.reshape(-1), at, np.float32(sign * step))
            step += 1
    if not seen:
        return
    moved = np.flatnonzero((w != start).any(1) | late.any(1))
    end = (w[moved] - start[moved]).astype(np.float64)
    mean = end - late[moved] / step
    cols = [pa.array(np.append(moved, -1).astype(np.int32)), pa.array(np.full(len(moved) + 1, float(seen)))]
    cols += [pa.array(np.append(m[:, j], 0.0) * seen) for m in (end, mean) for j in range(k)]
    yield pa.RecordBatch.from_arrays(cols, names=["slot", "seen", *[f"{m}{j}" for m in "em" for j in range(k)]])


def train_tagger(labelled: DataFrame, keys: list[str], epochs: int = 5, shards: int | None = None, together: int = 8, tags: list[str] | None = None) -> Tagger:
    """Fit a tagger to sentences with ``words`` and ``tags``; the same rows give the same weights on any cluster.

    ``keys`` with ``sent`` tell sentences apart and deal them over ``shards`` passes that run in parallel: one for
    every ``PER_SHARD`` sentences unless given, as a shard of few sentences learns little before it is mixed. Each round brings at most one row a weight slot to the driver. Unknown
    tags count as ``O``; no sentences give a tagger that tags everything ``O``.
    """
    tags = list(vocab.BIO_TAGS if tags is None else tags)
    k = len(tags)
    key = F.xxhash64(*keys, "sent")
    shards = max(labelled.count() // PER_SHARD, 1) if shards is None else shards
    dealt = labelled.select("words", "tags", key.alias("key")).repartition(shards, "key").sortWithinPartitions("key", "words")
    dealt = dealt.select("words", "tags")
    schema = "slot int, seen double, " + ", ".join(f"{m}{j} double" for m in "em" for j in range(k))
    w, total = np.zeros((SLOTS + k + 1, k), np.float32), np.zeros((SLOTS + k + 1, k))
    sc = labelled.sparkSession.sparkContext
    for _ in range(epochs):
        shared = sc.broadcast(w)  # of a fixed size
        changes = dealt.mapInArrow(lambda batches, s=shared: _pass(batches, tags, s.value, together), schema)
        rows = changes.groupBy("slot").agg(F.sum("seen").alias("seen"), *[F.sum(f"{m}{j}").alias(f"{m}{j}") for m in "em" for j in range(k)]).toArrow()
        shared.unpersist()
        slot = rows.column("slot").to_numpy()
        if not len(slot):
            break
        on = slot >= 0
        seen = float(rows.column("seen").to_numpy()[~on][0])
        end, mean = (np.stack([rows.column(f"{m}{j}").to_numpy()[on] for j in range(k)], 1) / seen for m in "em")
        total += w
        total[slot[on]] += mean
        w = w.copy()
        w[slot[on]] += end.astype(np.float32)
    model = (total / max(epochs, 1)).astype(np.float32)
    if not model.any():
        model[SLOTS - 1, tags.index("O")] = 1
    return Tagger(tags, model)


def tag_sentences(sents: DataFrame, model: Tagger, keys: list[str]) -> DataFrame:
    """``(keys..., sent, words, tags)``: every sentence with the model's tags; ``I-`` always continues its own kind."""
    shared = sents.sparkSession.sparkContext.broadcast(model)
    cols = [*keys, "sent", "words"]
    types = dict(sents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, shared.value.decode_arrow(batch.column(batch.num_columns - 1))], names=[*cols, "tags"])

    return sents.select(*cols).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in cols) + ", tags array<string>")


def model_names(articles: DataFrame, model: Tagger, key: str = "url", column: str = "clean_text") -> DataFrame:
    """Articles with the arrays ``model_malware`` and ``model_actors``; rows that share a key share their names, those without a key have none."""
    spans = B.decode(tag_sentences(B.sentences(articles.where(F.col(key).isNotNull()).dropDuplicates([key, column]), [key], column), model, [key]), [key])
    return articles.join(B.model_entities(spans, [key]), key, "left")


def save_tagger(spark: SparkSession, model: Tagger, path: str) -> None:
    """Write the weights that are not zero as a table (slot, tag, weight), the tags by number as slot -1."""
    slot, tag = np.nonzero(model.weights)
    table = pa.table({"slot": pa.array(np.append(np.full(len(model.tags), -1), slot), pa.int32()),
                      "tag": pa.array([*model.tags, *np.array(model.tags, object)[tag]]),
                      "weight": pa.array(np.append(np.arange(len(model.tags), dtype=np.float32), model.weights[slot, tag]))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(path)


def load_tagger(spark: SparkSession, path: str) -> Tagger:
    rows = spark.read.schema("slot int, tag string, weight float").parquet(path).toArrow()
    slot, tag, weight = (rows.column(c).to_numpy() for c in ("slot", "tag", "weight"))
    tags = tag[slot < 0][np.argsort(weight[slot < 0])].tolist()
    number = {t: i for i, t in enumerate(tags)}
    weights = np.zeros((SLOTS + len(tags) + 1, len(tags)), np.float32)
    on = slot >= 0
    weights[slot[on], [number[t] for t in tag[on]]] = weight[on]
    return Tagger(tags, weights)
