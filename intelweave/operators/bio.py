"""Sentence tables, BIO distant labels, decoding and token accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions import entities as E
from intelweave.functions.flow import bind, string_array, with_computed
from intelweave.operators.sampling import sample_exact


def sentences(
    df: DataFrame, keys: list[str], column: str = "clean_text", lo: int = 8, hi: int | None = 60
) -> DataFrame:
    """``(keys..., sent, words)``: pieces between full stops or newlines with lo..hi words."""
    words = F.transform(
        F.split(F.col(column), r"[.\n]"),
        lambda s: F.filter(F.split(s, r"[ \t\n\x0b\f\r]+"), lambda w: w != ""),
    )
    pieces = df.select(*keys, F.posexplode(words).alias("sent", "words"))
    size = F.size("words")
    return pieces.where(size >= lo if hi is None else size.between(lo, hi))


def bio_tags(words: Column, malware: list[str] | None = None, actors: list[str] | None = None) -> Column:
    """One tag per word by exact lower-case match of word windows.

    Terms are applied malware first, then actors, each from long to short;
    a later term overwrites an earlier one where they meet.
    """
    by_length = lambda terms: sorted((t.lower() for t in terms), key=len, reverse=True)
    actor_order = by_length(vocab.ACTOR_TERMS if actors is None else actors)
    mal_order = [t for t in by_length(vocab.MALWARE_TERMS if malware is None else malware) if t not in actor_order]
    order = mal_order + actor_order
    by_words: dict[int, list[str]] = {}
    for term in order:
        by_words.setdefault(len(term.split()), []).append(term)
    ranks = string_array(order)
    starters = string_array(sorted({t.split()[0] for t in order}))

    def hits_of(low: Column, n: int, terms: list[str]) -> Column:
        def gram(w: Column, i: Column) -> Column:
            text = w if n == 1 else F.array_join(F.slice(low, i + 1, F.lit(n)), " ")
            return F.struct(text.alias("t"), i.alias("i"))

        def hit(s: Column) -> Column:
            rank = F.array_position(ranks, s["t"])
            return F.struct(rank.alias("rank"), s["i"].alias("start"), F.lit(n).alias("n"))

        return F.transform(F.filter(F.transform(low, gram), lambda s: s["t"].isin(terms)), hit)

    def hits(low: Column) -> Column:
        return F.concat(*[hits_of(low, n, terms) for n, terms in sorted(by_words.items())])

    def tag(found: Column, i: Column) -> Column:
        covering = F.filter(found, lambda m: (m["start"] <= i) & (i < m["start"] + m["n"]))
        return bind(
            F.array_max(covering),
            lambda m: F.when(m.isNull(), "O").otherwise(
                F.concat(
                    F.when(m["start"] == i, "B-").otherwise("I-"),
                    F.when(m["rank"] <= len(mal_order), "MALWARE").otherwise("ACTOR"),
                )
            ),
        )

    def tags(low: Column) -> Column:
        return bind(hits(low), lambda found: F.transform(low, lambda w, i: tag(found, i)))

    lowered = F.transform(words, F.lower)
    plain = F.transform(words, lambda w: F.lit("O"))
    # Only sentences with the first word of some term take the slow path.
    return F.when(F.arrays_overlap(lowered, starters), bind(lowered, tags)).otherwise(plain)


def bio_label(sents: DataFrame, malware: list[str] | None = None, actors: list[str] | None = None) -> DataFrame:
    return with_computed(sents, {"tags": bio_tags(F.col("words"), malware, actors)})


def tokens(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Sentence rows to ``(keys..., sent, pos, token, tag)``."""
    pairs = F.arrays_zip(F.col("words").alias("token"), F.col("tags").alias("tag"))
    flat = labelled.select(*keys, "sent", F.posexplode(pairs).alias("pos", "p"))
    return flat.select(*keys, "sent", "pos", F.col("p.token").alias("token"), F.col("p.tag").alias("tag"))


def has_entity(tags: Column) -> Column:
    return F.exists(tags, lambda t: t != "O")


def ner_training_sample(labelled: DataFrame, keys: list[str], seed: int = 42, cap: int = 2000) -> DataFrame:
    """All sentences with an entity plus an equal number (at most ``cap``) without one."""
    with_entity = labelled.where(has_entity(F.col("tags")))
    plain = labelled.where(~has_entity(F.col("tags")))
    n = with_entity.agg(F.least(F.count("*"), F.lit(cap)).alias("n")).scalar()
    return with_entity.unionByName(sample_exact(plain, n, [*keys, "sent"], seed))


def decode(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Tagged sentences to one row per span: ``(keys..., sent, span, kind, entity)``."""
    spans = E.decode_spans(F.col("words"), F.col("tags"))
    flat = labelled.select(*keys, "sent", F.posexplode(spans).alias("span", "s"))
    return flat.select(*keys, "sent", "span", "s.kind", "s.entity")


def model_entities(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans to two array columns per article, ready for :func:`entities.combine`."""
    def of(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("entity"))))

    return spans.groupBy(*keys).agg(of("malware").alias("model_malware"), of("actor").alias("model_actors"))


def tag_with(
    sents: DataFrame, tagger: Callable[[], Callable[[list[list[str]]], list[list[str]]]], keys: list[str]
) -> DataFrame:
    """Tag sentences with a user model, Arrow batch by Arrow batch.

    ``tagger`` is called once per task and returns the function that maps a list
    of word lists to a list of tag lists.
    """
    cols = [*keys, "sent", "words"]
    types = dict(sents.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", tags array<string>"

    def run(batches):
        tag = tagger()
        for pdf in batches:
            words = [list(w) for w in pdf["words"]]
            yield pdf.assign(words=words, tags=tag(words))

    return sents.select(*cols).mapInPandas(run, schema)


def token_accuracy(df: DataFrame, label: str = "label", pred: str = "pred", ignored: int = -100) -> DataFrame:
    """Share of right tokens to four digits, ignored positions left out; 0 if none remain."""
    counted = F.col(label) != ignored
    right = F.count(F.when(counted & (F.col(label) == F.col(pred)), 1))
    total = F.count(F.when(counted, 1))
    return df.agg(
        F.when(total > 0, F.round(right / total, 4)).otherwise(F.lit(0.0)).alias("token_accuracy")
    )
