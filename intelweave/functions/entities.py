"""Gazetteer matching and entity clean-up as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.flow import string_array

# A maximal run of word characters; a one-word term stands as a whole word
# exactly when it equals one of these runs.
WORD_RUN = r"[\p{L}\p{N}_]+"
NOT_WORD_RUN = r"[^\p{L}\p{N}_]+"


def boundary_pattern(term: str) -> str:
    return r"\b" + re.escape(term) + r"\b"


def match_terms(lowered: Column, words: Column, terms: list[str]) -> Column:
    """Every term that stands as a whole word in the text, unsorted.

    ``lowered`` is the lower-cased text, ``words`` its word runs. One-word terms
    are a set intersection; the few terms with blanks or signs are searched by a
    substring test first, so the regular expression runs on hits only.
    """
    terms = [t.lower() for t in terms]
    single = [t for t in terms if re.fullmatch(r"\w+", t)]
    several = [t for t in terms if not re.fullmatch(r"\w+", t)]
    parts = [F.array_intersect(words, string_array(single))]
    if several:
        # An impossible term (final non-word sign) keeps its pattern and never matches.
        hits = [
            F.when(F.contains(lowered, F.lit(t)) & lowered.rlike(boundary_pattern(t)), F.lit(t))
            for t in several
        ]
        parts.append(F.array_compact(F.array(*hits)))
    return parts[0] if len(parts) == 1 else F.array_union(*parts)


def context_pattern(term: str, contexts: list[str], window: int) -> str:
    """One regular expression for "a context phrase within ``window`` tokens of the exact token".

    The phrase may start inside a token or end before its end, but all tokens it
    touches have to lie inside the window.
    """
    sides = []
    for phrase in contexts:
        gap = window - len(phrase.split())
        p = re.escape(phrase)
        sides.append(rf"(?<!\S){re.escape(term)}(?:\s+\S+){{0,{gap}}}\s+(?:\S*[^\w\s])?{p}\b")
        sides.append(rf"\b{p}(?:[^\w\s]\S*)?(?:\s+\S+){{0,{gap}}}\s+{re.escape(term)}(?!\S)")
    return "(?s)" + "|".join(f"(?:{s})" for s in sides)


def drop_unsupported(
    lowered: Column,
    matched: Column,
    ambiguous: dict[str, list[str]] | None = None,
    window: int = vocab.CONTEXT_WINDOW,
) -> Column:
    """Remove ambiguous terms that none of their own context phrases supports; case does not matter."""
    guards = vocab.AMBIGUOUS_CONTEXTS if ambiguous is None else ambiguous
    guards = {term.lower(): [c.lower() for c in contexts] for term, contexts in guards.items()}
    if not guards:
        return matched
    unsupported = [
        F.when(
            F.array_contains(matched, term) & (~lowered.rlike(context_pattern(term, contexts, window)) if contexts else F.lit(True)),
            F.lit(term),
        )
        for term, contexts in guards.items()
    ]
    cleaned = F.array_except(matched, F.array_compact(F.array(*unsupported)))
    return F.when(F.arrays_overlap(matched, string_array(list(guards))), cleaned).otherwise(matched)


def combine_entities(
    keyword: Column, model: Column | None = None, blocklist: list[str] | None = None
) -> Column:
    """Keyword and model entities, minus vendors, very short names and numbers; sorted.

    Without a model (``None`` or null) only the keyword entities remain.
    """
    blocked = vocab.VENDOR_BLOCKLIST if blocklist is None else blocklist
    empty = F.array().cast("array<string>")
    union = keyword if model is None else F.array_union(keyword, F.coalesce(model, empty))
    keep = F.filter(
        union, lambda e: ~F.lower(e).isin(blocked) & (F.length(e) > 2) & ~e.rlike("^[0-9]+$")
    )
    return F.array_sort(F.array_distinct(keep))


def decode_spans(words: Column, tags: Column) -> Column:
    """BIO tags of one sentence to ``array<struct<kind, entity>>`` in sentence order.

    ``B-`` opens a span, ``I-`` of the same kind extends it, anything else closes
    it; an ``I-`` with no open span of its kind is dropped.
    """
    span = "struct<kind:string,words:array<string>>"
    start = F.struct(
        F.array().cast(f"array<{span}>").alias("done"),
        F.lit(None).cast(span).alias("open"),
    )

    def closed(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    def step(acc: Column, tok: Column) -> Column:
        tag, kind = tok["tag"], tok["tag"].substr(F.lit(3), F.length(tok["tag"]))
        opens = tag.startswith("B-")
        extends = tag.startswith("I-") & acc["open"].isNotNull() & (acc["open"]["kind"] == kind)
        fresh = F.struct(kind.alias("kind"), F.array(tok["word"]).alias("words"))
        longer = F.struct(
            acc["open"]["kind"].alias("kind"),
            F.concat(acc["open"]["words"], F.array(tok["word"])).alias("words"),
        )
        return F.struct(
            F.when(extends, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(opens, fresh).when(extends, longer).otherwise(F.lit(None).cast(span)).alias("open"),
        )

    tokens = F.zip_with(words, tags, lambda w, t: F.struct(w.alias("word"), t.alias("tag")))
    spans = F.aggregate(tokens, start, step, closed)
    named = F.transform(
        spans,
        lambda s: F.struct(
            F.when(s["kind"] == "MALWARE", "malware").otherwise("actor").alias("kind"),
            F.lower(F.array_join(s["words"], " ")).alias("entity"),
        ),
    )
    # Sentences without an opener, nearly all of them, skip the fold.
    return F.when(F.exists(tags, lambda t: t.startswith("B-")), named).otherwise(
        F.array().cast("array<struct<kind:string,entity:string>>")
    )
