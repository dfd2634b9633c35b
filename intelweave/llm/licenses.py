"""License scan: exact set-similarity join of text blocks with license templates.

A block (a line, or a paragraph of several lines) meets a template where some stretch of it, twice as
long as the template, holds at least ``threshold`` of the template's distinct words. A long paragraph of
other prose uses up a short template's common words here and there, but not that close together. In a
template of under ``SHORT`` distinct words a fifth is the word that names the license, so such a
template must stand there whole. Tokens are put in one global order, rarest in the
corpus first; a pair that meets the threshold must share a token of the template's prefix in that
order (prefix filter), the block must have enough template words at all (length filter), and what is
left behind a match must suffice (positional filter). Only then is the block's densest stretch sought.
No filter loses a pair.

Words that stand in no template cannot be part of an overlap, so a block is cut down to the
templates' vocabulary first; the corpus counts behind the order are needed for that vocabulary only
and are no larger than the templates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose words stand consecutively, and public license wordings.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
#: Templates of fewer distinct words must stand in a block whole.
SHORT = 12

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def word_bytes(text: str) -> bytes:
    """The text with A-Z lower-cased and a blank for each byte that is not part of a word."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def words_of(text: str) -> list[bytes]:
    """Words: digits, letters a-z after lower-casing A-Z, and all beyond ASCII."""
    return word_bytes(text).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of ``phrase`` in ``words``."""
    found, at, tail = [], 0, phrase[-1]
    try:
        while True:
            at = words.index(tail, at)
            start = at - len(phrase) + 1
            if start >= 0 and words[start:at + 1] == phrase:
                found.append(start)
            at += 1
    except ValueError:
        return found


def blocks_of(text: str) -> Iterator[str]:
    yield from text.split("\n")
    for paragraph in _PARAGRAPH.split(text):
        if "\n" in paragraph.strip("\n"):
            yield paragraph


class Index:
    """Templates as token numbers in global order (0 the rarest), with an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], counts: dict[bytes, int], threshold: float) -> None:
        vocabulary = {w for _, ws in templates for w in ws}
        self.order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.sets = [(label, sorted({self.order[w] for w in ws})) for label, ws in templates if ws]
        self.members = [frozenset(s) for _, s in self.sets]
        self.span = [2 * len(ws) for _, ws in templates if ws]
        self.need = [len(s) if len(s) < SHORT else max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, tokens) in enumerate(self.sets):
            for i in range(len(tokens) - self.need[t] + 1):
                self.prefix.setdefault(tokens[i], []).append((t, i))
        rare = {w for w, i in self.order.items() if i in self.prefix}
        self.rare = frozenset(rare)

    def match(self, words: list[bytes]) -> dict[int, float]:
        """Templates that the block meets, with their containment in its densest stretch."""
        block = sorted({self.order[w] for w in words if w in self.order})
        size, seen = len(block), {}
        for j, token in enumerate(block):
            for t, i in self.prefix.get(token, ()):
                need, length = self.need[t], len(self.sets[t][1])
                if size < need:  # length filter
                    continue
                seen[t] = seen.get(t, 0) + 1
                if seen[t] + min(length - i - 1, size - j - 1) < need:  # positional filter
                    seen[t] = -length
        held = frozenset(block)
        close = {t: self.densest(words, t) for t, n in seen.items() if n > 0 and len(held & self.members[t]) >= self.need[t]}
        return {t: n / len(self.members[t]) for t, n in close.items() if n >= self.need[t]}

    def densest(self, words: list[bytes], t: int) -> int:
        """The most distinct words of template ``t`` that stand in one stretch of twice its length."""
        hits = [(i, x) for i, w in enumerate(words) if (x := self.order.get(w)) in self.members[t]]
        held: Counter[int] = Counter()
        best = left = 0
        for i, x in hits:
            held[x] += 1
            while i - hits[left][0] >= self.span[t]:
                gone = hits[left][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
            best = max(best, len(held))
        return best


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str) -> dict[bytes, int]:
    """In how many documents each template word stands; at most one row per template word comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pylist([{"word": w, "n": n} for w, n in counts.items()], pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_column(text: Column, index: Index, phrases: list[tuple[str, str]]) -> Column:
    wanted = [(p.encode().split(), label) for p, label in phrases]
    tails = {p[-1] for p, _ in wanted}

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = words_of(text)
            starts, base, found, best = [], set(), {}, 0.0
            if not tails.isdisjoint(words):
                for phrase, label in wanted:
                    if at := places(words, phrase):
                        starts += at
                        base.add(label)
            if not index.rare.isdisjoint(words):
                for block in blocks_of(text):
                    for t, share in index.match(words_of(block)).items():
                        found[index.sets[t][0]] = best = max(best, share)
            out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                        ",".join(sorted(base | found.keys())), 1.0 if base else best))
        frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(F.coalesce(text, F.lit("")))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: word and phrase counts, the phrases' labels, all labels, the best containment.

    ``phrases`` are (lower-case words, label); a phrase found scores 1. Null texts are empty, repeated
    rows and null ids stay as they are, other columns are left out, so their names cannot clash.
    The templates are a parameter and small: they travel with the tasks.
    """
    wordings = [(label, words_of(text)) for label, text in templates]
    counts = token_counts(docs, frozenset(w for _, ws in wordings for w in ws), text_col)
    found = scan_column(F.col(text_col), Index(wordings, counts, threshold), phrases)
    return docs.select(F.col(id_col).alias("id"), found.alias("found")).select(F.col("id").alias(id_col), "found.*")
