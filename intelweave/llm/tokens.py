"""Whole-text tokenization through the public tokenizers, word by word with a bounded cache.

BPE never merges across a pre-token, so a text's ids are the ids of its words in a row. Most
words of a corpus recur; each worker therefore keeps the ids of the words it has met and sends
only new ones to the tokenizer. Whatever is not plainly cut at white space goes through the
tokenizer as a whole text, so the ids always equal those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

# Characters that Python takes for white space and the tokenizers do not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_SPACED = re.compile(r" (?=\S)")
_MIXED_SPACE = re.compile(r" \s")
_JOINED_MARKS = re.compile(r"(?<=[\W_])[,.]\s")
_SENTENCE = re.compile(r"[.!?…。][\"')\]»”’]*$")
_SEPARATOR = "<|endoftext|>"  # a special token of both files: what stands between two is a text of its own
_NO_LEAD = "\x00"  # before a unit that no blank leads
_WORDS = 700_000  # words whose ids a worker keeps; beyond, it starts anew
_JOIN = 32  # new words that go to the tokenizer in one text


class Encoder:
    """Ids of whole texts; ``kind`` is ``word`` (white space dropped, ``</w>`` ends) or ``byte`` (space-led)."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), kind
        self.lead = " " if kind == "byte" else ""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.special = [t for t in ("<|startoftext|>", _SEPARATOR) if t in vocab]
        self.cut = vocab[_SEPARATOR]
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.new: list[str] = []
        self.flat, self.size, self.ends = array("I"), array("q"), array("b")

        class Codes(dict):
            def __missing__(codes, word):  # noqa: N805
                codes[word] = n = len(codes)
                self.new.append(word)
                return n

        self.code = Codes()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _flush(self) -> None:
        """Ids of the new words, many in one text between separators."""
        for i in range(0, len(self.new), 64 * _JOIN):
            blocks = [self.new[k:k + _JOIN] for k in range(i, min(i + 64 * _JOIN, len(self.new)), _JOIN)]
            joint = [_SEPARATOR.join([w[1:] if w[:1] == _NO_LEAD else self.lead + w for w in b] + [""]) for b in blocks]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joint, add_special_tokens=False)])
            at = np.flatnonzero(ids == self.cut)
            self.size.frombytes((np.diff(at, prepend=-1) - 1).tobytes())
            self.flat.frombytes(np.delete(ids, at).tobytes())
            self.ends.extend([_SENTENCE.search(w) is not None for b in blocks for w in b])
        self.new.clear()

    def _words(self, text: str) -> list[str]:
        """Words at white space, lower case where the tokenizer does the same, a plain comma or period on its own."""
        if "İ" not in text and "Σ" not in text:
            text = text.lower()
        if not _JOINED_MARKS.search(text):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return text.split()

    @staticmethod
    def _units(text: str) -> list[str]:
        """Words each led by a blank that is cut off; a plain comma or period, with the line behind it, is a unit without."""
        if _MIXED_SPACE.search(text):
            return _SPACED.split(text)
        if _NO_LEAD not in text and not _JOINED_MARKS.search(text):
            text = text.replace(", ", f" {_NO_LEAD}, ").replace(". ", f" {_NO_LEAD}. ").replace(".\n", f" {_NO_LEAD}.\n")
        return text.split(" ")

    def encode(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the id ``last`` behind it; ids per text; sentence ends (ids before the cut)."""
        if len(self.code) > _WORDS:
            self._clear()
        get = self.code.__getitem__
        rows: list[np.ndarray | list[int]] = []
        heads: list[list[int]] = []
        for text in texts:
            head: list[int] = []
            if any(c in text for c in _ODD_SPACE) or any(s in text for s in self.special):
                rows.append(self._ids(text))
                heads.append(head)
                continue
            if self.kind == "word":
                words = self._words(text)
            else:
                words = self._units(text)
                if text[:1] == " " and words[0] == "":
                    words.pop(0)  # every unit is led by its blank, the first one too
                elif words:
                    head = self._ids(words.pop(0))
            rows.append(np.fromiter(map(get, words), np.int64, len(words)))
            heads.append(head)
        self._flush()
        size, ends = np.frombuffer(self.size, np.int64), np.frombuffer(self.ends, np.int8)
        first = np.cumsum(size) - size
        flat = np.frombuffer(self.flat, np.uint32)
        out, counts, cuts, done = [], np.empty(len(rows), np.int64), [], 0
        for i, (row, head) in enumerate(zip(rows, heads)):
            if isinstance(row, list):
                ids = np.array([*row, last], np.uint32)
            else:
                n = size[row]
                upto = np.cumsum(n)
                body = flat[np.repeat(first[row] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
                ids = np.concatenate([np.array(head, np.uint32), body, np.array([last], np.uint32)])
                cuts.append(upto[ends[row] == 1] + (done + len(head)))
            out.append(ids)
            counts[i] = len(ids)
            done += len(ids)
        flat = size = ends = None  # the arrays grow again
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), counts, np.concatenate(cuts) if cuts else np.empty(0, np.int64)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a tokenizer file; its cache lives as long as the worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
