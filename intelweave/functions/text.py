"""Text cleaning as Column expressions: no Python worker is involved anywhere."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from intelweave import vocab
from intelweave.functions.flow import bind

# Whitespace spelled out, so Java, RE2 and Python split at the same places.
WS = r"[ \t\n\x0b\f\r]"
# Characters that survive blanking, each spelled out: Java tests such a class with
# one table look-up, while a class of several ranges costs eight times as much.
_KEPT = string.ascii_letters + string.digits + r".,\-"
# Clitic pairs a word tokenizer splits; the tail is always a stop word or too
# short to keep, so only the head survives.
_PAIRS = r"\b(?:(can)not|(gim)me|(gon)na|(got)ta|(lem)me|(wan)na)\b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c: Column | str) -> Column:
    """Replace each ``<...>`` that does not span lines by a blank."""
    c = _col(c)
    # (?d): only \n ends a line; Java would otherwise also stop at CR and U+2028.
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, r"(?d)<.*?>", " ")).otherwise(c)


def extract_cves(c: Column | str) -> Column:
    """Distinct upper-cased CVE ids in ascending order."""
    hits = F.regexp_extract_all(_col(c), F.lit(vocab.CVE_PATTERN), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, F.upper)))


def is_private_ip(c: Column | str) -> Column:
    """Textual prefix test; ``010.1.1.1`` counts as public on purpose."""
    prefixes = "|".join(p.replace(".", r"\.") for p in vocab.PRIVATE_IP_PREFIXES)
    return _col(c).rlike(f"^(?:{prefixes})")


def extract_ips(c: Column | str) -> Column:
    """Distinct public IPv4 addresses, sorted as strings."""
    c = _col(c)
    hits = F.regexp_extract_all(c, F.lit(vocab.IPV4_PATTERN), F.lit(0))
    public = F.array_sort(F.array_distinct(F.filter(hits, lambda ip: ~is_private_ip(ip))))
    # The cheap test spares most texts the backtracking octet pattern.
    return F.when(c.rlike(r"[0-9]\.[0-9]"), public).otherwise(F.array().cast("array<string>"))


def strip_chars(c: Column | str) -> Column:
    """Blank out everything but ASCII letters, digits, ``. , -`` and the space."""
    return F.regexp_replace(_col(c), f"[^{_KEPT} ]", " ")


def reinject(text: Column | str, cves: Column | str, ips: Column | str) -> Column:
    """Append the saved indicators, CVE ids first."""
    # concat_ws takes arrays as well and skips empty ones.
    return F.concat_ws(" ", _col(text), _col(cves), _col(ips))


def squash_ws(c: Column | str) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(_col(c), WS + "+", " "))


def _replace_if(c: Column, marks: list[str], pattern: str, by: str) -> Column:
    """``regexp_replace`` for the texts that hold one of ``marks`` at all."""
    def replaced(t: Column) -> Column:
        held = reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks])
        return F.when(held, F.regexp_replace(t, pattern, by)).otherwise(t)

    return bind(c, replaced)


def tokenize_clean(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case words longer than two characters, stop words removed, joined by blanks.

    Works on text that already went through :func:`strip_chars`. A comma splits
    a word unless a digit follows, ``--`` and dot runs stand alone, and a word's
    final period is dropped (sentence end).
    """
    stop = vocab.STOP_WORDS if stop_words is None else stop_words
    t = F.lower(_col(c))
    t = F.regexp_replace(t, r",([^0-9]|$)", r" , $1")
    t = _replace_if(t, ["..", "--"], r"(\.\.+|--)", r" $1 ")
    t = _replace_if(t, ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"], _PAIRS, r"$1$2$3$4$5$6 ")
    t = F.regexp_replace(t, r"([^. ])\.( |$)", r"$1$2")
    kept = F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.array_join(kept, " ")


def clean_text(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Full cleaning of one article body; null gives the empty string.

    Indicators are taken out before punctuation is blanked and appended again
    afterwards. Blanking and whitespace collapsing share one pass: after
    blanking the only whitespace left is the space itself.
    """
    def tagless(t: Column) -> Column:
        body = F.regexp_replace(t, f"[^{_KEPT}]+", " ")
        return tokenize_clean(F.trim(reinject(body, extract_cves(t), extract_ips(t))), stop_words)

    return bind(strip_tags(F.coalesce(_col(c), F.lit(""))), tagless)


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for null or blank."""
    trimmed = F.btrim(F.coalesce(_col(c), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return bind(trimmed, lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS + "+"))))


def strip_ws(c: Column | str) -> Column:
    """Trim every kind of ASCII whitespace plus the no-break space."""
    return F.btrim(_col(c), F.lit(" \t\n\x0b\f\r\u00a0"))


def join_list(c: Column | str) -> Column:
    """Array to ``", "``-joined text (null or empty gives "")."""
    return F.coalesce(F.array_join(_col(c), ", "), F.lit(""))


def parse_list(c: Column | str) -> Column:
    """``,``-separated text to array; blanks and ``nan`` entries vanish."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), strip_ws)
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "nan"))


def url_id(c: Column | str) -> Column:
    """Stable record id: hex md5 of the URL."""
    return F.md5(_col(c))
