"""Secret scan: patterns, and encoded candidates that are reported only after their structure is parsed.

Base kinds are plain patterns. The method's own kinds come from long base64 or hex runs, wrapped over
lines or not: a run is decoded and reported from where the bytes parse as a key: DER whose nested
lengths add up to a private key's layout, the binary layout of an OpenSSH key, or a signed token whose
header is a JSON object with an algorithm. Random words never parse. An encrypted PEM block shows no
key layout; its header fields and whole cipher blocks confirm it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, with the least length of what is kept.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("jwt", "pem", "der", "openssh")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
# The body ends at the next five dashes; its tempered run is atomic, so a text of open headers stays linear.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))++)-----END \1-----")
_PEM_FIELD = re.compile(r"([A-Za-z][A-Za-z0-9-]*):\s*(.*)")
_DEK = re.compile(r"[A-Z0-9-]+,((?:[0-9A-F]{2}){8,16})", re.I)
_BREAK = re.compile(r"(?:\\r)?\\n|\r?\n[ \t]*")  # a line end, also one spelled out as in JSON strings
_B64 = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:(?:%s)[A-Za-z0-9+/_-]{40,})*(?:(?:%s)[A-Za-z0-9+/_-]+)?={0,2}" % (_BREAK.pattern, _BREAK.pattern))
_ANY_HEX = re.compile(r"[0-9a-fA-F]{64,}")
_OPENSSH = b"openssh-key-v1\0"
# Where a key may begin in decoded bytes: a sequence whose first element is a version or another sequence.
_KEY_START = re.compile(rb"0(?=(?:[\x00-\x7f]|\x81.|\x82..|\x83...)(?:\x02\x01[\x00\x01]|0))|" + _OPENSSH, re.S)
LEAST_KEY, LEAST_MODULUS, LEAST_OCTETS = 32, 32, 16  # bytes
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>"


def der_node(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the DER element at ``at``; None if it does not fit into ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n = int.from_bytes(data[at:at + size], "big")
        at += size
        if n < 0x80 or n >> (8 * (size - 1)) == 0:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [at, end) exactly."""
    out = []
    while at < end:
        node = der_node(data, at, end)
        if node is None:
            return None
        out.append(node)
        at = node[2]
    return out


def der_key_end(data: bytes, at: int) -> int | None:
    """End of the private key that begins at ``at``: PKCS#8, RSA or EC, or their encrypted form."""
    top = der_node(data, at, len(data))
    if top is None or top[0] != 0x30:
        return None
    kids = der_children(data, top[1], top[2])
    if not kids:
        return None
    tags, sizes = [k[0] for k in kids], [k[2] - k[1] for k in kids]
    key = False
    if tags[0] == 0x02 and sizes[0] == 1:
        if tags[:9] == [0x02] * 9:  # RSA: version, modulus and seven more integers
            key = sizes[1] >= LEAST_MODULUS
        elif tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, octets
            inner = der_children(data, *kids[1][1:])
            key = bool(inner) and inner[0][0] == 0x06 and sizes[2] >= LEAST_OCTETS
        else:  # EC: octets, curve or point
            key = tags[1:2] == [0x04] and sizes[1] >= LEAST_OCTETS and any(t in (0xA0, 0xA1) for t in tags[2:])
    elif tags == [0x30, 0x04]:  # encrypted PKCS#8: the algorithm holds an identifier and its parameters
        inner = der_children(data, *kids[0][1:])
        key = bool(inner) and [k[0] for k in inner] == [0x06, 0x30] and der_children(data, *inner[1][1:]) is not None
    return top[2] if key else None


def openssh_end(data: bytes, at: int) -> int | None:
    """End of magic, three length-prefixed strings, a count of keys, then that many public keys and one private part."""
    if not data.startswith(_OPENSSH, at):
        return None
    at += len(_OPENSSH)

    def chunk() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + struct.unpack(">I", data[at:at + 4])[0]
        return at <= len(data)

    if not all(chunk() for _ in range(3)) or at + 4 > len(data):
        return None
    count = struct.unpack(">I", data[at:at + 4])[0]
    at += 4
    # Each step takes four bytes or ends the loop, so a large count costs no more than the data.
    return at if count >= 1 and all(chunk() for _ in range(count + 1)) else None


def decode64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True) if len(run) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def key_at(data: bytes, at: int) -> tuple[str, int] | None:
    """Kind and end of the key that begins at ``at``."""
    kind = "openssh" if data[at:at + 1] == _OPENSSH[:1] else "der"
    end = (openssh_end if kind == "openssh" else der_key_end)(data, at)
    return (kind, end) if end is not None and end - at >= LEAST_KEY else None


def is_key_block(body: str) -> bool:
    """Between the lines of a PEM block: a key that fills it, or an encryption header with whole cipher blocks."""
    fields, lines = {}, []
    for line in _BREAK.split(body):
        field = _PEM_FIELD.fullmatch(line.strip())
        if field:
            fields[field[1].lower()] = field[2].strip()
        else:
            lines.append("".join(line.replace("\\", " ").split()))
    data = decode64("".join(lines))
    if not data:
        return False
    if "dek-info" in fields:
        start = _DEK.fullmatch(fields["dek-info"])
        return bool(start) and "ENCRYPTED" in fields.get("proc-type", "") and len(data) % (len(start[1]) // 2) == 0
    found = key_at(data, 0)
    return found is not None and found[1] == len(data)


def keys_in_run(run: str, per: int, size: int, decode) -> list[tuple[str, int, int]]:
    """Keys spelled inside a run of digits of which ``per`` make ``size`` bytes: (kind, start, end) in digits.

    A key may begin at any digit, as after ``path/``. The run is decoded once from each place within the first
    group, so work is linear in it; a key's own lengths say where it ends.
    """
    found = []
    for skip in range(per):
        data = decode(run[skip:])
        for m in _KEY_START.finditer(data):
            at = m.start()
            if at % size == 0 and (key := key_at(data, at)):
                found.append((key[0], skip + at // size * per, skip + at // size * per + -(-(key[1] - at) * per // size)))
    kept = []
    for kind, start, end in sorted(found, key=lambda f: (f[1], -f[2])):
        if not kept or start >= kept[-1][2]:  # a key inside another one is part of it
            kept.append((kind, start, end))
    return kept


def _whole64(run: str) -> bytes:
    return decode64(run[:len(run) - (len(run) % 4 == 1)]) or b""


def _whole_hex(run: str) -> bytes:
    return bytes.fromhex(run[:len(run) // 2 * 2])


def encoded_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64, also wrapped over lines, or hex."""
    spans = []
    for m in _B64.finditer(text):
        # Digits of the lines in a row, with the place in the text where each line's begin.
        lines, at = [], m.start()
        for cut in _BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, cut.start()))
            at = cut.end()
        lines.append((at, m.end()))
        run = "".join(text[a:b] for a, b in lines).rstrip("=")
        upto = [0, *itertools.accumulate(b - a for a, b in lines)]

        def place(digit: int) -> int:
            line = bisect.bisect_right(upto, digit) - 1
            return lines[line][0] + digit - upto[line]

        for kind, start, end in keys_in_run(run, 4, 3, _whole64):
            a, b = place(start), place(end - 1) + 1
            while text[b:b + 1] == "=" and b < m.end():
                b += 1
            spans.append((kind, a, b))
    for m in _ANY_HEX.finditer(text):
        spans += [(kind, m.start() + a, m.start() + b) for kind, a, b in keys_in_run(m[0], 2, 1, _whole_hex)]
    return spans


def is_signed_token(header: str, body: str) -> bool:
    for part, field in ((header, "alg"), (body, None)):
        raw = decode64(part)
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or field and not isinstance(value.get(field), str):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    low, spans = raw.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """The method's spans: candidates whose structure was parsed."""
    spans = []
    if "eyJ" in text:
        spans += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        spans += [("pem", *m.span()) for m in _PEM.finditer(text) if is_key_block(m[2])]
    # Tokens and blocks come in ascending order each; what lies in one of them is not reported again.
    spans.sort(key=lambda s: s[1])
    starts, ends = [a for _, a, _ in spans], [b for *_, b in spans]
    highest = list(itertools.accumulate(ends, max))

    def free(a: int, b: int) -> bool:
        before = bisect.bisect_left(starts, b)
        return before == 0 or highest[before - 1] <= a

    return spans + [s for s in encoded_keys(text) if free(s[1], s[2])]


def scan_text(text: str):
    base = base_spans(text)
    kinds = [k for k, _, _ in base]
    order = BASE_KINDS + METHOD_KINDS
    every = sorted(base + confirmed_spans(text), key=lambda s: (s[1], order.index(s[0])))
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, [{"kind": k, "start": a, "end": b} for k, a, b in every]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask_text(text: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping and adjoining spans become one."""
    spans = sorted((a, b) for _, a, b in base_spans(text) + confirmed_spans(text))
    out, at = [], 0
    for a, b in spans:
        if a > at or not out:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def scan_column(text: Column) -> Column:
    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_text(t) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(F.coalesce(text, F.lit("")))


def mask_column(text: Column) -> Column:
    """Null stays null; rows without a secret keep their text as it is."""
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask_text)

    return F.when(text.isNotNull(), masked(F.coalesce(text, F.lit(""))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, a digest of the base spans, all spans.

    Spans count code points, ends are exclusive. Null texts are empty; repeated rows and null ids stay
    as they are; other columns are left out, so their names cannot clash.
    """
    return docs.select(F.col(id_col).alias("id"), scan_column(F.col(text_col)).alias("found")).select(F.col("id").alias(id_col), "found.*")
