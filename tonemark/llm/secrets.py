"""Secret scan: patterns first, then structure.

Three base kinds are plain patterns. Further spans need their content to hold together: a base64 or
hex run has to decode to a private key in DER whose nested lengths all fit, or to an OpenSSH key
with its chain of lengths; a signed token needs a JSON header with a known algorithm, a JSON body
and a signature of a length the algorithm can make.

A null text counts as empty and has no spans. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import with_arrow

#: Base kinds first, in the order that breaks ties; the rest are confirmed by structure.
KINDS = ["assign", "access", "hex", "pem", "key", "signed"]
BASE = KINDS[:3]

# The base patterns and their least lengths.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ASSIGN_LENGTH = 8
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# the assignment pattern is slow, so it only runs on texts that hold one of its words
_NAMES = re.compile(r"password|passwd|secret|token|api_?key")
# DER starts with a sequence tag, which is M in base64 and 30 in hex; an OpenSSH key with its name
_B64 = re.compile(r"(?:M(?<![A-Za-z0-9+/_-]M)|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{40,}={0,2}")
_DER_HEX = re.compile(r"30(?<![0-9A-Fa-f]30)[0-9A-Fa-f]{62,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_SIGNED = re.compile(r"e[yw](?<![A-Za-z0-9_.-]e[yw])[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}")
# Bytes of a signature by algorithm family; 0 means that the key decides.
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_SIGNATURES |= {"RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0}
_OPENSSH = b"openssh-key-v1\0"

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def _decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, with or without padding."""
    plain = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of each value between two places, None unless they fill it exactly."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size >= 128:
            width = size - 128
            if not 1 <= width <= 4 or start + width > end:
                return None
            size, start = int.from_bytes(data[start : start + width]), start + width
            if size < 128:
                return None
        if start + size > end:
            return None
        items.append((tag, start, start + size))
        start += size
    return items


def _nested_fits(data: bytes, start: int, end: int, depth: int = 0) -> bool:
    items = der_items(data, start, end)
    if items is None or depth > 8:
        return False
    return all(_nested_fits(data, a, b, depth + 1) for tag, a, b in items if tag & 0x20)


def is_private_key(data: bytes) -> bool:
    """One of the usual encodings of a private key, with every nested length right."""
    if data.startswith(_OPENSSH):
        at = len(_OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            size = int.from_bytes(data[at : at + 4])
            at += 4 + size
            if at + 4 > len(data):
                return False
        n_keys = int.from_bytes(data[at : at + 4])
        at += 4
        for _ in range(n_keys + 1 if 1 <= n_keys <= 16 else 0):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4])
        return 1 <= n_keys <= 16 and at == len(data)
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or not _nested_fits(data, 0, len(data)):
        return False
    inner = der_items(data, *outer[0][1:]) or []
    tags = [tag for tag, _, _ in inner]
    if tags[:1] != [0x02] or inner[0][2] - inner[0][1] != 1:
        return bool(tags == [0x30, 0x04])  # encrypted: algorithm, then the sealed key
    version = data[inner[0][1]]
    rsa = len(tags) >= 9 and set(tags[:9]) == {0x02} and version <= 1
    wrapped = tags[1:3] == [0x30, 0x04] and version <= 1
    curve = tags[1:2] == [0x04] and version == 1
    return rsa or wrapped or curve


def _json_part(run: str) -> dict | None:
    try:
        value = json.loads(_decoded(run) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: str) -> bool:
    header, body, signature = run.split(".")
    head = _json_part(header)
    wanted = _SIGNATURES.get(head.get("alg")) if head and isinstance(head.get("alg"), str) else None
    sealed = _decoded(signature)
    if wanted is None or sealed is None or _json_part(body) is None:
        return False
    return len(sealed) == wanted if wanted else len(sealed) >= 128


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if _NAMES.search(text.lower()):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _ASSIGN_LENGTH:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            data = _decoded("".join(m[2].split()))
            if data and is_private_key(data):
                yield "pem", m.start(), m.end()
    for m in _B64.finditer(text):
        data = _decoded(m[0])
        if data and is_private_key(data):
            yield "key", m.start(), m.end()
    for m in _DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            yield "key", m.start(), m.end()
    if "ey" in text or "ew" in text:
        for m in _SIGNED.finditer(text):
            if is_signed_token(m[0]):
                yield "signed", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans by start, then kind as listed, then end."""
    if not text:
        return []
    found = [*base_spans(text), *confirmed_spans(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``, the array of spans ``(kind, start, end)`` of each text."""

    def make(texts: list) -> list:
        return [[[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)] for t in texts]]

    return with_arrow(docs, [text], make, [T.StructField("secrets", SPANS)])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every stretch that spans cover gives way to ``[secret]``; other text, and nulls, stay."""

    def clean(value: str | None) -> str | None:
        out, done = [], 0
        for _, start, end in find_spans(value):
            if end > done:
                if start >= done:
                    out += [value[done:start], "[secret]"]
                done = end
        return "".join([*out, value[done:]]) if done else value

    field = T.StructField(text, T.StringType())
    return with_arrow(docs, [text], lambda texts: [[clean(t) for t in texts]], [field]).select(docs.columns)


def listed(spans: Column) -> Column:
    """Spans as text: kind, start and end by colons, spans by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    spans = F.col("secrets")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(BASE))
    return scanned.select(
        *keep, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans")
    )
