"""Secret scans: patterns find candidates, and structure confirms them.

Base kinds (assign, access, hex) are reported for their form. The structural kinds are
reported only if the candidate decodes:

* ``jwt``: three URL-safe base64 parts, of which the first is a JSON header that names an
  algorithm and the second a JSON object;
* ``pem``: the body between private-key lines is base64 of a DER private key or of an OpenSSH
  key, or, below headers that say so, of cipher text in whole blocks;
* ``der``: a base64 or hex run that decodes to a DER private key outside of PEM lines;
* ``ssh``: a base64 or hex run that decodes to an OpenSSH private key.

A base64 or hex run that decodes to text with a confirmed ``pem`` or ``jwt`` in it is of that
kind. DER private keys are told apart by what they hold: PKCS#1 and DSA (a version and as many
INTEGERs as the form has), PKCS#8 (version, algorithm, OCTET STRING), SEC1 (version 1, OCTET
STRING) and encrypted PKCS#8 (a password-based algorithm, OCTET STRING). Nested lengths must
fill their parents. Public keys and certificates are not secrets and match none of these.

Spans are code points of the whole text, end exclusive. Structural spans do not overlap each
other: ``pem`` and ``jwt`` go before runs. Defined cases: a null text is empty and has no
spans; whole texts of any length are scanned in one pass a kind; rows without id and repeated
rows give their result each; ties in start go by kind; an empty table gives no rows; other
columns of the input are not read (scan_secrets) or kept as they are (redact).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from diffusio.session import ship

#: The kinds in their order and the base patterns with their least lengths.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched as a whole, so the least length may stand here
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: The object identifiers of password-based encryption (PKCS#5 and PKCS#12) as DER.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

_WORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*+((?:[A-Za-z0-9-]+:[^\n]*\n)*+)([A-Za-z0-9+/=\s]*+)-----END \1-----")
_RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_RUN16 = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9a-fA-F]{48,})(?![0-9A-Za-z])")
_SSH = b"openssh-key-v1\0"


def _base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = _base64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at a place, if it ends by ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= end else None


INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _members(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The values that fill a place, if they do and are at most so many."""
    out: list[tuple[int, int, int]] = []
    while at < end:
        value = _der(data, at, end)
        if value is None or len(out) == most:
            return None
        out.append(value)
        at = value[2]
    return out


def _algorithm(data: bytes, value: tuple[int, int, int]) -> bytes | None:
    """The object identifier at the head of an algorithm's SEQUENCE."""
    inner = _members(data, value[1], value[2]) if value[0] == SEQUENCE else None
    return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == OBJECT else None


def is_key_der(data: bytes) -> bool:
    """Whether all of the data is one private key of a known form."""
    top = _der(data, 0, len(data))
    if not top or top[0] != SEQUENCE or top[2] != len(data):
        return False
    values = _members(data, top[1], top[2])
    if not values or len(values) < 2:
        return False
    tags, sizes = [t for t, _, _ in values], [e - a for _, a, e in values]
    if tags[0] == SEQUENCE:  # encrypted PKCS#8
        name = _algorithm(data, values[0])
        return tags == [SEQUENCE, OCTETS] and name is not None and name.startswith(PASSWORD_BASED) and sizes[1] >= 16
    if tags[0] != INTEGER or sizes[0] != 1:
        return False
    version = data[values[0][1]]
    if tags[1] == OCTETS:  # SEC1
        return version == 1 and sizes[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[1] == SEQUENCE:  # PKCS#8
        return version <= 1 and tags[2:3] == [OCTETS] and sizes[2] >= 16 and _algorithm(data, values[1]) is not None and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
    plain = tags[:9] == [INTEGER] * 9 and (version, tags[9:]) in ((0, []), (1, [SEQUENCE]))  # PKCS#1
    return (plain or (version == 0 and tags == [INTEGER] * 6)) and sizes[1] >= 32  # or DSA


def is_key_ssh(data: bytes) -> bool:
    """Magic, then length-prefixed cipher, function and options, a key count and as many public keys."""
    if not data.startswith(_SSH):
        return False
    at = len(_SSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(field() for _ in range(keys + 1))


def _is_key(data: bytes | None) -> bool:
    return bool(data) and (is_key_ssh(data) or is_key_der(data))


def _is_pem(m: re.Match) -> bool:
    body = _base64(re.sub(r"\s+", "", m[3]))
    if "Proc-Type: 4,ENCRYPTED" in m[2] and "DEK-Info:" in m[2]:
        return bool(body) and len(body) % 8 == 0
    return _is_key(body)


def _is_jwt(m: re.Match) -> bool:
    header = _object(m[1])
    return bool(header) and isinstance(header.get("alg"), str) and _object(m[2]) is not None and (bool(m[3]) or header["alg"] == "none")


def _run_kind(data: bytes | None) -> str | None:
    """The kind of a decoded run."""
    if not data or len(data) < 24:
        return None
    if is_key_ssh(data):
        return "ssh"
    if is_key_der(data):
        return "der"
    if data.isascii() and (b"PRIVATE KEY-----" in data or b"ey" in data):
        text = data.decode("ascii")
        if any(map(_is_pem, _PEM.finditer(text))):
            return "pem"
        if any(map(_is_jwt, _JWT.finditer(text))):
            return "jwt"
    return None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base kinds."""
    out = []
    if _WORDS.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that decoding confirms."""
    out: list[tuple[int, int, str]] = []

    def add(found: list[tuple[int, int, str]]) -> None:
        """Those that overlap none of the spans so far."""
        out.sort()
        starts = [a for a, _, _ in out]
        free = []
        for a, b, kind in found:
            at = bisect_right(starts, a)
            if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= b):
                free.append((a, b, kind))
        out.extend(free)

    if "PRIVATE KEY-----" in text:
        add([(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _is_pem(m)])
    if "ey" in text:
        add([(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if _is_jwt(m)])
    add([(m.start(), m.end(), k) for m in _RUN16.finditer(text) if len(m[1]) % 2 == 0 and (k := _run_kind(bytes.fromhex(m[1])))])
    add([(m.start(), m.end(), k) for m in _RUN64.finditer(text) if (k := _run_kind(_base64(m[0])))])
    return out


_ORDER = {k: i for i, k in enumerate(KINDS)}


def scan_text(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def scan_secrets(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Spans of each text: id and spans, an array of (kind, start, end) by start, then kind. No shuffle."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in scan_text(t)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": spans})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest_secrets(found: DataFrame) -> DataFrame:
    """Counts and listings of the base and of all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """documents with each secret span (overlapping ones joined) replaced by ``[SECRET]``; n_chars follows. No row goes.

    Null texts stay null, with the n_chars that they have; empty texts, repeated rows and rows
    without id stay; an empty table stays empty; n_chars and other columns may be missing.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None or not (spans := scan_text(t)):
                return t
            out, at = [], 0
            for s, e, _ in spans:
                if s >= at:
                    out += [t[at:s], "[SECRET]"]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    changed = docs.withColumn("text", cleaned("text"))
    return changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else changed
