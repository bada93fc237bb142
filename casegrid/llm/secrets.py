"""Secret scans with structural confirmation.

Base kinds are patterns: ``assign`` (a named value), ``access`` (access key ids) and
``hex`` (long hexadecimal runs). The structural kinds are reported only when the
candidate decodes and its inner structure holds:

- ``pem``: a private-key block whose body, after any header lines, is base64 of a
  private-key encoding, or of whole cipher blocks where its headers name a cipher and the
  initial vector of that block length;
- ``der``: bare base64, also wrapped over lines, or hexadecimal of a private-key encoding;
- ``jwt``: a signed token whose first two parts are base64url JSON objects, the first
  with an ``alg`` member other than none.

A private-key encoding is an ASN.1 SEQUENCE whose nested lengths fill it exactly and
whose members are those of an RSA, DSA, EC, PKCS#8 or encrypted PKCS#8 private key, or an
OpenSSH key record whose length-prefixed fields lie inside it. Public keys are not secrets.
A wrapped key's end is the length its first bytes state; an OpenSSH record states none and is
found in a block or on one line.

Positions are code points, ends exclusive. Null texts count as empty; empty texts have
no spans; repeated rows are scanned alike; the whole of a long text is scanned.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "jwt")
_RANK = {k: i for i, k in enumerate(KINDS)}

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LENGTH)
#: An ``assign`` match holds one of these in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ANY_HEX = re.compile(r"[0-9A-Fa-f]{%d,}" % HEX_LENGTH)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?>(?:\s|\\n)*+[A-Za-z][A-Za-z0-9-]*+: [^\n\\]*+)*+)((?:[A-Za-z0-9+/=\s]|\\n)*+)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]+)")
# A SEQUENCE of under 2**32 bytes starts with M and A to I in base64; an OpenSSH record with its magic.
_DER64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-I]|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{20,}={0,2}")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAP = re.compile(r"(?:\r?\n|\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
_OPENSSH = b"openssh-key-v1\0"


def _members(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``data`` exactly, or None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or i + width > len(data):
                return None
            n, i = int.from_bytes(data[i:i + width], "big"), i + width
        if i + n > len(data):
            return None
        out.append((tag, data[i:i + n]))
        i += n
    return out


def is_private_key(data: bytes) -> bool:
    """Whether ``data`` is a private-key encoding."""
    if data.startswith(_OPENSSH):
        i, fields = len(_OPENSSH), 0
        for part in range(3):                       # cipher, key derivation, its options
            if i + 4 > len(data):
                return False
            i += 4 + int.from_bytes(data[i:i + 4], "big")
            fields += i <= len(data)
        return fields == 3 and i + 4 <= len(data) and int.from_bytes(data[i:i + 4], "big") >= 1
    outer = _members(data)
    if not outer or len(outer) != 1 or outer[0][0] != _SEQUENCE:
        return False
    inner = _members(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags == [_SEQUENCE, _OCTETS]:                # encrypted PKCS#8: a cipher with its parameters, whole blocks
        scheme = _members(inner[0][1])
        return bool(scheme) and [t for t, _ in scheme] == [_OID, _SEQUENCE] and bool(_members(scheme[1][1])) and len(inner[1][1]) >= 16
    if tags[0] != _INTEGER or len(inner[0][1]) != 1:
        return False
    version = inner[0][1][0]
    if version in (0, 1) and len(tags) >= 9 and all(t == _INTEGER for t in tags[:9]):
        return True                                 # RSA
    if version == 0 and tags == [_INTEGER] * 6:     # DSA: the prime is longer than its divisor, the numbers below it are not longer
        p, q, *rest = (len(v) for _, v in inner[1:])
        return p > q >= 8 and max(rest) <= p
    if version == 1 and tags[1] == _OCTETS:
        return True                                 # EC
    if version in (0, 1) and len(tags) >= 3 and tags[1] == _SEQUENCE and tags[2] == _OCTETS:
        algorithm = _members(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == _OID   # PKCS#8
    return False


def _unbase64(text: str) -> bytes | None:
    body = re.sub(r"\s+|\\n", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _wrapped(text: str, start: int) -> tuple[int, bytes] | None:
    """(end, bytes) of the base64 run that starts there and goes on over line breaks, as long as
    its SEQUENCE says (of under 2**16 bytes, as all private keys are), or None."""
    head = _unbase64(text[start:start + 8])
    if not head or head[0] != _SEQUENCE or head[1] > 0x82 or head[1] == 0x80:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + width + (int.from_bytes(head[2:2 + width], "big") if width else head[1])
    need, at, parts = -(-size * 4 // 3), start, []
    while need > 0:
        run = _RUN64.match(text, at, min(len(text), at + need))
        if run is None:
            return None
        parts.append(run[0])
        need, at = need - len(run[0]), run.end()
        if need:
            wrap = _WRAP.match(text, at)
            if wrap is None:
                return None
            at = wrap.end()
    if _RUN64.match(text, at):
        return None
    data = _unbase64("".join(parts))
    return (at + min(len(text[at:at + 2]) - len(text[at:at + 2].lstrip("=")), -size % 3), data) if data else None


def _private_block(headers: str, body: str) -> bool:
    data = _unbase64(body)
    cipher = _CIPHER.search(headers)
    if data and cipher and "ENCRYPTED" in headers:
        block = len(cipher[1]) // 2
        return block in (8, 16) and len(data) % block == 0
    return bool(data) and is_private_key(data)


def _json_object(part: str) -> dict | None:
    data = _unbase64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind as listed in ``KINDS``."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    covered: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            if _private_block(m[2], m[3]):
                out.append(("pem", *m.span()))
                covered.append(m.span())
    runs = _ANY_HEX.findall(text)
    der: list[tuple[int, int]] = []
    if runs:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        for m in _ANY_HEX.finditer(text):
            if m[0].startswith("30") and len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
                der.append(m.span())
    for m in _DER64.finditer(text):
        data = _unbase64(m[0])
        if data and is_private_key(data):
            der.append(m.span())
        elif (found := _wrapped(text, m.start())) and is_private_key(found[1]):
            der.append((m.start(), found[0]))
    out += [("der", s, e) for s, e in der if not any(a <= s and e <= b for a, b in covered)]
    if "." in text:
        for m in _JWT.finditer(text):
            head, body, _ = m[0].split(".")
            first = _json_object(head)
            if first is not None and isinstance(first.get("alg"), str) and first["alg"].lower() != "none" and _json_object(body) is not None:
                out.append(("jwt", *m.span()))
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``docs``."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = spans(text)
                base = [s for s in found if s[0] in BASE_KINDS]
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def redact(text: str | None) -> str | None:
    """``text`` with each secret (overlapping ones together) replaced by [secret]."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in found:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[secret]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(text: str = "text") -> Column:
    """A column of ``text`` without its secrets; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([redact(t) for t in s], dtype=object)

    return run(F.col(text))
