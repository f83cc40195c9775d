"""Secrets in texts: patterns, and encoded keys and tokens that are only reported once their structure is confirmed.

Base spans come from three patterns alone. Beyond them, everything that might be an encoded secret is decoded and parsed:

* ``token``: dotted base64url parts of which the first is a JSON header that names a known signature algorithm, the second
  a JSON claim set, and the third a signature of that algorithm's length;
* ``key``: runs of base64 or hex digits that decode to a private key - DER whose nested lengths fill the run exactly and whose
  fields are those of a PKCS #1, PKCS #8, encrypted PKCS #8, SEC 1 or DSA key, or the length-prefixed fields of an OpenSSH key;
* ``pem``: an armoured private key whose body, freed of headers, white space and escaped line ends, is such a key.

Digits may also hold an armoured key (``key``) or a signed token (``token``), as configuration files keep them.

Public keys, certificates, random base64 and digests don't parse as any of these, and aren't reported.

Every candidate is found in one scan over maximal runs, each decoded once: the work is linear in the text, which is never cut.

Defined results: a null text is an empty one and has no spans; ids may be null or repeat, a row is a text of its own.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import given_back, small_batches

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "token", "key", "pem")
#: The base patterns with the group whose length counts and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Signature bytes of the algorithms of signed tokens (RSA: from 1024 bits on).
SIGNED = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNED = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
OPENSSH = b"openssh-key-v1\0"
#: A key in base64 or hex digits has so many at least: the shortest, of 32 bytes on a named curve, has 48 bytes.
LEAST_DIGITS = 64
#: Numbers of a key have so many bits at most; beyond them nothing is multiplied.
MOST_BITS = 1 << 15
_DOTTED = re.compile(r"[A-Za-z0-9_.-]{40,}")
_DIGITS = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_DIGITS},}}={{0,2}}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_HEX = re.compile(rf"[0-9a-fA-F]{{{LEAST_DIGITS},}}")
_ARMOUR = re.compile(r"(?:[A-Za-z0-9+/=\x20\t\r\n]++|\\[nrt])*+")
_HEADER = re.compile(r"(?:[\x20\t\r\n]++|\\[nr])*+(?:[A-Za-z][A-Za-z-]*+: [^\n\\]*+(?:\n|\\r|\\n)++)*+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns alone: matches are taken from the left, and those too short are dropped afterwards."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def unwrapped(digits: str) -> bytes:
    """Bytes of base64 or base64url digits, padded or not; none where there are no such bytes."""
    digits = digits.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def element(data: memoryview, at: int, end: int) -> tuple[int, int, int]:
    """Tag, start and end of the DER element at ``at``; ValueError where its length isn't minimal or leaves ``end``."""
    if at + 2 > end:
        raise ValueError
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            raise ValueError
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
        if size < 0x80 or size >> 8 * (n - 1) == 0:
            raise ValueError
    if start + size > end:
        raise ValueError
    return tag, start, start + size


def fields(data: memoryview, start: int, end: int) -> list[tuple[int, int, int]]:
    """The elements that fill ``start`` to ``end``."""
    out = []
    while start < end:
        out.append(element(data, start, end))
        start = out[-1][2]
    return out


def _number(data: memoryview, field: tuple[int, int, int]) -> int:
    return int.from_bytes(data[field[1] : field[2]], "big", signed=True)


def der_key(raw: bytes) -> str | None:
    """Which private key ``raw`` is as a whole, by its nested lengths and fields."""
    data = memoryview(raw)
    try:
        tag, start, end = element(data, 0, len(data))
        if tag != 0x30 or end != len(data):
            return None
        parts = fields(data, start, end)
        tags = [p[0] for p in parts]
        if tags[:3] == [0x02, 0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]) and _number(data, parts[0]) in (0, 1):
            named = fields(data, *parts[1][1:])
            return "pkcs8" if named and named[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16 else None
        if tags == [0x30, 0x04]:
            named = fields(data, *parts[0][1:])
            size = parts[1][2] - parts[1][1]
            return "pkcs8-encrypted" if len(named) == 2 and named[0][0] == 0x06 and named[1][0] == 0x30 and size >= 32 and size % 8 == 0 else None
        if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1} and _number(data, parts[0]) == 1:
            return "sec1" if 16 <= parts[1][2] - parts[1][1] <= 72 else None
        if set(tags) == {0x02}:
            n = [_number(data, p) for p in parts]
            if max(n).bit_length() > MOST_BITS:
                return None
            if len(n) == 9 and n[0] == 0 and min(n[1:]) > 0 and n[4] * n[5] == n[1]:
                return "pkcs1"
            if len(n) == 6 and n[0] == 0 and min(n[1:]) > 0 and n[5] < n[2] < n[1] and pow(n[3], n[5], n[1]) == n[4]:
                return "dsa"
    except (ValueError, IndexError, RecursionError):
        return None
    return None


def openssh_key(raw: bytes) -> str | None:
    """Is ``raw`` an OpenSSH private key, length by length to its end?"""
    if not raw.startswith(OPENSSH):
        return None
    at, strings = len(OPENSSH), []

    def string() -> bytes:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            raise ValueError
        at += 4 + size
        return raw[at - size : at]

    try:
        strings = [string() for _ in range(3)]
        keys = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if not 1 <= keys <= 64:
            return None
        for _ in range(keys):
            string()
        secret = string()
        if at != len(raw) or len(secret) < 8 or len(secret) % 8:
            return None
        return "openssh" if strings[0] != b"none" or secret[:4] == secret[4:8] else None
    except ValueError:
        return None


def key_in(raw: bytes) -> str | None:
    """Which private key the bytes are; the first tells whether it's worth looking."""
    return der_key(raw) if raw[:1] == b"\x30" else openssh_key(raw)


def _object(digits: str) -> dict | None:
    try:
        found = json.loads(unwrapped(digits))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: str, claims: str, signature: str) -> bool:
    """Are the three parts a signed token, by header, claims and the length of the signature?"""
    named = _object(header)
    if named is None or not isinstance(named.get("alg"), str) or _object(claims) is None:
        return False
    size = len(unwrapped(signature))
    return size in SIGNED.get(named["alg"], ()) or named["alg"] in RSA_SIGNED and size >= 128 and size % 8 == 0


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the armoured private keys, from the left and apart."""
    found, done = [], 0
    for m in _PEM.finditer(text):
        if m.start() < done:
            continue
        body = _ARMOUR.match(text, _HEADER.match(text, m.end()).end())
        if key_in(unwrapped(re.sub(r"[\x20\t\r\n]|\\[nrt]", "", body.group()))):
            close = f"-----END {m[1]}-----"
            done = body.end() + len(close) * text.startswith(close, body.end())
            found.append((m.start(), done))
    return found


def secret_in(raw: bytes) -> str | None:
    """Which kind of secret decoded digits are: a key's bytes, an armoured key's text, or a signed token's."""
    if raw[:1] == b"\x30" or raw[:1] == b"o":
        return "key" if key_in(raw) else None
    if raw.startswith(b"-----BEGIN "):
        return "key" if armoured_spans(raw.decode("latin-1")) else None
    if raw[:1] == b"e":
        parts = raw.decode("latin-1").strip().split(".")
        return "token" if len(parts) == 3 and signed_token(*parts) else None
    return None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decodes to a secret. An armoured key isn't reported again for its body."""
    armour = armoured_spans(text)
    found = [(a, b, "pem") for a, b in armour]
    starts, ends = [s[0] for s in armour], [s[1] for s in armour]
    for m in _DOTTED.finditer(text):
        parts, at, i = m.group().split("."), m.start(), 0
        while i + 2 < len(parts):
            # an object's first character gives its first digit
            if parts[i][:1] == "e" and signed_token(*parts[i : i + 3]):
                size = sum(map(len, parts[i : i + 3])) + 2
                found.append((at, at + size, "token"))
                at, i = at + size + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    spans: dict[tuple[int, int], str] = {}
    for m in _DIGITS.finditer(text):
        # the first digit of a sequence's tag, of the other format, of an armour and of a token
        if m.group()[0] in "MbLZ" and (kind := secret_in(unwrapped(m.group()))):
            spans[m.span()] = kind
    for m in _HEX.finditer(text):
        if len(m.group()) % 2 == 0 and m.group()[:2].lower() in ("30", "6f", "2d", "65") and (kind := secret_in(bytes.fromhex(m.group()))):
            spans[m.span()] = kind
    for (a, b), kind in spans.items():
        i = bisect_right(starts, a) - 1
        if i < 0 or b > ends[i]:
            found.append((a, b, kind))
    return found


def listed(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """By start, then by kind as listed."""
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in listed(spans))


def _texts(column):
    for t in column.cast(pa.large_binary()):
        yield t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value): a row for each span of each text, in code points with an exclusive end."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in given_back(batches):
            for i, t in enumerate(_texts(batch.column(1))):
                if spans := listed(base_spans(t) + confirmed_spans(t)):
                    starts, ends, kinds = zip(*spans, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(0).slice(i, 1)] * len(spans)), pa.array(kinds), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array([t[a:b] for a, b, _ in spans], pa.string())], names=["doc_id", "kind", "start", "end", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text)).mapInArrow(work, f"doc_id {kind}, kind string, start long, end long, value string")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: its counts by base kind, the digest of its base spans and all its spans, written as ``kind:start:end``."""
    small_batches(docs.sparkSession)
    counts = ("assign", "access", "hex")

    def work(batches):
        for batch in given_back(batches):
            numbers, digests, spans = [], [], []
            for t in _texts(batch.column(1)):
                base = base_spans(t)
                numbers.append([sum(s[2] == kind for s in base) for kind in counts])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + confirmed_spans(t)))
            columns = [pa.array([n[i] for n in numbers], pa.int64()) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{c}" for c in counts), "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text)).mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
