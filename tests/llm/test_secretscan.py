"""Secret scans: base spans against a scanner that goes letter by letter, confirmed ones against keys and tokens built here."""

import base64
import hashlib
import json
import random
import string
import time

from tidewatch.llm import secretscan as s


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 0x80 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + size + body


def number(n: int) -> bytes:
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


P, Q = (1 << 521) - 1, (1 << 607) - 1  # two primes
RSA = der(0x30, b"".join(map(number, (0, P * Q, 65537, 7**300, P, Q, 5**99, 3**99, 11**99))))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + b"\x05\x00") + der(4, RSA))
SEC1 = der(0x30, number(1) + der(4, bytes(range(32))) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
LOCKED = der(0x30, der(0x30, der(6, b"\x2a\x86\x48") + der(0x30, b"\x05\x00")) + der(4, bytes(range(64))))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + b"\x05\x00") + der(3, b"\0" + RSA))


def ssh(cipher: bytes = b"none", check: bytes = b"abcdabcd") -> bytes:
    text = lambda b: len(b).to_bytes(4, "big") + b
    return s.OPENSSH + text(cipher) + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(b"public") + text(check + bytes(40))


def url64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def token(header: dict, size: int, claims=None) -> str:
    return ".".join((url64(json.dumps(header).encode()), url64(json.dumps({"sub": "1"} if claims is None else claims).encode()), url64(bytes(range(size)))))


def only(text: str) -> list[tuple[str, str]]:
    return [(kind, text[a:b]) for a, b, kind in s.listed(s.confirmed_spans(text))]


def test_keys():
    for raw in (RSA, PKCS8, SEC1, LOCKED, ssh(), ssh(b"aes256-ctr", b"abcdefgh")):
        digits = base64.b64encode(raw).decode()
        assert only(f"see ({digits}) there") == [("key", digits)]
        assert only(f"see {raw.hex()} there") == [("key", raw.hex())]
        assert only(f"see {raw.hex().upper()},") == [("key", raw.hex().upper())]
        wrapped = "\n".join(digits[i : i + 64] for i in range(0, len(digits), 64))
        for body in (wrapped, wrapped.replace("\n", "\\n"), digits):
            pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
            assert only(f"x{pem}y") == [("pem", pem)]


def test_what_is_no_key():
    broken = bytearray(RSA)
    broken[3] ^= 1  # a length that no longer fills the whole
    swapped = der(0x30, b"".join(map(number, (0, P * Q + 2, 65537, 7**300, P, Q, 5**99, 3**99, 11**99))))
    for raw in (bytes(broken), swapped, PUBLIC, RSA + b"\0", RSA[:-1], ssh(check=b"abcdefgh"), ssh() + b"\0", bytes(random.Random(3).randbytes(600)), b"\x30" * 600):
        assert only(base64.b64encode(raw).decode()) == [] == only(raw.hex())
        assert only(f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(raw).decode()}\n-----END PRIVATE KEY-----") == []
    for tag in (0x02, 0x30):  # lengths nested without end
        deep = b""
        for _ in range(3000):
            deep = der(tag, deep)
        assert s.der_key(deep) is None


def test_tokens():
    good = token({"alg": "HS256", "typ": "JWT"}, 32)
    assert only(f"Bearer {good}.") == [("token", good)]
    assert only(f"a.b.{good}") == [("token", good)]
    assert only(token({"alg": "RS256"}, 256)) and only(token({"alg": "ES256"}, 64))
    for bad in (token({"alg": "HS256"}, 31), token({"alg": "none"}, 0), token({"typ": "JWT"}, 32), token({"alg": 5}, 32), token({"alg": "HS256"}, 32, [1]), good.replace(".", "-"), "e" * 60 + ".x.y"):
        assert only(bad) == []


def test_secrets_within_digits():
    pem = b"-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(PKCS8) + b"\n-----END PRIVATE KEY-----\n"
    signed = token({"alg": "HS512"}, 64).encode()
    for raw, kind in ((pem, "key"), (signed, "token")):
        digits = base64.b64encode(raw).decode()
        assert only(f"data: {digits}\n") == [(kind, digits)] and only(f"data: {raw.hex()}\n") == [(kind, raw.hex())]
    for raw in (pem.replace(b"PRIVATE", b"PUBLIC"), signed[:-3], b"-----BEGIN " * 20, b"eyJ." * 40, b"openssh-key-v1" * 9):
        assert only(base64.b64encode(raw).decode()) == [] == only(raw.hex())


def plain(text: str) -> list[tuple[int, int, str]]:
    """The base patterns, letter by letter."""
    found = []
    for kind, alphabet, least, head in (("access", string.ascii_uppercase + string.digits, 20, "AKIA"), ("hex", "0123456789abcdef", 24, "")):
        i = 0
        while i < len(text):
            j = i + len(head)
            while text.startswith(head, i) and j < len(text) and text[j] in alphabet:
                j += 1
            if j == i + len(head):
                i += 1
                continue
            if j - i >= least:
                found.append((i, j, kind))
            i = j
    words, value = ("password", "passwd", "secret", "token", "api_key", "apikey"), set(string.ascii_letters + string.digits + "+/_.=-")
    low, i = "".join(c.lower() if c.isascii() else c for c in text), 0
    while i < len(text):
        end = None
        for w in words:
            if low.startswith(w, i):
                j = i + len(w)
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "="):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        end, size = k, k - j
                        break
        if end is None:
            i += 1
            continue
        if size >= 6:
            found.append((i, end, "assign"))
        i = end
    return found


def test_base_spans():
    rng = random.Random(8)
    bits = ["password", "PassWD", "secret", "ſecret", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", "abc", "abcdef", "0123456789ab", "AKIA", "A1B2C3D4", "é", "\n", "deadbeef"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        assert s.listed(s.base_spans(text)) == s.listed(plain(text)), text


def test_rows(spark):
    digits = base64.b64encode(RSA).decode()
    texts = [(1, f"é token = {'a' * 6} {digits}"), (1, None), (None, ""), (2, "0123456789abcdef" * 2), (2, "0123456789abcdef" * 2)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, kind string")
    rows = s.scanned(df).collect()
    assert len(rows) == 5
    start = texts[0][1].index(digits)
    first = next(r for r in rows if r.n_assign)
    assert first.spans == f"assign:2:16,key:{start}:{start + len(digits)}" and first.base_sha256 == hashlib.sha256(b"assign:2:16").hexdigest()
    assert [r.spans for r in rows if r.n_hex] == ["hex:0:32"] * 2
    assert sum(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows) == 2
    found = s.findings(df).collect()
    assert sorted((r.kind, r.value) for r in found) == sorted([("assign", "token = aaaaaa"), ("key", digits), ("hex", texts[3][1]), ("hex", texts[3][1])])
    assert s.scanned(df.limit(0)).count() == 0 == s.findings(df.limit(0)).count()


def test_long_texts_take_linear_time():
    for unit in ("a", "MII", "token=", "AKIA", "eyJ.", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\nA: b\n", "0f", "\\n", ". ", "30"):
        text = unit * (400_000 // len(unit))
        began = time.process_time()
        s.base_spans(text), s.confirmed_spans(text)
        assert time.process_time() - began < 5, unit
