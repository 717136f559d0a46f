"""Secret scans whose candidates are confirmed by their structure.

Three base patterns (assignments, access keys, hex runs) give spans as they are. On
top of them, base64 and hex candidates are decoded, and only what parses is reported:
ASN.1 private keys whose nested lengths add up down to the inner key, OpenSSH keys
whose length-prefixed fields fit, PEM blocks, plain or encoded once more, that hold
either or an encrypted key (its own ASN.1 form, or a DEK-Info header before whole
cipher blocks), and signed tokens whose header is a JSON object with an algorithm.
Line breaks of a PEM block may be escaped, as in JSON. Spans are code points, end
exclusive.

Defined results: a null or empty text has no spans; every row gives one row, equal
rows and rows without a doc_id included; a frame around anything but a key is no
secret, nor one whose marks differ or hold another mark between them; ASN.1 nested
over DEEPEST levels is no key; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import map_batches

#: The kinds in the order in which spans of equal start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "openssh", "pem", "token")

_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_either = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")  # maximal runs, so the same as shorter ones dropped
HEX = re.compile("[0-9a-f]{32,}")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile("[0-9A-Fa-f]{80,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_MARK = re.compile("-----(BEGIN|END) ((?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY)-----")
_HEADER = re.compile(r"([A-Za-z0-9-]+):[ \t]*(.*)")
_DEK = re.compile("([A-Z0-9-]{3,30}),([0-9A-Fa-f]{16,32})")
_BODY = re.compile("[A-Za-z0-9+/]+={0,2}")
DEEPEST = 16

Span = tuple[str, int, int]


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def _whole(data: bytes, at: int, end: int) -> bool:
    """True if elements fill ``at`` to ``end``, and within constructed ones their own contents, all the way down."""
    todo = [(at, end, 0)]
    while todo:
        at, end, deep = todo.pop()
        while at < end:
            part = _tlv(data, at, end)
            if part is None or deep > DEEPEST:
                return False
            if part[0] & 0x20:
                todo.append((part[1], part[2], deep + 1))
            at = part[2]
    return True


def _parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(_tlv(data, at, end))
        at = out[-1][2]
    return out


def _sequence(data: bytes) -> list[tuple[int, int, int]]:
    """The elements of the outer sequence, if all that it holds is whole; trailing bytes are allowed."""
    top = _tlv(data, 0, len(data))
    return _parts(data, top[1], top[2]) if top and top[0] == 0x30 and _whole(data, top[1], top[2]) else []


def _algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    """True for a sequence that begins with an object identifier."""
    inner = _parts(data, part[1], part[2]) if part[0] == 0x30 else []
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def der_key(data: bytes) -> bool:
    """True for PKCS #1, PKCS #8, SEC 1 and DSA private keys, trailing bytes allowed."""
    parts = _sequence(data)
    tags = [t for t, _, _ in parts]
    if len(parts) < 2 or tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    size = [e - s for _, s, e in parts]
    if version <= 1 and len(parts) >= 9 and set(tags[:9]) == {0x02}:
        return size[1] >= 16  # an RSA modulus
    if version == 0 and len(parts) == 6 and set(tags) == {0x02}:
        return size[1] >= 32 and size[2] >= 16  # a DSA key: modulus and subgroup
    if version <= 1 and len(parts) >= 3 and tags[2] == 0x04 and _algorithm(data, parts[1]) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        return _inner_key(data[parts[2][1] : parts[2][2]])
    return version == 1 and tags[1] == 0x04 and size[1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}


def _inner_key(data: bytes) -> bool:
    """True if a PKCS #8 octet string holds just one whole element: a key's sequence, its octets, or its number."""
    top = _tlv(data, 0, len(data))
    if top is None or top[2] != len(data):
        return False
    return der_key(data) if top[0] == 0x30 else top[0] in (0x02, 0x04) and top[2] - top[1] >= 16


def encrypted_key(data: bytes) -> bool:
    """True for an encrypted PKCS #8 key: an algorithm with parameters, and octets."""
    parts = _sequence(data)
    return len(parts) == 2 and _algorithm(data, parts[0]) and len(_parts(data, *parts[0][1:])) == 2 and parts[1][0] == 0x04 and parts[1][2] - parts[1][1] >= 16


def openssh_key(data: bytes) -> bool:
    """True if every length-prefixed field of an OpenSSH private key fits."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False

    def field(at: int) -> int:
        n = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + n if at + 4 + n <= len(data) else len(data) + 1

    at = len(magic)
    for _ in range(3):
        at = field(at)
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return False
        at = field(at)
    return at <= len(data)


def _decode64(text: str) -> bytes:
    text = text.rstrip("=").translate({45: 43, 95: 47})
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return b""


def _object(part: str) -> dict:
    try:
        value = json.loads(_decode64(part))
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def signed_token(text: str) -> bool:
    """True if the header names an algorithm, the claims are an object, and there is a signature unless it is 'none'."""
    header, claims, signature = text.split(".")
    alg = _object(header).get("alg")
    return isinstance(alg, str) and bool(alg) and bool(_object(claims)) and (bool(signature) or alg.lower() == "none")


def base_spans(text: str) -> list[Span]:
    """Spans of the three base patterns, leftmost and non-overlapping for each kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def pem_key(label: str, body: str) -> bool:
    """True if what stands between two marks is a key of some kind, in base64 and nothing else but headers."""
    lines = [line.strip() for line in body.replace("\\r", "").replace("\\n", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    headers = {}
    while lines and (m := _HEADER.fullmatch(lines[0])):
        headers[m[1]] = m[2]
        lines.pop(0)
    packed = "".join("".join(lines).split())
    if not _BODY.fullmatch(packed):
        return False
    data = _decode64(packed)
    if label.startswith("ENCRYPTED"):
        return encrypted_key(data)
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        return bool(_DEK.fullmatch(headers.get("DEK-Info", ""))) and len(data) >= 16 and len(data) % 8 == 0
    return der_key(data) or openssh_key(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Spans of PEM blocks that hold a key: a BEGIN mark and the next one, if that is the END of the same kind."""
    found, begin = [], None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and pem_key(m[2], text[begin.end() : m.start()]):
                found.append((begin.start(), m.end()))
            begin = None
    return found


def confirmed_spans(text: str) -> list[Span]:
    """Spans of candidates that decode and parse as keys or signed tokens."""
    found: list[Span] = []
    for m in _BASE64.finditer(text):
        head = _decode64(m[0][:40])
        if head[:1] == b"\x30" and der_key(_decode64(m[0])):
            found.append(("der", *m.span()))
        elif head.startswith(b"openssh-key-v1\0") and openssh_key(_decode64(m[0])):
            found.append(("openssh", *m.span()))
        elif head.startswith(b"-----BEGIN ") and pem_spans(_decode64(m[0]).decode("latin-1")):
            found.append(("pem", *m.span()))
    for m in _LONG_HEX.finditer(text):
        if m[0].startswith("30") and der_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            found.append(("der", *m.span()))
    if "-----BEGIN " in text:
        found += [("pem", s, e) for s, e in pem_spans(text)]
    found += [("token", *m.span()) for m in _TOKEN.finditer(text) if signed_token(m[0])]
    return found


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_assign, n_access, n_hex, base_sha256 and spans of each whole text."""
    schema = docs.select(*keep).schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                t = value.as_py() or ""
                base = base_spans(t)
                kinds = [k for k, _, _ in base]
                rows.append((*map(kinds.count, BASE_KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + confirmed_spans(t))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return map_batches(docs.select(F.col(text).alias("_text"), *keep), run, schema)


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; secrets in ``text`` are masked and ``size`` (if there) is counted anew for those rows."""
    at = docs.columns.index(text)
    count = docs.columns.index(size) if size in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], batch.column(count).to_pylist() if count is not None else []
            for k, value in enumerate(batch.column(at)):
                t = value.as_py()
                spans = base_spans(t) + confirmed_spans(t) if t else []
                if spans:
                    t = redacted(t, spans)
                    if count is not None:
                        sizes[k] = len(t)
                texts.append(t)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.column(at).type)
            if count is not None:
                cols[count] = pa.array(sizes, batch.column(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_batches(docs, run, schema)
