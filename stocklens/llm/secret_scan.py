"""Secret scans: patterns find candidates, decoding and parsing confirm structured ones.

Three base patterns report by form alone. Structural confirmation adds spans of four kinds, only
when the decoded bytes parse:

* ``pem``: a private-key block whose body parses: a DER key, an OpenSSH key, an encrypted PKCS#8
  envelope, or cipher text under a cipher header whose vector and length fit its block size. Line
  ends may be escaped, as in JSON and environment files, and lines quoted or indented.
* ``jwt``: a signed token; header and payload decode to JSON objects and the header names ``alg``.
* ``der``: base64 or hex of a DER private key, its nested lengths filling it exactly. Base64 may be
  wrapped over lines; hex may mix cases or have colons or blanks between bytes.
* ``ssh``: base64, wrapped or not, of an OpenSSH private key, magic and nested lengths.

The outermost length says how much text belongs to a candidate, so that each is decoded once and
no more than ``LARGEST`` bytes of it; nothing is reported twice inside a block. Time grows with the
text's length, whatever it repeats.

Every row is scanned by itself over its whole text, in code points with exclusive ends. Null text
is empty and has no spans. Rows that repeat a doc_id each get a row; an empty table gives an empty
table; further columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stocklens.llm.common import schema_of

# Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")

MARKERS = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY)-----")
TOKEN = re.compile(r"(?<![\w.-])eyJ[\w-]+\.[\w-]+\.[\w-]+(?![\w-])", re.ASCII)
#: How base64 of a DER sequence and of an OpenSSH key begins.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P][A-Za-z0-9+/_-]{18}|b3BlbnNzaC1rZXktdjEA)")
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]*")
LINE_END = re.compile(r"(?:\\r)?\\n|\r?\n")
SPACES = re.compile(r"[ \t]*")
#: How hex of a DER sequence begins, and its bytes with colons or blanks between them or not.
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30(?:[0-9A-Fa-f]{2}){29,}(?![0-9A-Fa-f])|30(?:[: ][0-9A-Fa-f]{2}){29,}(?![0-9A-Fa-f]))")
SSH_MAGIC = b"openssh-key-v1\0"
#: Bytes of the largest key: four times those of an RSA key of 16,384 bits.
LARGEST = 1 << 15

# DER tags, and object identifiers that open the algorithm of a PKCS#8 key.
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def _unbase64(body: str) -> bytes | None:
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte of the value, end) of the element at ``at`` if it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill the range exactly, or None."""
    out = []
    while at < end:
        found = _der(data, at, end)
        if found is None or len(out) > 16:
            return None
        out.append(found)
        at = found[2]
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, DSA, PKCS#8 or SEC1 private key: one sequence that fills the data, version first."""
    top = _elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    parts = _elements(data, *top[0][1:])
    if not parts or len(parts) < 2 or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if version in (0, 1) and len(parts) >= 9 and tags[:9] == [INTEGER] * 9:
        return parts[1][2] - parts[1][1] >= 32
    if version == 0 and tags == [INTEGER] * 6:  # DSA
        return parts[1][2] - parts[1][1] >= 64
    if version == 1 and tags[1] == OCTETS:
        return parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66)
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS]:
        inner = _elements(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == OBJECT
    return False


def is_encrypted_der(data: bytes) -> bool:
    """PKCS#8 envelope: one sequence of an algorithm and the cipher text."""
    top = _elements(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    parts = _elements(data, *top[0][1:])
    if not parts or [p[0] for p in parts] != [SEQUENCE, OCTETS]:
        return False
    inner = _elements(data, *parts[0][1:])
    return bool(inner) and inner[0][0] == OBJECT and parts[1][2] - parts[1][1] >= 16


def ssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` begins with; more than it has, if it is cut; or None.

    Magic, cipher, derivation, options, key count, public keys, private part.
    """
    if not data.startswith(SSH_MAGIC):
        return None
    at, texts = len(SSH_MAGIC), 0
    more = 3
    while texts < more:
        if at + 4 > len(data):
            return at + 4
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > LARGEST:
            return None
        texts += 1
        if texts == 3 and more == 3:
            if at + 4 > len(data):
                return at + 4
            keys = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= keys <= 16:
                return None
            at, more = at + 4, 3 + keys + 1
    return at


def is_private_ssh(data: bytes) -> bool:
    return ssh_length(data) == len(data)


def der_length(data: bytes) -> int | None:
    """Bytes of the sequence that ``data`` begins with, if it begins like a key: a version first."""
    top = _der(data, 0, 1 << 62) if data[:1] == b"0" else None
    if top is None or top[2] > LARGEST or data[top[1] : top[1] + 2] != b"\x02\x01":
        return None
    return top[2]


def _json_object(part: str) -> dict | None:
    data = _unbase64(part)
    try:
        value = json.loads(data.decode("utf-8")) if data is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(token: str) -> bool:
    header, payload, signature = token.split(".")
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str):
        return False
    signed = _unbase64(signature)
    return _json_object(payload) is not None and signed is not None and len(signed) >= 16


# Bytes of a block of the ciphers that a DEK-Info header names.
_BLOCKS = {"DES": 8, "AES": 16}


def _bare(line: str) -> str:
    """A line without quotes, indentation and the signs that join quoted lines."""
    line = line.strip(" \t\"',;#\\")
    if line.endswith("+") and line[:-1].rstrip().endswith(("'", '"')):
        line = line[:-1].rstrip(" \t\"'")
    if line.startswith("+") and line[1:].lstrip().startswith(("'", '"')):
        line = line[1:].lstrip(" \t\"'")
    return "" if line == "+" else line


def _is_pem(label: str, body: str) -> bool:
    """Whether the text between the lines of a private-key block parses as ``label`` says."""
    lines = [x for x in map(_bare, LINE_END.split(body)) if x]
    headers = {}
    while lines and ":" in lines[0]:
        name, _, value = lines.pop(0).partition(":")
        headers[name.strip()] = value.strip()
    data = _unbase64("".join(lines)) if sum(map(len, lines)) <= 2 * LARGEST else None
    if data is None or len(data) < 24:
        return False
    if "ENCRYPTED" in headers.get("Proc-Type", ""):
        cipher, _, vector = headers.get("DEK-Info", "").partition(",")
        block = _BLOCKS.get(cipher.strip()[:3])
        hexed = re.fullmatch(r"[0-9A-Fa-f]+", vector.strip())
        return block is not None and bool(hexed) and len(vector.strip()) in (16, 32) and len(data) % block == 0
    if label.startswith("ENCRYPTED"):
        return is_encrypted_der(data)
    if label.startswith("OPENSSH"):
        return is_private_ssh(data)
    return is_private_der(data)


def _pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of blocks that parse: an end line and the last begin line before it, of one label."""
    begin = None
    for m in MARKERS.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and _is_pem(m[2], text[begin.end() : m.start()]):
                yield begin.start(), m.end()
            begin = None


class _Wrapped:
    """Base64 characters from a place in a text on, across the ends of lines."""

    def __init__(self, text: str, start: int):
        self.text, self.at, self.held, self.ended = text, start, "", False
        self.stops: list[tuple[int, int]] = []  # (characters held, place behind them)

    def first(self, n: int) -> str | None:
        """The first ``n`` characters, or None if there are fewer."""
        while len(self.held) < n and not self.ended:
            m = BASE64_LINE.match(self.text, self.at)
            self.held += m[0]
            self.at = m.end()
            self.stops.append((len(self.held), self.at))
            more = LINE_END.match(self.text, self.at) if m[0] else None
            self.ended = more is None
            if more:
                self.at = SPACES.match(self.text, more.end()).end()
        return self.held[:n] if len(self.held) >= n else None

    def end(self, n: int) -> int | None:
        """The place behind the first ``n`` characters and their padding; None where a line goes on."""
        for held, place in self.stops:
            if held >= n:
                if held > n:
                    return None
                return place + len(re.compile(r"={0,2}").match(self.text, place)[0])
        return None


def _characters(size: int) -> int:
    """Base64 characters of ``size`` bytes, without padding."""
    return -(-size * 8 // 6)


def _decoded(wrapped: _Wrapped, size: int) -> bytes | None:
    found = wrapped.first(_characters(size))
    return None if found is None else _unbase64(found)


def _encoded_keys(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind number, end) of base64 and hex that parse as private keys."""
    for m in BASE64.finditer(text):
        wrapped = _Wrapped(text, m.start())
        data = _unbase64(m[0][:20])
        kind, size = (6, len(SSH_MAGIC)) if m[0][0] == "b" else (5, der_length(data) if data else None)
        if kind == 6:
            # The lengths inside say step by step how much more there is.
            while (data := _decoded(wrapped, size)) and (more := ssh_length(data)) and more > size:
                size = more
            good = bool(data) and is_private_ssh(data)
        else:
            data = _decoded(wrapped, size) if size else None
            good = bool(data) and is_private_der(data)
        if good and (end := wrapped.end(_characters(size))) is not None:
            yield m.start(), kind, end
    for m in HEX_KEY.finditer(text):
        digits = m[0].replace(":", "").replace(" ", "")
        if is_private_der(bytes.fromhex(digits[: 2 * LARGEST])) and len(digits) <= 2 * LARGEST:
            yield m.start(), 5, m.end()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
    ]
    out += [
        (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST
    ]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    blocks = [] if "-----BEGIN " not in text else list(_pem_blocks(text))
    out += [(a, 3, b) for a, b in blocks]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    starts = [a for a, _ in blocks]
    for a, kind, b in _encoded_keys(text):
        k = bisect.bisect_right(starts, a) - 1
        if k < 0 or blocks[k][1] < b:
            out.append((a, kind, b))
    return sorted(out)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of their spans, all spans, and how many added."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(x or "") for x in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[1] < 3] for spans in found]
            count = lambda k: pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
            digests = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    count(0),
                    count(1),
                    count(2),
                    pa.array(digests, pa.string()),
                    pa.array([_listed(s) for s in found], pa.string()),
                    pa.array([len(s) - len(b) for s, b in zip(found, base, strict=True)], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    schema = (
        f"{schema_of(docs, 'doc_id')}, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, spans string, n_confirmed long"
    )
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
