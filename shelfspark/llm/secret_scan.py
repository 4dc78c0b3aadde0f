"""Secret scans: patterns by their form, and keys and tokens confirmed by their structure.

Three kinds go by form alone (``assign``, ``access``, ``hex``).  The others are reported only where the decoded bytes
parse as what they claim to be:

* ``key``: base64 (also wrapped over lines, as between armour lines) or hex that decodes to a private key: a DER sequence whose nested lengths all add up and whose
  members are those of an RSA, EC, DSA or PKCS #8 key, or the OpenSSH container with its length-prefixed fields;
* ``jwt``: three base64url parts of which the first two decode to JSON objects, the first with an ``alg`` that names a signature, the third decoding to a
  signature of the length that this algorithm gives.

Random letters of the right alphabet fail these checks, so they add no false reports.  Public keys and certificates parse too, but are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds that go by form, in their order, and the least length of what counts.
KINDS = ("assign", "access", "hex", "jwt", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}+")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# The smallest key: an EC key of 32 bytes has 50 bytes of DER.
LEAST_BYTES = 48
HEXLIKE = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{16,}+")
# A JSON object begins with a brace, whose first six bits are an e.
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{9,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{16,}+")
# Lines of base64 are joined while they are as wide as the first; a line break may be written out as \\n.
BASE64 = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/\\]))[A-Za-z0-9+/]{16,}+={0,2}")
LAST_LINE = re.compile(r"[A-Za-z0-9+/]++={0,2}")
BREAK = re.compile(r"(?:\\r)?\\n|\r?\n[\x20\t]*")
# How a DER sequence and the OpenSSH container begin, in base64 and in hex.
OPENSSH = b"openssh-key-v1\0"
BEGIN_BASE64 = re.compile(r"M[A-P][A-Za-z0-9+/]{14}|b3BlbnNzaC1rZXktdjEA")
BEGIN_HEX = re.compile(r"30[0-9A-Fa-f]{10}|6f70656e7373682d6b65792d763100", re.IGNORECASE)
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
# Bytes of a signature by algorithm; none stated where they follow the key, which has 128 or more.
SIGNATURES = {
    "HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "ES256K": (64,), "EdDSA": (64, 114),
    "RS256": (), "RS384": (), "RS512": (), "PS256": (), "PS384": (), "PS512": (),
}
INTEGER, BITS, OCTETS, OBJECT, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER values that fill ``data`` exactly; None where a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            # DER writes a length in as few bytes as it takes.
            if size < 0x80 or size >> 8 * (width - 1) == 0:
                return None
            at += width
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_size(data: bytes) -> int | None:
    """Bytes that the DER value at the start of ``data`` says it takes."""
    if len(data) < 2:
        return None
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + data[1] if not width and not data[1] & 0x80 else 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else None


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is one private key in DER: PKCS #1, SEC 1, DSA's sequence of integers, or PKCS #8, plain or encrypted."""
    outer = der_items(data)
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [tag for tag, _ in items]
    version = items[0][1] if tags[0] == INTEGER else None
    if version in (b"\0", b"\1") and len(items) >= 6 and set(tags) == {INTEGER}:
        # RSA has nine integers, DSA six; the modulus or prime must be a real one.
        return len(items) in (6, 9) and len(items[1][1]) >= 64
    if version == b"\1" and tags[1:2] == [OCTETS] and len(items[1][1]) >= 20:
        # An EC key's optional curve and public point stand in context tags 0 and 1.
        return all(tag in (0xA0, 0xA1) and der_items(content) is not None for tag, content in items[2:])
    if version in (b"\0", b"\1") and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT and len(items[2][1]) >= 20
    if tags == [SEQUENCE, OCTETS]:
        algorithm = der_items(items[0][1])
        return bool(algorithm) and len(algorithm) == 2 and [tag for tag, _ in algorithm] == [OBJECT, SEQUENCE] and bool(der_items(algorithm[1][1])) and len(items[1][1]) >= 32
    return False


class Letters:
    """Bytes written as base64 or hex letters from some letter on, decoded where they are asked for."""

    def __init__(self, text: str, begin: int, base64_: bool):
        self.text, self.begin, self.base64 = text, begin, base64_
        self.size = (len(text) - begin) * 3 // 4 if base64_ else (len(text) - begin) // 2

    def read(self, at: int, size: int) -> bytes:
        """The bytes from ``at`` on, fewer where the letters end."""
        size = max(0, min(size, self.size - at))
        if not self.base64:
            return bytes.fromhex(self.text[self.begin + 2 * at : self.begin + 2 * (at + size)])
        low, high = at // 3, -(-(at + size) // 3)
        part = self.text[self.begin + 4 * low : self.begin + 4 * high]
        return base64.b64decode(part + "=" * (-len(part) % 4))[at - 3 * low :][:size] if len(part) % 4 != 1 else base64.b64decode(part[:-1])[at - 3 * low :][:size]

    def letters(self, size: int) -> int:
        """How many letters spell the first ``size`` bytes."""
        return -(-size * 4 // 3) if self.base64 else 2 * size


def openssh_size(data: Letters) -> int | None:
    """Bytes of an OpenSSH private key: cipher, derivation and its options, key count, then public and private blocks, by length."""
    if data.read(0, len(OPENSSH)) != OPENSSH:
        return None
    at, sizes = len(OPENSSH), []
    for field in range(6):
        head = data.read(at, 4)
        if len(head) < 4:
            return None
        size, at = int.from_bytes(head, "big"), at + 4
        sizes.append(size)
        # The fourth field is the number of keys, not a length.
        at += 0 if field == 3 else size
    cipher, derivation, _, keys, public, private = sizes
    return at if at <= data.size and cipher and derivation and keys and min(public, private) >= 32 else None


def key_size(data: Letters) -> int | None:
    """Bytes of the private key that begins with these letters, if one does; what follows may belong to the text."""
    if data.size < LEAST_BYTES:
        return None
    head = data.read(0, 12)
    if head.startswith(OPENSSH[:12]):
        return openssh_size(data)
    size = der_size(head) if head[0] == SEQUENCE else None
    if not size or not LEAST_BYTES <= size <= data.size:
        return None
    inner = head[2 + (head[1] & 0x7F if head[1] & 0x80 else 0)]
    return size if inner in (INTEGER, SEQUENCE) and is_private_der(data.read(0, size)) else None


def keys_in(letters: str, is_base64: bool) -> Iterator[tuple[int, int]]:
    """(first, past the last) letter of each private key in a run of base64 or hex letters, from the left, without overlaps."""
    begin, at = BEGIN_BASE64 if is_base64 else BEGIN_HEX, 0
    while found := begin.search(letters, at):
        data = Letters(letters, found.start(), is_base64)
        size = key_size(data)
        at = found.start() + (data.letters(size) if size else 1)
        if size:
            yield found.start(), at


def _decoded(part: str) -> bytes | None:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(text: str) -> bool:
    """Whether ``text`` is a signed token: JSON header with a known algorithm, JSON claims, a signature of its length."""
    head, claims, signature = text.split(".")
    header = _is_object(head)
    if header is None or not isinstance(header.get("alg"), str) or header["alg"] not in SIGNATURES or _is_object(claims) is None:
        return False
    signed, sizes = _decoded(signature), SIGNATURES[header["alg"]]
    return signed is not None and (len(signed) in sizes if sizes else len(signed) >= 128)


def base64_blocks(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """(letters, first letter of each line, its place in the text): lines of one width and a last one that is no wider."""
    at = 0
    while first := BASE64.search(text, at):
        lines, at = [first], first.end()
        while len(lines[-1].group()) == len(first.group()) and not lines[-1].group().endswith("=") and (gap := BREAK.match(text, at)):
            more = LAST_LINE.match(text, gap.end())
            if not more or len(more.group()) > len(first.group()):
                break
            lines.append(more)
            at = more.end()
        parts = [line.group().rstrip("=") for line in lines]
        yield "".join(parts), [0, *accumulate(map(len, parts))][:-1], [line.start() for line in lines]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a whole text in code points, end exclusive, by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    for run in HEXLIKE.finditer(text):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text, run.start(), run.end())]
        if len(run.group()) >= 2 * LEAST_BYTES:
            found += [("key", run.start() + begin, run.start() + end) for begin, end in keys_in(run.group(), False)]
    if "." in text:
        found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_token(m.group())]
    if BEGIN_BASE64.search(text):
        for letters, firsts, places in base64_blocks(text):
            for begin, end in keys_in(letters, True):
                line, last = bisect_right(firsts, begin) - 1, bisect_right(firsts, end - 1) - 1
                stop = places[last] + end - firsts[last]
                while text[stop : stop + 1] == "=" and end == len(letters):
                    stop += 1
                found.append(("key", places[line] + begin - firsts[line], stop))
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row of ``docs``: every secret of its whole text as (kind, start, end) in code points, by start, then kind.

    Spans of one kind do not overlap; spans of several kinds may.  Null and empty texts have none; null and repeated keys and repeated rows give
    a row each; no rows give no rows; other columns are not read.  Texts are read one by one by maps and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), span, strict=True)) for span in spans(value.as_py() or "")] for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPANS)], ["key", "spans"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, spans array<struct<kind: string, start: long, end: long>>")
