"""Secrets in whole texts: plain patterns, and candidates whose structure is confirmed by parsing.

The base kinds (assign, access, hex) are leftmost non-overlapping matches of fixed
patterns. Two more kinds are reported only after decoding: ``jwt`` is a signed token
whose header and payload are JSON objects with an algorithm; ``key`` is a private key
in PEM, bare base64 (also wrapped over lines) or hex, whose nested DER lengths tile the
whole blob and whose fields are those of a private key, an OpenSSH key whose
length-prefixed fields do, a legacy encrypted PEM key whose cipher fits its vector and
its length in blocks, or a PGP private key block whose packets do or whose checksum is
right. Line ends may be written as backslash-n, lines be quoted and joined by plus signs
or commas, as keys stand in JSON and source code.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Extra
columns are kept, repeated rows are scanned one by one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import bytes_of, slices, small_batches

# Kinds in the order in which ties of a start are listed, base kinds first.
KINDS = ["assign", "access", "hex", "jwt", "key"]
BASE = KINDS[:3]
# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)
HEX = re.compile(r"[0-9a-f]{24,}", re.A)
ASSIGN_LEAST, HEX_LEAST = 6, 24

JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]*", re.A)
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:[^-]|-(?!----))*+)-----END \1-----", re.A)
# Where letters of a key begin: not within others, but after a line end that is written as backslash-n.
_BEGIN = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))"
BLOB = re.compile(_BEGIN + r"[A-Za-z0-9+/_-]{40,}={0,2}", re.A)
# The first line of a DER or OpenSSH key, and a line that follows another (line ends as they are or written out, quotes and their joins).
WRAPPED = re.compile(_BEGIN + r"(?=M[A-P]|b3BlbnNz)[A-Za-z0-9+/_-]{20,}", re.A)
_QUOTES = r"""[ \t]*+(?:\\*+["'][ \t]*+(?:[+,.][ \t]*+)?)?"""
NEXT = re.compile(rf"{_QUOTES}(?:(?:\r\n?|\n|\\+[nr]){_QUOTES})++([A-Za-z0-9+/_-]+)", re.A)
PADDING = re.compile("={0,2}(?![A-Za-z0-9+/_=-])", re.A)
# What PEM bodies hold beside their lines: written line ends, quotes with their joins, and marks of comments or quotations.
ESCAPED = re.compile(r"(?<!\\)\\++(?:[nrt]|u000[adAD9]|[ \t]*+\n)")
JOINS = re.compile(r"""(?<!\\)\\*+["']\s*+(?:[+,.&]\s*+)?(?:\\*["'])?""")
MARKS = re.compile(r"^[ \t]*(?:[#>*;|]+|//+)[ \t]+", re.M)
LEGACY = re.compile(r"\s*Proc-Type:\s*4\s*,\s*ENCRYPTED\s+DEK-Info:\s*([A-Za-z0-9-]+)\s*,\s*([0-9A-Fa-f]+)\s+", re.A)
BLOCK_BYTES = {"DES": 8, "RC2": 8, "BF": 8, "CAST5": 8, "IDEA": 8, "AES": 16, "CAMELLIA": 16, "ARIA": 16, "SEED": 16}
HEX_BLOB = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{80,}", re.A)
RUN_LEAST = 20
SPANS = "array<struct<kind: string, start: int, stop: int>>"
MASK = "[SECRET]"

_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that tile ``data``, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            count = length & 0x7F
            if not 1 <= count <= 4 or at + count > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + count]), at + count
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (also encrypted), SEC1 or DSA private key, whose nested lengths all fit."""
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = _elements(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if len(fields) >= 9 and tags[:9] == [0x02] * 9:
        return len(fields[0][1]) == 1 and fields[0][1][0] in (0, 1) and len(fields[1][1]) >= 32
    if tags == [0x02] * 6:  # DSA: version, three parameters, both halves
        return fields[0][1] == b"\x00" and len(fields[1][1]) >= 64 and 20 <= len(fields[2][1]) <= 33
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = _elements(fields[1][1])
        return len(fields[0][1]) == 1 and bool(algorithm) and algorithm[0][0] == 0x06 and len(fields[2][1]) >= 32
    if tags[:2] == [0x02, 0x04]:
        return fields[0][1] == b"\x01" and 20 <= len(fields[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 0x04]:
        algorithm = _elements(fields[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm[0][1]) >= 5 and len(fields[1][1]) >= 32
    return False


def is_openssh_key(data: bytes) -> bool:
    """The magic word, then cipher, derivation, its options, a count of keys and as many public fields, and one private field."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    keys = None
    while at < len(data):
        if at + 4 > len(data):
            return False
        number = int.from_bytes(data[at : at + 4])
        at += 4
        if fields == 3 and keys is None:
            keys = number
            continue
        if at + number > len(data):
            return False
        at += number
        fields += 1
    return keys is not None and 1 <= keys <= 16 and fields == 3 + keys + 1


def is_encrypted(cipher: str, vector: str, data: bytes | None) -> bool:
    """Legacy encrypted PEM: a known cipher whose vector is one block and whose text is whole blocks."""
    size = BLOCK_BYTES.get(cipher.upper().split("-")[0])
    return bool(size and data) and len(vector) == 2 * size and (len(data) % size == 0 or not cipher.upper().endswith(("-CBC", "-ECB")))


def _checksum(data: bytes) -> int:
    """CRC-24 of OpenPGP."""
    out = 0xB704CE
    for byte in data:
        out ^= byte << 16
        for _ in range(8):
            out <<= 1
            if out & 0x1000000:
                out ^= 0x1864CFB
    return out


def is_pgp_key(data: bytes) -> bool:
    """OpenPGP packets that tile ``data``, the first of them a secret key."""
    at, first = 0, None
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80:
            return False
        tag, partial = (head & 0x3F, True) if head & 0x40 else (head >> 2 & 15, False)
        first = tag if first is None else first
        while True:
            more = False
            if not head & 0x40:
                count = 1 << (head & 3)
                if count == 8:  # up to the end
                    return first == 5
                size, at = int.from_bytes(data[at : at + count]), at + count
            elif at >= len(data):
                return False
            elif data[at] < 192:
                size, at = data[at], at + 1
            elif data[at] < 224:
                size, at = (data[at] - 192 << 8) + int.from_bytes(data[at + 1 : at + 2]) + 192, at + 2
            elif data[at] == 255:
                size, at = int.from_bytes(data[at + 1 : at + 5]), at + 5
            else:
                size, at, more = 1 << (data[at] & 31), at + 1, partial
            at += size
            if at > len(data):
                return False
            if not more:
                break
    return first == 5


def _pem_lines(body: str) -> list[str]:
    """Lines of a PEM body without what code, comments and quotations put around them."""
    body = JOINS.sub("\n", ESCAPED.sub("\n", body).replace("\\/", "/"))
    return [line.strip() for line in MARKS.sub("", body).splitlines()]


def is_pem_key(label: str, body: str) -> bool:
    """Is the body between PEM marks a private key?"""
    lines = _pem_lines(body)
    if label.endswith("BLOCK"):
        lines = [line for line in lines if line and ":" not in line]  # without header lines
        sums = [line[1:] for line in lines if line.startswith("=") and len(line) == 5]
        data = unbase64("".join(line for line in lines if not line.startswith("=")))
        if not data:
            return False
        return is_pgp_key(data) or any(unbase64(x) == _checksum(data).to_bytes(3) for x in sums)
    legacy = LEGACY.match("\n".join(lines))
    if legacy:
        rest = "\n".join(lines)[legacy.end() :]
        return is_encrypted(legacy[1], legacy[2], unbase64(re.sub(r"\s+", "", rest)))
    return _is_key(unbase64(re.sub(r"\s+", "", "".join(line for line in lines if ":" not in line))))


def _least(data: bytes) -> int | None:
    """Least length of a key that begins with ``data``, as far as can be told; None if none does."""
    magic = b"openssh-key-v1\0"
    if data[:1] == b"\x30":
        count = data[1] & 0x7F if data[1] >= 0x80 else 0
        if count > 4 or data[1] == 0x80 or data[2 + count : 3 + count] not in (b"\x02", b"\x30"):
            return None
        return 2 + count + (int.from_bytes(data[2 : 2 + count]) if count else data[1])
    if not data.startswith(magic[: len(data)]):
        return None
    at, fields, keys = len(magic), 0, None
    while keys is None or fields < 3 + keys + 1:
        if at + 4 > len(data):
            return at + 4
        number, at = int.from_bytes(data[at : at + 4]), at + 4
        if fields == 3 and keys is None:
            if not 1 <= number <= 16:
                return None
            keys = number
            continue
        at, fields = at + number, fields + 1
    return at


class _Lines:
    """Lines of key letters that follow one another, from one on: where each begins, and the letters before it."""

    def __init__(self, text: str, first: re.Match) -> None:
        self.parts, self.stops, self.before, at = [first[0]], [first.end()], [0, len(first[0])], first.end()
        self.number = {first.start(): 0}
        while line := NEXT.match(text, at):
            at = line.end()
            self.number[line.start(1)] = len(self.parts)
            self.parts.append(line[1])
            self.stops.append(at)
            self.before.append(self.before[-1] + len(line[1]))

    def until(self, first: int, letters: int) -> int | None:
        """The line after the one with which ``letters`` from line ``first`` on are there; None if there are not so many."""
        last = bisect_left(self.before, self.before[first] + letters)
        return last if last < len(self.before) else None


def wrapped_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of keys in base64 over several lines without marks; their own lengths tell where they end.

    Lines that follow one another are gone through once, whatever lengths they declare.
    """
    done, lines = 0, None
    for m in WRAPPED.finditer(text):
        if m.start() < done:
            continue
        if lines is None or m.start() not in lines.number:
            lines = _Lines(text, m)
        first = lines.number[m.start()]
        last, need = first + 1, 0
        while True:
            letters = "".join(lines.parts[first:last])
            data = unbase64(letters[: len(letters) // 4 * 4])
            least = _least(data) if data else None
            wanted = 0 if least is None else (4 * least + 2) // 3
            reach = lines.until(first, wanted) if wanted > len(letters) else None
            need = wanted
            # A key ends with a line; lengths that end within one are told without reading on.
            if reach is None or reach == last or (data[:1] == b"\x30" and lines.before[reach] - lines.before[first] != wanted):
                break
            last = reach
        whole = last > first + 1 and need == lines.before[last] - lines.before[first]
        if whole and (end := PADDING.match(text, lines.stops[last - 1])) and _is_key(unbase64(letters)):
            yield m.start(), end.end()
            done = end.end()


def _is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data) or _is_pem_file(data))


def _is_pem_file(data: bytes) -> bool:
    """A whole PEM file, encoded once more (as in the secrets of cluster manifests)."""
    inner = PEM.search(data.decode("latin-1")) if data.startswith(b"-----BEGIN ") else None
    return inner is not None and is_pem_key(inner[1], inner[2])


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    data = unbase64(text)
    try:
        found = json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def scan(text: str, runs: bool = True) -> list[tuple[str, int, int]]:
    """Spans of a text by start, then kind as listed. ``runs``: False if no run of ``RUN_LEAST`` key letters is in it."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if is_pem_key(m[1], m[2]):
                out.append(("key", *m.span()))
    if runs:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        for m in JWT.finditer(text):
            header = _object(m[1])
            if header and isinstance(header.get("alg"), str) and _object(m[2]) is not None:
                out.append(("jwt", *m.span()))
        out += [("key", *m.span()) for m in BLOB.finditer(text) if _is_key(unbase64(m[0]))]
        out += [("key", *span) for span in wrapped_keys(text)]
        for m in HEX_BLOB.finditer(text):
            if len(m[0]) % 2 == 0 and _is_key(bytes.fromhex(m[0])):
                out.append(("key", *m.span()))
    elif "ey" in text or "ew" in text:
        for m in JWT.finditer(text):  # short tokens
            header = _object(m[1])
            if header and isinstance(header.get("alg"), str) and _object(m[2]) is not None:
                out.append(("jwt", *m.span()))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _with_runs(column: pa.Array) -> np.ndarray:
    """Which texts hold ``RUN_LEAST`` letters of keys in a row."""
    data, rows = bytes_of(column)
    inside = np.concatenate([[False], _IN_RUN[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    long = change[0::2][change[1::2] - change[0::2] >= RUN_LEAST]
    out = np.zeros(len(column), bool)
    if len(long):
        out[np.searchsorted(rows, long, "right") - 1] = True
        ends = change[1::2][change[1::2] - change[0::2] >= RUN_LEAST]
        for a, b in zip(long, ends, strict=True):  # a run may go on over the end of a text
            out[np.searchsorted(rows, a, "right") - 1 : np.searchsorted(rows, b - 1, "right")] = True
    return out


def secret_spans(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add the spans of each whole text as an array of (kind, start, stop)."""

    @F.arrow_udf(SPANS)
    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
        for column in columns:
            found: list[list[dict]] = []
            for batch in slices(pa.RecordBatch.from_arrays([column], ["text"])):
                part = batch.column(0)
                for value, runs in zip(part.to_pylist(), _with_runs(part).tolist(), strict=True):
                    found.append([{"kind": k, "start": a, "stop": b} for k, a, b in scan(value, runs)])
            yield pa.array(found, pa.list_(kind))

    small_batches(df.sparkSession)
    return df.withColumn(out, spans(F.coalesce(F.col(text), F.lit(""))))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Put ``MASK`` in the place of every span; overlapping spans get one. Texts without secrets, and nulls, stay as they are."""

    @F.arrow_udf("string")
    def masked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[str | None] = []
            filled = column.fill_null("")
            for batch in slices(pa.RecordBatch.from_arrays([filled], ["text"])):
                part = batch.column(0)
                for value, runs in zip(part.to_pylist(), _with_runs(part).tolist(), strict=True):
                    out.append(mask(value, scan(value, runs)))
            yield pa.array([None if n else t for t, n in zip(out, column.is_null().to_pylist(), strict=True)], pa.string())

    small_batches(df.sparkSession)
    return df.withColumn(text, masked(F.col(text)))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for _, start, stop in spans:
        if stop <= at:
            continue
        if start >= at:
            parts += [text[at:start], MASK]
        at = stop
    return "".join([*parts, text[at:]])
