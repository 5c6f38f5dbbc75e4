"""Byte-level pre-tokens of many texts at once, by array arithmetic over code points.

``Cutter`` gives the places where the splitting pattern of a byte-level BPE file starts
a pre-token: contractions, letters, digits or other signs with one leading space, and
white space runs that leave their last character to what follows. Special strings of
the file are cut out first, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from barspark.llm.common import _powers, bytes_of, mix, _draws

SPACE, LETTER, NUMBER, OTHER = range(4)
# White_Space code points.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are pre-tokens of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: Blocks in which Unicode versions disagree about letters and digits: texts with such a character are cut by the library.
DOUBTFUL = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x0860, 0x08FF), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x1C89, 0x1C8A),
    (0x208F, 0x208F), (0x209D, 0x209F), (0x2C2F, 0x2C2F), (0x2C5F, 0x2C5F), (0x9FEB, 0x9FFF), (0xA7B8, 0xA7FF),
    (0xAB60, 0xAB6F), (0x10000, 0x1D3FF), (0x1D6A6, 0x1D6A7), (0x1D800, 0x1EFFF), (0x20000, 0x10FFFF),
]

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point; 4 is added where texts go to the library."""
    if not _CLASSES:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        for low, high in DOUBTFUL:
            table[low : high + 1] += 4
        _CLASSES.append(table)
    return _CLASSES[0]


@dataclass
class Cut:
    """Pre-tokens of a slice: byte offset of each, hash, row offsets into them, and which are special strings."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    special: dict[int, int]

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]].tobytes()


class Cutter:
    """Built once per task from the path of a byte-level BPE file for the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        before = form["pre_tokenizer"] or {}
        if form["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.path = path
        self.specials = {t["content"].encode(): t["id"] for t in form["added_tokens"]}
        for t in form["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"]:
                raise ValueError(f"special string {t['content']!r} has rules that aren't handled")
        longest = sorted(self.specials, key=len, reverse=True)
        self.finder = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.library = None

    def __call__(self, column: pa.Array) -> Cut:
        data, rows = bytes_of(column)
        if not len(data):
            return Cut(data, rows[:0], rows[:0], np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), {})
        raw = data.tobytes()
        found: dict[int, tuple[int, int]] = {}
        if self.finder and any(s in raw for s in self.specials):
            for low, high in zip(rows[:-1], rows[1:], strict=True):
                for m in self.finder.finditer(raw[low:high]):
                    found[int(low) + m.start()] = (int(low) + m.end(), self.specials[m[0]])
        edges = np.unique(np.concatenate([rows, [x for a, (b, _) in found.items() for x in (a, b)]]).astype(np.int64))
        starts = self._starts(raw, data, rows, edges)
        for low, (high, _) in found.items():  # nothing is cut inside a special string
            starts = starts[(starts <= low) | (starts >= high)]
        stops = np.append(starts[1:], len(data))
        up, down = _powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * up[: len(data)], out=total[1:])
        hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        special = {int(np.searchsorted(starts, low)): token for low, (_, token) in found.items()}
        return Cut(data, starts, stops, hashes, np.searchsorted(starts, rows), special)

    def _starts(self, raw: bytes, data: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        kind = classes()[points]
        doubtful = np.unique(np.searchsorted(rows, places[kind >= 4], "right") - 1)
        kind &= 3
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(places, edges)] = True
        run = edge[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        white = kind == SPACE
        after_blank = np.zeros(n, bool)
        after_blank[1:] = points[:-1] == 0x20
        after_blank &= ~edge[:-1]
        start = run & (white | ~after_blank)
        ends_run = np.append(run[1:], True)
        start |= white & ends_run & ~run & ~edge[1:]
        quotes = np.flatnonzero((points == 0x27) & start)
        for c in CONTRACTIONS:
            at = quotes[quotes + len(c) <= n]
            fits = np.ones(len(at), bool)
            for i in range(1, len(c)):
                fits &= (points[at + i] == ord(c[i])) & ~edge[at + i]
            at = at[fits]
            start[at + 1] = False
            past = at + len(c)
            start[past[past < n]] = True
        cuts = places[start]
        for row in doubtful:
            low, high = rows[row], rows[row + 1]
            inside = edges[(edges >= low) & (edges <= high)]
            own = [np.array(self._by_library(raw[a:b]), np.int64) + a for a, b in zip(inside[:-1], inside[1:], strict=True)]
            cuts = np.concatenate([cuts[cuts < low], *own, cuts[cuts >= high]])
        return cuts

    def _by_library(self, piece: bytes) -> list[int]:
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        text = piece.decode("utf-8")
        widths = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
        return [int(widths[a]) for _, (a, _) in self.library.pre_tokenize_str(text)]


VALUES = _draws(256, 4242)
