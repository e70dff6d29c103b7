"""Byte-level BPE pre-tokens of flat text arrays, without a regular expression per text.

The pattern is the one of the public 50k byte-level vocabulary: contractions, runs of letters, digits
or other signs with one blank before them, and runs of white space.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

OTHER, LETTER, DIGIT, SPACE = range(4)

# The contractions of the pattern.
SHORT = "stmd"
LONG = ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, points):
            low, high = ord(found[0][0]), ord(found[0][-1])
            table[low : high + 1] = kind
    return table


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the UTF-8 bytes, and the offsets counted in them."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), leads[offsets]


def specials_of(data: np.ndarray, offsets: np.ndarray, special: bytes) -> np.ndarray:
    """Byte places of a special string; it never crosses into the next text."""
    raw, found, at = data.tobytes(), [], 0
    while (at := raw.find(special, at)) >= 0:
        inside = offsets[np.searchsorted(offsets, at, side="right")] >= at + len(special)
        if inside:
            found.append(at)
        at += len(special) if inside else 1
    return np.array(found, np.int64)


def token_starts(points: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Where each pre-token begins. parts: ascending places at which a new text or part begins."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[parts] = True
    first[n] = True
    start = np.empty(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[0] = start[n] = True
    start[:n] |= first[:n]
    blank = points == 0x20
    # the last white space before other signs begins a token; a blank is joined to what follows
    follows = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    start[follows - 1] = True
    start[follows[blank[follows - 1]]] = False
    marks = np.flatnonzero((points == 0x27) & start[:n])
    marks = marks[marks + 1 < n]
    marks = marks[~first[marks + 1]]
    if len(marks):
        after = points[marks + 1]
        third = np.where((marks + 2 < n) & ~first[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        two = np.isin(after, [ord(x) for x in SHORT])
        three = np.zeros(len(marks), bool)
        for x, y in LONG:
            three |= (after == ord(x)) & (third == ord(y))
        for chosen, length in ((marks[two], 2), (marks[three], 3)):
            start[chosen + 1] = False
            if length == 3:
                start[chosen + 2] = False
            start[chosen + length] = True
    return np.flatnonzero(start[:n])


class Memo:
    """A direct-mapped table from 64-bit hashes to rows of numbers; what it has lost is made again."""

    def __init__(self, bits: int = 19, width: int = 1, dtype: type = np.int64) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.used = np.zeros(1 << bits, bool)
        self.values = np.zeros((1 << bits, width), dtype)

    def get(self, hashes: np.ndarray, compute) -> np.ndarray:
        """The rows of all hashes; compute(places) makes those of the first places of new hashes."""
        slots = (hashes >> self.shift).astype(np.int64)
        out = self.values[slots]
        missing = np.flatnonzero((self.keys[slots] != hashes) | ~self.used[slots])
        if len(missing):
            new, at, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rows = np.asarray(compute(missing[at])).reshape(len(new), -1)
            out[missing] = rows[inverse]
            # one writer a slot, so that key and value belong together
            slots, last = np.unique((new >> self.shift).astype(np.int64), return_index=True)
            self.keys[slots], self.used[slots], self.values[slots] = new[last], True, rows[last]
        return out if self.values.shape[1] > 1 else out[:, 0]
