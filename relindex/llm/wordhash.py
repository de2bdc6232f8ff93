"""Hashes of words and of runs of words for a whole batch of texts at once (numpy)."""

from __future__ import annotations

import re

import numpy as np

#: Bytes of text hashed at once; longer texts are cut at blanks.
SLICE = 1 << 20
_BASE = 6364136223846793005
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (mod 2^64), kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1024)
        for name, x in (("up", _BASE), ("down", _BASE_INVERSE)):
            _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, dtype=np.uint64))])
    return _powers["up"], _powers["down"]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (for large arrays much faster than ``np.unique`` without counts)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Runs:
    """Hashes of all runs of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return scramble((self.sums[at + length] - self.sums[at]) * self.down[at])


def _slices(raw: list[bytes]):
    """(parts, numbers of the texts they belong to) of about ``SLICE`` bytes, in order."""
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, t in enumerate(raw):
        at = 0
        while len(t) - at > SLICE:
            m = _NEXT_BLANK.search(t, at + SLICE)
            end = m.start() if m else len(t)
            yield [t[at:end]], [i]
            at = end
        rest = t[at:] if at else t
        if size + len(rest) > SLICE and parts:
            yield parts, owner
            parts, owner, size = [], [], 0
        parts.append(rest)
        owner.append(i)
        size += len(rest) + 1
    if parts:
        yield parts, owner


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(raw), dtype=np.int64)
    for parts, owner in _slices(raw):
        buf = b" ".join(parts) + b" "
        b = np.frombuffer(buf, dtype=np.uint8)
        blank = _BLANK[b]
        begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        hashes.append(Runs(BYTE_CODE[b]).of(begin, end - begin))
        edges = np.cumsum([len(p) + 1 for p in parts])
        np.add.at(counts, owner, np.diff(np.concatenate([[0], np.searchsorted(begin, edges)])))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x
