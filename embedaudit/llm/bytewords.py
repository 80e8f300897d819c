"""Words of many texts as arrays: bounds and 64-bit fingerprints, without an object for each word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Texts are taken together up to so many bytes; longer ones alone.
CHUNK = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all of theirs."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = {int(base): mix(np.arange(256, dtype=np.uint64), k + 1) for k, base in enumerate((BASE, SECOND_BASE))}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    known = _POWERS.setdefault(int(base), [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(known[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, x in enumerate((int(base), pow(int(base), -1, 1 << 64))):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                known[k] = np.multiply.accumulate(steps)
    return known[0][:n], known[1][:n]


class Rolling:
    """Fingerprints of any ranges of one array of bytes."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE):
        powers, self.inverse = _powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[int(base)][data] * powers[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def fixed(self, n: int) -> np.ndarray:
        """Of every range of n bytes."""
        return mix((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.inverse[: len(self.sums) - n] + np.uint64(n))


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, each followed by a space
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and of all words


def chunks(texts: list[bytes], most: int = CHUNK):
    """Ranges of texts with at most so many bytes together, or one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text) + 1
    if texts:
        yield start, len(texts)


def words(texts: list[bytes], lower: bool = True) -> Words:
    """Words are what bytes 0x20 and 0x09-0x0D separate; A-Z are lower-cased."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    data = _LOWER[data] if lower else data
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    limits = np.append(0, np.cumsum([len(x) + 1 for x in texts])) if texts else np.zeros(1, np.int64)
    return Words(data, starts, ends, np.searchsorted(starts, limits))
