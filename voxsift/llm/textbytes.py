"""Words, shingles and n-grams of one text as numpy arrays of 64-bit hashes.

A text is taken as its UTF-8 bytes, so classes of ASCII characters are exact and other characters pass
through. The cost is linear in the text's length; nothing is cut. Two different words share a hash with
a chance of about 2 to the power of -64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEED = np.random.default_rng(20240917)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = 64
BASE = _U(0x9E3779B97F4A7C15)
MIX1, MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cased; all ASCII that is neither a letter nor a digit becomes a space.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
#: The six white space characters \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_TABLE = _powers(_POWERS)


def byte_array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of bytes that are not white space."""
    inside = np.empty(len(codes) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(IS_SPACE[codes], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    within = np.arange(int(offsets[-1] + lengths[-1])) - np.repeat(offsets, lengths)
    longest = int(lengths.max())
    powers = _TABLE if longest <= _POWERS else _powers(longest)
    values = BYTE_CODE[codes[np.repeat(starts, lengths) + within]] * powers[within]
    return mixed(np.add.reduceat(values, offsets) + lengths.astype(np.uint64))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` consecutive items; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= BASE
        total += hashes[k : k + n]
    return mixed(total ^ _U(size))


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; with fewer words, the whole sequence as one."""
    codes = byte_array(data)
    words = word_hashes(codes, *word_bounds(codes))
    if not len(words):
        return words
    return np.unique(runs(words, min(size, len(words))))


def char_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    return runs(BYTE_CODE[codes], size)
