"""Hashes of words and of runs of words, for all words of a slice at once.

word_hashes() tells words apart: two Rabin-Karp polynomials modulo the prime 2**31 - 1, each with a base of its own, in
one 64-bit number. Modulo 2**64 itself a polynomial over bytes is no safe hash, whatever its base: Thue-Morse words of
1024 bytes and their complements have the same. rough_word_hashes() is that cheaper hash, for features that may collide.
spans_hash() is for short runs of well mixed 64-bit numbers, where modulo 2**64 is fine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tillroll.llm._common import SPACES

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PRIME = (1 << 31) - 1
#: Bases of the two polynomials, primitive-looking numbers without relation to each other or to 256.
BASES = (1_178_496_407, 806_129_643)

SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
#: A random odd number for each byte.
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Coefficient of each byte modulo PRIME: none for white space, so that sums over words may run on to the next word.
_CODE = np.where(SPACE, 0, np.arange(256) + 1).astype(np.uint64)
_BYTE_OR_NONE = np.where(SPACE, 0, BYTE).astype(np.uint64)
#: Bytes whose products of 40 bits may be summed before they are reduced, and bytes that are hashed at once.
_UNREDUCED, BLOCK = 1 << 22, 1 << 16

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64 or PRIME, kept and grown as needed."""
    have = _powers.get((base, modulus), np.ones(1, np.uint64))
    while len(have) < n:
        step = have * np.uint64(pow(base, len(have), modulus))
        have = np.concatenate([have, step if modulus == 1 << 64 else step % np.uint64(modulus)])
    _powers[base, modulus] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] modulo 2**64, each from two prefix sums."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return (sums[end] - sums[start]) * powers(INVERSE, len(values) + 1)[start]


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    edges = np.flatnonzero(np.diff(SPACE[raw], prepend=True, append=True))
    return edges[::2], edges[1::2]


def _in_blocks(hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """hashes() of the segments that begin at start, for a block of bytes at a time, whose products stay in the cache."""
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(raw), BLOCK)), len(start)))
    edges = np.append(start, len(raw))
    return np.concatenate([np.zeros(0, np.uint64), *(hashes(raw[edges[a] : edges[b]], start[a:b] - start[a]) for a, b in zip(cuts, cuts[1:]))])


def _two_polynomials(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of what begins at each start and ends with white space or at the next."""
    code, p = _CODE[raw], np.uint64(PRIME)
    halves = []
    for base in BASES:
        terms = code * powers(base, len(raw), PRIME)
        if len(raw) > _UNREDUCED:  # a block is that long if one word is
            terms %= p
        halves.append(np.add.reduceat(terms, start) % p * powers(pow(base, -1, PRIME), len(raw), PRIME)[start] % p)
    return mix(halves[0] | halves[1] << np.uint64(31))


def _one_polynomial(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_BYTE_OR_NONE[raw] * powers(BASE, len(raw)), start) * powers(INVERSE, len(raw))[start]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that tell the words apart, and where they begin."""
    start, _ = word_edges(raw)
    return _in_blocks(_two_polynomials, raw, start), start


def segment_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of segments, which white space or other segments follow: together 126 bits and the length."""
    return _in_blocks(_two_polynomials, raw, start), mix(_in_blocks(_one_polynomial, raw, start) + (end - start).astype(np.uint64))


def rough_word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words modulo 2**64, and where they begin."""
    start, end = word_edges(raw)
    return mix(spans_hash(BYTE[raw], start, end) + (end - start).astype(np.uint64)), start
