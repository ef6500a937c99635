"""Vectorised word splitting and hashing on UTF-8 bytes.

Words are hashed with a random polynomial modulo 2**64; spans of words with two
independent polynomials, so a span has a 128-bit identity.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], _U))[0])


class Powers:
    """base**i and base**-i modulo 2**64 for an odd base, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, m, 1 << 64))])


_BYTES = Powers(mix_int(11))
_SPANS = (Powers(mix_int(12)), Powers(mix_int(13)))
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class Alphabet:
    """Which bytes belong to words, and how bytes are folded before hashing."""

    def __init__(self, is_word, fold=lambda b: b):
        self.word = np.array([is_word(fold(b)) for b in range(256)])
        self.codes = _CODES[np.array([fold(b) for b in range(256)])]


#: Words between ASCII white space, unchanged.
SPACED = Alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters after folding A-Z, and everything outside ASCII.
FOLDED = Alphabet(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80, lambda b: b + 32 if 0x41 <= b <= 0x5A else b)


def split(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
    """(starts, ends, first): byte spans of all words, and where each document's begin."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = np.zeros(n + 1, bool)
    word[:n] = alphabet.word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = word[:n].copy()
    begins[1:] &= ~word[: n - 1] | cut[1:n]
    stops = word[:n] & (~word[1:] | cut[1:])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes."""
    n = len(data)
    _BYTES.grow(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(alphabet.codes[data] * _BYTES.up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _BYTES.down[starts])


class Spans:
    """Hashes of arbitrary spans of one sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = []
        for p in _SPANS:
            p.grow(len(words) + 1)
            sums = np.zeros(len(words) + 1, _U)
            np.cumsum(words * p.up[: len(words)], out=sums[1:])
            self.sums.append(sums)

    def hash(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mix((s[end] - s[begin]) * _SPANS[which].down[begin] + (end - begin).astype(_U))
