"""Locally consistent parsing of word sequences by recompression.

A round first names maximal runs of one symbol, then names pairs: a per-round
coin splits the alphabet into left and right symbols, and each left symbol
directly before a right one is joined with it.  Names are hashes of what they
name, so all tasks give equal strings equal names without exchanging a
dictionary, and equal substrings get the same symbols except near their ends.
How near is tracked: ``lo`` and ``hi`` bound the words that a symbol's existence
depends on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rasterway.llm.words import mix, mix_int

_U = np.uint64


@dataclass
class Symbols:
    """Symbols of consecutive documents: ``name`` over words ``begin:end`` of ``doc``."""

    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def take(self, at: np.ndarray) -> "Symbols":
        return Symbols(*(None if x is None else x[at] for x in (self.name, self.begin, self.end, self.doc, self.lo, self.hi)))


def words_as_symbols(words: np.ndarray, first: np.ndarray) -> Symbols:
    """One symbol a word; ``first`` are the documents' word offsets."""
    at = np.arange(len(words), dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Symbols(words, at, at + 1, doc, at.copy(), at + 1)


def _context(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The left neighbour's ``lo`` and the right one's ``hi``; beyond the document at its ends."""
    n = len(s.name)
    left, right = s.begin - 1, s.end + 1
    if n > 1:
        same = s.doc[1:] == s.doc[:-1]
        left[1:] = np.where(same, s.lo[:-1], left[1:])
        right[:-1] = np.where(same, s.hi[1:], right[:-1])
    return left, right


def name_runs(s: Symbols, level: int) -> Symbols:
    """Each maximal run of two or more equal symbols becomes one symbol."""
    n = len(s.name)
    if not n:
        return s
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    head = np.flatnonzero(new)
    if s.lo is not None:
        s.lo, s.hi = _context(s)
    if len(head) == n:
        return s
    tail = np.append(head[1:], n) - 1
    out = s.take(head)
    out.end = s.end[tail]
    if s.lo is not None:
        out.hi = s.hi[tail]
    count = (tail - head + 1).astype(_U)
    run = count > 1
    out.name = out.name.copy()
    out.name[run] = mix(out.name[run] ^ mix(count[run] + _U(mix_int(level * 2 + 1))))
    return out


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Each left symbol before a right symbol is joined with it."""
    n = len(s.name)
    if n < 2:
        return s
    left = (mix(s.name ^ _U(mix_int(level * 2 + 2))) >> _U(63)).astype(bool)
    same = s.doc[1:] == s.doc[:-1]
    join = np.zeros(n, bool)
    join[:-1] = left[:-1] & ~left[1:] & same
    if s.lo is not None:
        before, after = _context(s)
        single = ~join
        single[1:] &= ~join[:-1]
        s.hi = np.where(single & left, after, s.hi)
        s.lo = np.where(single & ~left, before, s.lo)
    keep = np.ones(n, bool)
    keep[1:] = ~join[:-1]
    at = np.flatnonzero(keep)
    out, joined = s.take(at), join[at]
    second = at[joined] + 1
    out.name[joined] = mix(out.name[joined] * _U(0x9E3779B97F4A7C15) + mix(s.name[second] + _U(mix_int(level))))
    out.end[joined] = s.end[second]
    if s.lo is not None:
        out.hi[joined] = np.maximum(out.hi[joined], s.hi[second])
    return out


def low_symbols(words: np.ndarray, first: np.ndarray, rounds: int) -> Symbols:
    """Short symbols with the words that each depends on."""
    s = name_runs(words_as_symbols(words, first), 0)
    for level in range(1, rounds + 1):
        s = name_pairs(s, level)
    return s


def high_symbols(s: Symbols, rounds: int, level: int) -> Symbols:
    """``rounds`` more rounds of runs and pairs, without contexts."""
    s = Symbols(s.name, s.begin, s.end, s.doc)
    for r in range(level, level + rounds):
        s = name_pairs(name_runs(s, r), r)
    return s
