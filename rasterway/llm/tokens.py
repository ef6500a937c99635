"""Exact byte-level BPE ids from the tokenizers library, with a cache of words.

The pre-tokenizer always splits a text where white space begins, before the last of
several white-space characters that precede a word, after a line break or tab before a
word, and between an ASCII letter or digit and an ASCII sign.
Encoding the pieces between these places and joining their ids equals encoding the
whole text.  Pieces are cut out and looked up in numpy, a chunk of texts at once;
the library sees each piece that is not in the cache once a chunk.

Texts with white space outside ASCII, or with the string of a special token (which
the library turns into that token's id), go to the library whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from rasterway.llm import shared as S
from rasterway.llm import words as W

#: Pieces that the cache can hold (a power of two), and ids of all its pieces.
SLOTS, ARENA = 1 << 20, 1 << 23
#: Bytes of a piece whose cache key is the piece itself.
SHORT = 23
_U = np.uint64

#: Kinds of bytes: space, other white space, letters and digits, signs, outside ASCII.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x20], _KIND[0x09:0x0E], _KIND[0x80:] = 0, 1, 4
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 2
#: Whether a piece begins between two kinds.
_CUT = np.zeros((8, 8), bool)
_CUT[2:, :2] = _CUT[1, 2:] = _CUT[2, 3] = True
_CUT = _CUT.ravel()
# White space outside ASCII, as UTF-8.
_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEAD = np.zeros(256, bool)
_LEAD[[s[0] for s in _SPACES]] = True
_SPACE_CODES = np.array(sorted({int.from_bytes(s.ljust(3, b"\0"), "big") for s in _SPACES}))
#: How a byte-level vocabulary shows bytes: printable ones as they are, the others from U+0100 on.
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)


def default_path() -> str:
    """The public byte-level vocabulary; installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _foreign_spaces(data: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII."""
    at = np.flatnonzero(_LEAD[data])
    if not len(at):
        return at
    last = len(data) - 1
    b = [data[np.minimum(at + k, last)].astype(np.int64) for k in range(3)]
    code = (b[0] << 16) + (b[1] << 8) + np.where(b[0] < 0xE0, 0, b[2])
    return at[np.isin(code, _SPACE_CODES)]


class Encoder:
    """Texts to ids; holds the library's tokenizer and a cache of bounded size."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        #: By slot: the piece's bytes and their number in three words, then place and number of its ids.
        self.table = np.zeros((SLOTS, 4), _U)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.arena = np.zeros(ARENA, self.dtype)
        self.used = 0

    def _ids(self, pieces: list[bytes]) -> list:
        """The library's ids of each piece."""
        out: list = [None] * len(pieces)
        # A word, with a space before it or not, is one token of the pre-tokenizer: the model takes it at once.
        tokenize = self.tokenizer.model.tokenize
        for k, p in enumerate(pieces):
            if p.lstrip(b" ").isalpha() and p[1:2] != b" ":
                out[k] = [t.id for t in tokenize(p.decode().replace(" ", "Ġ"))]
            elif (t := p.decode())[t[0] == " " :].isalpha():
                out[k] = [t.id for t in tokenize(p.decode("latin-1").translate(_SHOWN))]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) in the arena of each piece's ids."""
        ids = self._ids(pieces)
        number = np.array([len(x) for x in ids], np.int64)
        need = self.used + int(number.sum())
        if need > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(need - len(self.arena), self.dtype)])
        place = self.used + np.cumsum(number) - number
        if len(ids):
            self.arena[self.used : need] = list(chain.from_iterable(ids))
        self.used = need
        return place, number

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        if self.used > ARENA // 2:
            self._clear()
        whole = data.tobytes()
        kind = _KIND[data]
        begins = np.zeros(n + 1, bool)
        begins[1:n] = _CUT[kind[:-1] << 3 | kind[1:]]
        # The last of several white-space characters before a word is a piece's beginning, too.
        space = kind <= 1
        at = np.flatnonzero(space[1:-1] & space[:-2] & ~space[2:]) + 1
        if len(at):
            ends = np.zeros(n + 1, bool)
            ends[offsets] = True
            begins[at[~ends[at + 1]]] = True
        alone = set(np.searchsorted(offsets, _foreign_spaces(data), side="right").tolist())
        for mark in self.special:
            at = whole.find(mark)
            while at >= 0:
                alone |= {int(np.searchsorted(offsets, x, side="right")) for x in (at, at + len(mark) - 1)}
                at = whole.find(mark, at + 1)
        single = [(int(offsets[k - 1]), int(offsets[k])) for k in sorted(alone)]
        for a, b in single:
            begins[a:b] = False
        begins[offsets] = True
        cuts = np.flatnonzero(begins)
        starts, size = cuts[:-1], np.diff(cuts)
        place, number = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        eight = np.ndarray(n + 24, "<u8", padded, 0, (1,)).copy()
        short = np.flatnonzero(size <= SHORT)
        s, m = starts[short], size[short]
        key = [eight[s + 8 * k] & _MASKS[np.clip(m - 8 * k, 0, 8)] for k in range(3)]
        key[2] |= m.astype(_U) << _U(56)
        del eight, padded
        h = W.mix(key[0] ^ W.mix(key[1] ^ W.mix(key[2])))
        slot = (h & _U(SLOTS - 1)).astype(np.int64), (h >> _U(40) & _U(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(short))
        for where in slot:
            row = self.table.take(where[left], 0)
            known = (row[:, 0] == key[0][left]) & (row[:, 1] == key[1][left]) & (row[:, 2] == key[2][left])
            at, found = short[left[known]], row[known, 3]
            place[at], number[at] = found >> _U(32), found & _U(0xFFFFFFFF)
            left = left[~known]
        if len(left):
            _, one, back = np.unique(h[left], return_index=True, return_inverse=True)
            if any((k[left[one]][back] != k[left]).any() for k in key):  # two pieces with one hash
                _, one, back = np.unique(np.stack([k[left] for k in key], 1), axis=0, return_index=True, return_inverse=True)
                back = back.ravel()
            new = left[one]
            p, k = self._learn([whole[a : a + b] for a, b in zip(s[new].tolist(), m[new].tolist())])
            place[short[left]], number[short[left]] = p[back], k[back]
            taken = self.table[slot[0][new], 3] != 0
            to = np.where(taken, slot[1][new], slot[0][new])
            self.table[to] = np.stack([*(x[new] for x in key), p.astype(_U) << _U(32) | k.astype(_U)], 1)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            pieces = [whole[a : a + b] for a, b in zip(starts[long].tolist(), size[long].tolist())]
            new = list(dict.fromkeys(x for x in pieces if x not in self.long))
            if new:
                p, k = self._learn(new)
                self.long.update(zip(new, zip(p.tolist(), k.tolist())))
            found = np.array([self.long[x] for x in pieces], np.int64).reshape(-1, 2)
            place[long], number[long] = found[:, 0], found[:, 1]
            for x in new:
                if len(x) > 256:
                    del self.long[x]
        begin = np.cumsum(number) - number
        total = int(number.sum())
        source = np.repeat(place - begin, number)
        source += np.arange(total)
        ids = self.arena[source]
        ends = np.append(begin, total)
        return ids, ends[np.searchsorted(cuts, offsets)]

    def encode_column(self, column):
        """(first row, ids, offsets) of chunks of a string column; null counts as empty."""
        data, offsets = S.utf8(column)
        for i, j in S.chunks(offsets):
            ids, at = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield i, ids, at

    def encode_ended(self, column, end_id: int):
        """As encode_column, with little-endian uint32 ids and ``end_id`` behind each text."""
        for i, ids, at in self.encode_column(column):
            out = np.full(len(ids) + len(at) - 1, end_id, "<u4")
            ends = at[1:] + np.arange(len(at) - 1)
            keep = np.ones(len(out), bool)
            keep[ends] = False
            out[keep] = ids
            yield i, out, np.append(0, ends + 1)


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder, which keeps its words from task to task."""
    path = path or default_path()
    return S.kept(("encoder", path), lambda: Encoder(path))
