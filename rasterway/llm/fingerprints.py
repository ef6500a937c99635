"""Document fingerprints by consistent weighted sampling.

The weight of a word is how often a text has it.  For each of ``SAMPLES`` samples every
word draws, from its own hash, r and c of Gamma(2, 1) and b of the unit
interval; with t = floor(ln w / r + b) its sample value is
ln c - r (t - b) - r, and the word with the smallest value is the sample, together
with t.  Two texts agree in a sample with the probability of their generalised
Jaccard similarity, the sum of smaller weights over the sum of larger ones.

Neighbouring documents are compared within sorted partitions; only the last
document of each partition meets the first of the next in a join of one row a partition.

Defined results: null and empty texts and others without words have the fingerprint of no
words, which is like itself and unlike all others; rows that share an id come in the order
of a text hash (equal ones are equal rows), null ids first; a single document is its own
next; an empty table gives no row; texts of any length are read whole; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm import words as W

SAMPLES = 96
#: Text characters whose words draw their numbers at once.
CHUNK = 4 << 20
#: Words that draw at once: their numbers stay in the processor's cache.
ROWS = 256
#: Values that are held at once, in words.
HELD = 1 << 16
_U = np.uint64
_NONE = np.zeros(SAMPLES, np.uint16)
_SEEDS = W.mix(np.arange(1, 3 * SAMPLES + 1, dtype=_U)).reshape(3, 1, SAMPLES)
_HALF = _U(0xFFFFFFFF)


def _unit(bits: np.ndarray) -> np.ndarray:
    """32 random bits to the open unit interval."""
    return ((bits >> _U(8)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _values(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Every sample's value of words and their logarithmic weights, with the sample it would be.

    The value, as an integer in the same order, fills the upper 32 bits, the sample's
    16 bits the lower ones, so that the smallest number carries its sample along.
    """
    out = np.empty((len(words), SAMPLES), _U)
    for i in range(0, len(words), ROWS):
        own, weight = words[i : i + ROWS, None], weights[i : i + ROWS, None]
        x, y, z = (W.mix(own + s) for s in _SEEDS)
        r = -np.log(_unit(x >> _U(32)) * _unit(x & _HALF))
        c = np.log(-np.log(_unit(y >> _U(32)) * _unit(y & _HALF)))
        b = _unit(z >> _U(32))
        t = np.floor(weight / r + b)
        bits = (c - r * (t - b + 1)).view(np.int32)
        ordered = np.where(bits < 0, ~bits, bits | np.int32(-(2**31))).view(np.uint32)
        sample = W.mix(own ^ (t.astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15) + _SEEDS[0])) >> _U(48) | _U(1)
        out[i : i + ROWS] = ordered.astype(_U) << _U(32) | sample
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) 16-bit samples of UTF-8 texts."""
    starts, ends, first = W.split(data, offsets, W.SPACED)
    words = W.hashes(data, starts, ends, W.SPACED)
    n = len(offsets) - 1
    best = np.full((n, SAMPLES), 2**64 - 1, _U)
    if not len(words):
        return np.tile(_NONE, (n, 1))
    known, word = np.unique(words, return_inverse=True)
    # Distinct words of each document with their numbers; then distinct pairs of word and number.
    doc = np.repeat(np.arange(n), np.diff(first))
    cell, count = np.unique(doc * len(known) + word, return_counts=True)
    doc, word = cell // len(known), cell % len(known)
    most = int(count.max()) + 1
    pair, at = np.unique(word * most + count, return_inverse=True)
    for a in range(0, len(pair), HELD):
        some = pair[a : a + HELD]
        values = _values(known[some // most], np.log(some % most).astype(np.float32))
        inside = np.flatnonzero((at >= a) & (at < a + HELD)) if len(pair) > HELD else np.arange(len(at))
        row, d = at[inside] - a, doc[inside]
        cuts = np.append(np.flatnonzero(np.diff(d, prepend=-1)), len(d)).tolist()
        for x, y in zip(cuts, cuts[1:]):
            own = best[d[x]]
            np.minimum(own, values.take(row[x:y], 0).min(0), out=own)
    return np.where(best == 2**64 - 1, 0, best & _U(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _utf8(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return S.utf8(pa.array(texts, pa.large_string()))


def edited(text: str, following: str) -> str:
    """``text`` with its second half, rounded down, replaced by as much of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_SCHEMA = "kind string, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """(doc_id, text, next text) to results."""
    halves = [edited(t, n) for _, t, n in rows]
    texts = list(dict.fromkeys([*(t for _, t, _ in rows), *(n for _, _, n in rows), *halves]))
    prints = dict(zip(texts, fingerprints(*_utf8(texts))))
    out = []
    for (doc, text, following), half in zip(rows, halves):
        f, e, n = prints[text], prints[half], prints[following]
        out.append(("done", None, doc, None, len(text), hashlib.sha256(half.encode()).hexdigest(), f.astype(">u2").tobytes().hex(), e.astype(">u2").tobytes().hex(), float(likeness(f, e)), float(likeness(f, n))))
    return _batch(out)


def _sized(rows):
    """``rows`` in lists of about CHUNK characters."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _partition(batches):
    """Sorted documents to results; the first and the last go on as head and tail."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist())))
        if not rows:
            continue
        if last is None:
            yield _batch([("head", part, *rows[0], None, None, None, None, None, None)])
        else:
            rows.insert(0, last)
        for some in _sized([(*a, b[1]) for a, b in zip(rows, rows[1:])]):
            yield _compared(some)
        last = rows[-1]
    if last is not None:
        yield _batch([("tail", part, *last, None, None, None, None, None, None)])


def _ends(batches):
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist()))
        for some in _sized(rows):
            yield _compared(some)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its fingerprint, its edited text's, and how like they and the next are."""
    n = S.groups_for(docs, group_bytes=2 * S.GROUP_BYTES)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = slim.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    found = S.written(ordered.mapInArrow(_partition, _SCHEMA))
    heads = found.where("kind = 'head'")
    # One number a partition; the last partition meets the first.
    parts = heads.select("part")
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.orderBy(F.lit(1)))).alias("next"))
    pairs = found.where("kind = 'tail'").select("part", "doc_id", "text").join(following, "part")
    pairs = pairs.join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")
    ends = pairs.mapInArrow(_ends, _SCHEMA)
    return found.where("kind = 'done'").unionByName(ends).drop("kind", "part", "text")
