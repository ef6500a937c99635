"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (A-Z folded) and all characters outside
ASCII.  A window is ``window`` consecutive words of an item, or all words of a
shorter item.  A document word inside any occurrence of a window is hit.

1. Of every ``guarantee`` = window - k + 1 consecutive k-word hashes, winnowing
   keeps the smallest, in items and documents alike, so that a shared span of
   ``window`` words always shares a kept hash.
2. The items' kept hashes fill a Bloom filter of fixed size, which each task
   uses to drop document fingerprints that no item has.  It only saves
   traffic: where it fills up, more rows go on and the result stays the same.
3. Each fingerprint left is extended to the windows around it, and these are
   joined with the items' windows on a 128-bit hash of all their words.
   Items shorter than a window are found by hashing all spans of their lengths.

Defined results: null and empty texts have no words, hits or items; items
without words have no window; a null item id names no item, but its windows hit; repeated rows each
get their result; rows that share an id each count for themselves; texts of any length are
read whole; an empty table gives no row, and without items nothing is hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm import words as W

#: Words of a fingerprint.
K = 5
#: Bits of the Bloom filter: 8 MB whatever the items' number.
BLOOM_BITS = 1 << 26
#: Parts that the occurrences of one window are dealt into.
SALTS = 64
_U = np.uint64


def _rolling_min(x: np.ndarray, w: int) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for i in range(1, w):
        np.minimum(out, x[i : len(x) - w + 1 + i], out=out)
    return out


def winnowed(h: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``w`` consecutive ones of a document.

    ``h[i]`` is the hash of the k-gram at i; ``first`` bounds the documents'
    valid positions as (begin, end) rows.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _rolling_min(h, w)
    inside = np.zeros(len(low), bool)
    for a, b in first:
        inside[a : max(a, b - w + 1)] = True
    keep = np.zeros(len(h), bool)
    for i in range(w):
        keep[i : i + len(low)] |= inside & (h[i : i + len(low)] == low)
    return np.flatnonzero(keep)


def _grams(spans: W.Spans, first: np.ndarray, k: int, which: int = 0):
    """(hash of the k words at every position, valid positions as ranges)."""
    n = int(first[-1])
    at = np.arange(max(0, n - k + 1))
    h = spans.hash(at, at + k, which)
    ranges = [(a, max(a, b - k + 1)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return h, ranges


def _valid(n: int, ranges) -> np.ndarray:
    ok = np.zeros(n, bool)
    for a, b in ranges:
        ok[a:b] = True
    return np.flatnonzero(ok)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h % _U(BLOOM_BITS)).astype(np.int64), (W.mix(h) % _U(BLOOM_BITS)).astype(np.int64)


def _in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    return ((bloom[a >> 3] >> (a & 7)) & (bloom[b >> 3] >> (b & 7)) & 1).astype(bool)


def _chunked(batch):
    data, offsets = S.utf8(batch.column("text"))
    for i, j in S.chunks(offsets, S.WIDE_CHUNK_BYTES):
        chunk = data[offsets[i] : offsets[j]]
        starts, ends, first = W.split(chunk, offsets[i : j + 1] - offsets[i], W.FOLDED)
        yield i, j, W.hashes(chunk, starts, ends, W.FOLDED), first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def _item_windows(window: int):
    """Items to windows (len, two hashes) and to the fingerprints to look for."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").cast(pa.string())
            for i, _, words, first in _chunked(batch):
                spans = W.Spans(words)
                size = np.diff(first)
                item, at, length = [], [], []
                for k in np.flatnonzero(size):
                    m = min(window, size[k])
                    starts = np.arange(first[k], first[k + 1] - m + 1)
                    at.append(starts)
                    item.append(np.full(len(starts), k))
                    length.append(np.full(len(starts), m))
                if at:
                    at, item, length = map(np.concatenate, (at, item, length))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(item + i)), pa.array(length.astype(np.int32)), _signed(spans.hash(at, at + length)), _signed(spans.hash(at, at + length, 1)), pa.nulls(len(at), pa.int64())],
                        ["item", "len", "h1", "h2", "mark"],
                    )
                # Fingerprints of whole windows, all spans of the shorter items.
                h, ranges = _grams(spans, first, K)
                marks = winnowed(h, ranges, window - K + 1)
                if len(marks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(marks), pa.string()), pa.array(np.full(len(marks), K, np.int32)), _signed(np.zeros(len(marks))), _signed(np.zeros(len(marks))), _signed(h[marks])], ["item", "len", "h1", "h2", "mark"]
                    )

    return run


def _document_spans(window: int, bloom, lengths: list[int], marked: bool):
    """Documents to their word counts and the spans that may be items' windows."""

    def run(batches):
        bits = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            rows = batch.column("_row")
            for i, j, words, first in _chunked(batch):
                spans, n = W.Spans(words), len(words)
                doc, at, length = [np.arange(j - i)], [np.full(j - i, -1)], [np.diff(first)]

                def add(starts, m):
                    d = np.searchsorted(first, starts, side="right") - 1
                    doc.append(d)
                    at.append(starts - first[d])
                    length.append(np.full(len(starts), m))

                if marked and n >= window:
                    h, ranges = _grams(spans, first, K)
                    marks = winnowed(h, ranges, window - K + 1)
                    marks = marks[_in_bloom(bits, h[marks])]
                    near = np.zeros(n + 1, bool)
                    for shift in range(window - K + 1):
                        near[np.maximum(marks - shift, 0)] = True
                    add(np.intersect1d(np.flatnonzero(near), _valid(n, [(a, max(a, b - window + 1)) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]), assume_unique=True), window)
                for m in lengths:
                    h, ranges = _grams(spans, first, m)
                    ok = _valid(len(h), ranges)
                    add(ok[_in_bloom(bits, h[ok] + _U(m))], m)
                doc, at, length = map(np.concatenate, (doc, at, length))
                begin = first[doc] + np.maximum(at, 0)
                end = np.where(at < 0, begin, begin + length)
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(doc + i)), pa.array(at.astype(np.int32)), pa.array(length.astype(np.int32)), _signed(spans.hash(begin, end)), _signed(spans.hash(begin, end, 1))],
                    ["_row", "at", "len", "h1", "h2"],
                )

    return run


def _bloom_of(marks: DataFrame) -> bytes:
    """The filter over marks (mark, len): OR-ed word by word in Spark, then 8 MB at most."""

    def bits(batches):
        for batch in batches:
            h = batch.column("mark").to_numpy(zero_copy_only=False).view(_U)
            at = np.unique(np.concatenate(_bits(h)))
            word, n = np.unique(at >> 5, return_inverse=True)
            value = np.zeros(len(word), np.int64)
            np.bitwise_or.at(value, n, np.int64(1) << (at & 31))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], ["word", "bits"])

    words = marks.select("mark").mapInArrow(S.lean(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.toArrow()
    bloom = np.zeros(BLOOM_BITS // 32, np.uint32)
    bloom[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return bloom.tobytes()


def hits(docs: DataFrame, items: DataFrame, key: str, window: int = 10) -> DataFrame:
    """Per value of ``key`` (unique rows of docs): n_words, n_hit, ranges of hit words, items.

    ``docs`` needs ``key`` and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    found = S.written(items.select("item_id", "text").mapInArrow(S.lean(_item_windows(window)), "item string, len int, h1 long, h2 long, mark long"))
    windows = found.where("mark IS NULL").select("item", "len", "h1", "h2").distinct()
    lengths = sorted(r[0] for r in found.where(f"mark IS NULL AND len < {window}").select("len").distinct().collect())

    def short_marks(batches):
        for b in batches:
            h = b.column("h1").to_numpy(zero_copy_only=False).view(_U) + b.column("len").to_numpy(zero_copy_only=False).astype(_U)
            yield pa.RecordBatch.from_arrays([_signed(h)], ["mark"])

    short = found.where(f"mark IS NULL AND len < {window}").select("h1", "len").mapInArrow(short_marks, "mark long")
    marked = found.where("mark IS NOT NULL").limit(1).count() > 0
    bloom = spark.sparkContext.broadcast(_bloom_of(found.where("mark IS NOT NULL").select("mark").unionByName(short)))
    spans = docs.select(F.col(key).alias("_row"), "text").mapInArrow(S.lean(_document_spans(window, bloom, lengths, marked)), f"_row {docs.schema[key].dataType.simpleString()}, at int, len int, h1 long, h2 long")
    # An item's ids first: a window that many items share joins once.
    owners = windows.groupBy("len", "h1", "h2").agg(F.collect_set("item").alias("items"))
    # A passage may stand in a third of all documents: its windows are salted.
    owners = owners.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    places = spans.where("at >= 0").withColumn("salt", F.pmod(F.xxhash64("_row", "at"), F.lit(SALTS)).cast("int")).join(owners, ["len", "h1", "h2", "salt"])
    totals = spans.where("at < 0").select("_row", F.col("len").cast("long").alias("n_words"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    rows = totals.unionByName(places.select("_row", F.lit(None).cast("long").alias("n_words"), "at", "len", "items"))
    order = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("b"), (F.col("at") + F.col("len")).alias("e")))))
    merged = rows.groupBy("_row").agg(F.max("n_words").alias("n_words"), order.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Words hit: each range adds what lies beyond the furthest end so far.
    step = lambda acc, x: F.struct(F.greatest(acc["far"], x["e"]).alias("far"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["far"], x["b"]))).alias("n"))
    n_hit = F.aggregate("r", F.struct(F.lit(0).alias("far"), F.lit(0).alias("n")), step)["n"].cast("long")
    return merged.select(F.col("_row").alias(key), "n_words", n_hit.alias("n_hit"), F.col("r").alias("ranges"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted as strings) and contaminated.

    Needs doc_id and text; other columns stay, and new names replace old ones.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated", "_key")
    # The text's hash tells rows apart that share an id; equal rows have equal results.
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))
    found = hits(keyed.select("_key", "text"), items, "_key", window)
    found = found.select("_key", "n_words", "n_hit", F.col("items").alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"))
    return keyed.join(found, keyed["_key"].eqNullSafe(found["_key"])).drop("_key")
