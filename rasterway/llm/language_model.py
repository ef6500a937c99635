"""A trigram model by deleted interpolation, and what it says of whole texts.

The probability of a word after two others is a mixture of the maximum-likelihood
estimates of the trigram and of the bigram and of a smoothed unigram estimate.  Mixture
weights belong to buckets of how often both contexts have been seen.  A fifth of the
training documents is deleted while weights are learned: n-grams of the others are
counted, and expectation-maximisation fits the weights to the deleted ones; then all
training documents count.

A task gathers documents into chunks and sends each distinct n-gram of a chunk once, in
sorted lists, to buckets of n-gram hashes; buckets add the lists up and send the sums
back in the same order.  A chunk's n-grams never pass as rows, and a frequent n-gram is
one entry a chunk.  All three kinds of contexts are n-grams themselves, so no more is asked
for.  Expectation-maximisation needs ratios of estimates only: a table of how many deleted
positions have each ratio (in steps of a quarter of a power of two, with mean logarithms)
is counted over all of them, bounded by its cells, and the driver iterates over that table.

Words are known by hashes of 64 bits, n-grams by 40 bits more than tell their bucket: about
one n-gram in a million shares its count with another.

Defined results: null and empty texts are the end alone; rows that share an id and
repeated rows are scored, and learned from, each; without training documents the base
score of every token is 0, and so is the score; texts of any length are scored whole; an
empty table gives no row; columns other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm import words as W

#: Text bytes of a chunk (each document counts a few more), n-grams that a bucket should receive.
CHUNK_BYTES, BUCKET_GRAMS = 8 << 20, 1 << 20
#: Bits of an n-gram's hash beyond those that its bucket needs.
BITS = 40
#: Buckets of context counts: none, one, then a bucket a power of two up to this one.
CLASSES = 14
#: Steps of a power of two in the table of ratios, and its largest entry.
STEPS, MOST = 4, 200
#: Rounds of expectation-maximisation, and the positions that the weights of all buckets count as in each.
ROUNDS, PRIOR = 40, 20.0
#: Parts of a document in training: counted always, deleted while weights are learned, not in training.
FIT, TUNE, APART = 0, 1, 2

_U = np.uint64
#: Words between ASCII white space with A-Z in lower case.
LOWER = W.Alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, lambda b: b + 32 if 0x41 <= b <= 0x5A else b)
_START0, _START1, _END = (_U(W.mix_int(k)) for k in (31, 32, 33))
_FACTORS = {2: _U(W.mix_int(34) | 1), 3: _U(W.mix_int(35) | 1)}
_ASKED = np.dtype([("delta", "<u8"), ("fit", "<u8"), ("all", "<u8")])
_TOLD = np.dtype([("fit", "<u8"), ("all", "<u8")])
_HASHES, _IDS = np.dtype([("delta", "<u8")]), np.dtype([("id", "<u4")])
_CHUNK = "chunk long, doc_id array<long>, role array<int>, n array<long>, words binary, ids binary"
_ANSWER = "chunk long, bucket int, kind int, counts binary, fit long, all long"


def _deltas(values: np.ndarray, dtype) -> np.ndarray:
    out = np.zeros(len(values), dtype)
    out["delta"] = np.diff(values, prepend=_U(0))
    return out


def _tokenised(batches):
    """Chunks of documents: their ids, roles and numbers of tokens, distinct word hashes, and every token's place among these."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    parts: list[tuple] = []

    def out():
        ids, roles, sizes, hashes = (np.concatenate(x) if x else np.zeros(0) for x in ([p[k] for p in parts] for k in range(4)))
        words, at = np.unique(hashes, return_inverse=True)
        tokens = np.empty(len(at), _IDS)
        tokens["id"] = at
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("role", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("words", pa.binary()), ("ids", pa.binary())])
        row = [[chunk], [[None if x == -(2**63) else int(x) for x in ids]], [roles.tolist()], [sizes.tolist()], [S.pack(_deltas(words, _HASHES))], [S.pack(tokens)]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

    for batch in batches:
        ids, roles = S.longs(batch.column("doc_id")), batch.column("role").to_numpy()
        data, offsets = S.utf8(batch.column("text"))
        for i, j in S.chunks(offsets):
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = W.split(part, bounds, LOWER)
            first = np.append(first[:-1], len(starts))
            # Two starts before each document's words and an end behind them.
            size = np.diff(first)
            hashes = np.empty(len(starts) + 3 * (j - i), _U)
            begin = first[:-1] + 3 * np.arange(j - i)
            hashes[begin], hashes[begin + 1], hashes[begin + 2 + size] = _START0, _START1, _END
            if len(starts):
                hashes[np.arange(len(starts)) + 3 * np.repeat(np.arange(j - i), size) + 2] = W.hashes(part, starts, ends, LOWER)
            parts.append((ids[i:j], roles[i:j], size + 1, hashes))
            held += len(part) + 64 * (j - i)
            if held >= CHUNK_BYTES:
                yield out()
                parts, held, chunk = [], 0, chunk + 1
    if parts:
        yield out()


class _Chunk:
    """The n-grams of a chunk row."""

    def __init__(self, role, n, words, ids):
        self.role, self.n = np.asarray(role, np.int64), np.asarray(n, np.int64)
        tokens = np.cumsum(S.unpack([words], _HASHES)["delta"])[S.unpack([ids], _IDS)["id"]]
        self.tokens = tokens
        length = self.n + 2
        self.begin = np.cumsum(length) - length
        #: Place in its document (starts are 0 and 1), and part in training, of every token.
        self.place = np.arange(len(tokens)) - np.repeat(self.begin, length)
        self.roles = np.repeat(self.role, length)

    def grams(self, buckets: int):
        """(kind, places, sorted distinct hashes, the hash of each place, their buckets) for kinds 1 to 3."""
        h = self.tokens
        bits = max(1, (buckets - 1).bit_length())
        for kind in (1, 2, 3):
            if kind > 1:
                h = W.mix(np.append(_U(0), h[:-1]) * _FACTORS[kind] + self.tokens)
            places = np.flatnonzero(self.place >= (0, 1, 1, 2)[kind])
            short = _U(0 if kind == 1 else max(0, 64 - BITS - bits))
            keys, at = np.unique(h[places] >> short, return_inverse=True)
            yield kind, places, keys, at, ((keys >> (_U(40) - short)) * _U(buckets) >> _U(24)).astype(np.int64)


def _chunks_of(batch):
    columns = [batch.column(c) for c in ("role", "n", "words", "ids")]
    for k in range(batch.num_rows):
        yield k, _Chunk(*(c[k].as_py() for c in columns))


def _asked(buckets: int):
    """Each chunk's distinct n-grams, with their counts in both parts of the training documents, to their buckets."""

    def run(batches):
        for batch in batches:
            for k, chunk in _chunks_of(batch):
                for kind, places, keys, at, bucket in chunk.grams(buckets):
                    role = chunk.roles[places]
                    fit, tune = (np.bincount(at[role == r], minlength=len(keys)) for r in (FIT, TUNE))
                    to = np.flatnonzero(np.diff(bucket, prepend=-1))
                    rows = []
                    for a, b in zip(to, np.append(to[1:], len(keys))):
                        record = _deltas(keys[a:b], _ASKED)
                        record["fit"], record["all"] = fit[a:b], fit[a:b] + tune[a:b]
                        rows.append((int(bucket[a]), S.pack(record)))
                    names = ["bucket", "kind", "chunk", "grams"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([batch.column("chunk")[k].as_py()] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """Sums over all chunks, to each chunk in the order in which it asked; and how many words there are."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    lists = [S.unpack([blob.as_buffer().to_pybytes()], _ASKED) for chunk in table.column("grams").chunks for blob in chunk]
    keys, at = np.unique(np.concatenate([np.cumsum(x["delta"]) for x in lists]), return_inverse=True)
    told = np.zeros(len(keys), _TOLD)
    for part in ("fit", "all"):
        np.add.at(told[part], at, np.concatenate([x[part] for x in lists]))
    blobs, a = [], 0
    for x in lists:
        blobs.append(S.pack(told[at[a : a + len(x)]]))
        a += len(x)
    m = len(lists)
    words = ~np.isin(keys, [_START0, _START1]) if kind == 1 else np.zeros(len(keys), bool)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "bucket": pa.array([bucket] * (m + 1), pa.int32()), "kind": pa.array([kind] * (m + 1), pa.int32()), "counts": pa.array([*blobs, None], pa.binary()),
            **{p: pa.array([None] * m + [int((words & (told[p] > 0)).sum())], pa.int64()) for p in ("fit", "all")},
        }
    )


def _counted(buckets: int):
    """A chunk with the counts of the three n-grams that end at each of its tokens."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = answers.column("kind").to_numpy()
        blobs = answers.column("counts").combine_chunks()
        out = []
        for _, chunk in _chunks_of(rows):
            own = []
            for kind, places, _, at, _ in chunk.grams(buckets):
                counts = np.zeros(len(chunk.tokens), _TOLD)
                counts[places] = S.unpack((blobs[int(k)].as_buffer() for k in np.flatnonzero(kinds == kind)), _TOLD)[at]
                # Counts without the deleted part matter at deleted places and at the starts before them.
                counts["fit"][chunk.roles != TUNE] = 0
                own.append(S.pack(counts))
                del counts, at, places
            out.append(own)
        return rows.select(["chunk", "doc_id", "role", "n"]).append_column("counts", pa.array(out, pa.list_(pa.binary())))

    return run


def _class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1).astype(float)).astype(np.int64) + 1, CLASSES), 0)


def _unpacked(counts: pa.Scalar, part: str) -> list[np.ndarray]:
    """The counts of one part of the training documents, by kind."""
    return [S.unpack([blob.as_buffer()], _TOLD)[part].copy() for blob in counts.values]


def _estimates(counts: list[np.ndarray], at: np.ndarray, total: int, words: int):
    """(bucket, trigram, bigram, smoothed unigram estimate) at the places ``at``."""
    one, two, three = counts
    with np.errstate(divide="ignore", invalid="ignore"):
        m3 = np.where(two[at - 1] > 0, three[at] / two[at - 1], 0.0)
        m2 = np.where(one[at - 1] > 0, two[at] / one[at - 1], 0.0)
    base = (one[at] + 0.5) / (total + 0.5 * (words + 1))
    return _class(two[at - 1]) * (CLASSES + 1) + _class(one[at - 1]), m3, m2, base


def _ratio(m: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, logarithm) of m / base; cell 0 is m = 0."""
    log = np.log2(np.where(m > 0, m, base) / base)
    return np.where(m > 0, np.clip(np.round(log * STEPS).astype(np.int64) + MOST // 4, 1, MOST), 0), log


def _ratios(total: int, words: int):
    """How many deleted positions have which ratios of estimates: bucket, cells, number, sums of logarithms."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                role, n = (np.asarray(batch.column(c)[k].as_py(), np.int64) for c in ("role", "n"))
                counts = _unpacked(batch.column("counts")[k], "fit")
                at = _predicted(n)
                at = at[np.repeat(role, n) == TUNE]
                bucket, m3, m2, base = _estimates(counts, at, total, words)
                (c3, l3), (c2, l2) = _ratio(m3, base), _ratio(m2, base)
                cells, back = np.unique((bucket * (MOST + 1) + c3) * (MOST + 1) + c2, return_inverse=True)
                sums = [np.bincount(back, w, len(cells)) for w in (None, l3, l2)]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[0].astype(np.int64)), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())], ["cell", "n", "log3", "log2"])

    return run


def _predicted(n: np.ndarray) -> np.ndarray:
    """Places of the tokens that are predicted, in order."""
    return np.arange(n.sum()) + 2 * np.repeat(np.arange(1, len(n) + 1), n)


def weights(cells: np.ndarray, number: np.ndarray, log3: np.ndarray, log2: np.ndarray) -> np.ndarray:
    """Mixture weights (bucket, order 3, 2, 1) by expectation-maximisation over a table of ratios."""
    buckets = (CLASSES + 1) ** 2
    bucket, c3, c2 = cells // (MOST + 1) ** 2, cells // (MOST + 1) % (MOST + 1), cells % (MOST + 1)
    ratio = np.stack([np.where(c3 > 0, np.exp2(log3 / np.maximum(number, 1)), 0), np.where(c2 > 0, np.exp2(log2 / np.maximum(number, 1)), 0), np.ones(len(cells))], 1)
    # Without a context there is no estimate.
    classes = np.arange(buckets)
    may = np.stack([classes // (CLASSES + 1) > 0, classes % (CLASSES + 1) > 0, np.ones(buckets, bool)], 1)
    lam = may / may.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = lam[bucket] * ratio
        part *= (number / part.sum(1))[:, None]
        own = np.stack([np.bincount(bucket, part[:, k], buckets) for k in range(3)], 1).astype(float)
        overall = own.sum(0) + 1.0
        own += PRIOR * overall / overall.sum()
        own *= may
        lam = own / own.sum(1, keepdims=True)
    return lam


def _scored(lam: np.ndarray, total: int, words: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                role, n = (np.asarray(batch.column(c)[k].as_py(), np.int64) for c in ("role", "n"))
                counts = _unpacked(batch.column("counts")[k], "all")
                at = _predicted(n)
                bucket, m3, m2, base = _estimates(counts, at, total, words)
                p = lam[bucket, 0] * m3 + lam[bucket, 1] * m2 + lam[bucket, 2] * base
                first = np.cumsum(n) - n
                sums = [np.add.reduceat(x, first) for x in (np.log10(p), np.log10(base), (counts[0][at] > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k].values, pa.array(role == APART), pa.array(n), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def deleted(fifth: int = 5) -> Column:
    """Documents deleted while weights are learned."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(fifth)) == 0


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all rows, learned from those that are not ``held_out``."""
    role = F.when(held_out, APART).when(deleted(), TUNE).otherwise(FIT)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.alias("role"), "text")
    chunks = S.written(slim.mapInArrow(_tokenised, _CHUNK))
    each = F.explode(F.arrays_zip("role", "n")).alias("d")
    totals = {r.role: r.n for r in chunks.select(each).groupBy("d.role").agg(F.sum("d.n").alias("n")).collect()}
    fit, train = totals.get(FIT, 0), totals.get(FIT, 0) + totals.get(TUNE, 0)
    buckets = min(1 << 24, max(S.LEAST_GROUPS, -(-5 * sum(totals.values()) // (2 * BUCKET_GRAMS))))
    asked = chunks.select("chunk", "role", "n", "words", "ids").mapInArrow(_asked(buckets), "bucket int, kind int, chunk long, grams binary")
    answers = S.written(asked.groupBy("bucket", "kind").applyInArrow(_merged, _ANSWER))
    words = answers.agg(F.sum("fit"), F.sum("all")).first()
    told = answers.where("chunk IS NOT NULL").select("chunk", "bucket", "kind", "counts")
    counted = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_counted(buckets), "chunk long, doc_id array<long>, role array<int>, n array<long>, counts array<binary>")
    counted = S.written(counted)
    tuned = counted.where(F.array_contains("role", TUNE)).select("role", "n", "counts")
    table = tuned.mapInArrow(_ratios(fit, words[0] or 0), "cell long, n long, log3 double, log2 double")
    # At most a row for each bucket and pair of ratios.
    table = table.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "log3", "log2"))).orderBy("cell").toPandas()
    lam = weights(*(table[c].to_numpy() for c in ("cell", "n", "log3", "log2")))
    scored = counted.mapInArrow(_scored(lam, train, words[1] or 0), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
