"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

1. Examples are at most ``EXAMPLES`` training rows of each class, the smallest by a
   hash of their ids, each standing for its class's share of all training rows.
2. Terms are folded words, whole, by a 64-bit hash.  The vector space are all terms that
   stand in ``LEAST`` examples or more and go with a class: their chi-squared statistic, as
   if the examples had the classes' shares of all training rows, is ``ASSOCIATED`` or more.
   So a term that only one class holds needs the same number of examples at any size and
   balance of the sample.  Words of the subject outweigh all others in cosines over every
   word, and neighbours then say little about toxicity (README gives figures).
3. One pass over all documents counts in how many whole texts each of these terms stands.
4. The examples' vectors form an inverted index in blocks, with the largest weight of
   each term in each block.  Examples whose commonest word is the same stand together, so
   that blocks hold texts of one language.  A document takes the blocks in the order of
   their bounds and stops when no bound exceeds its ``NEIGHBOURS``-th best cosine, so the
   neighbours are those of a full scan, with all that equal the last.  Equal examples are
   one entry that votes for all of them.
5. Votes weigh by closeness; isotonic regression over the examples, each without
   its own vote, turns them into probabilities.

Index and term list are bounded by the examples and broadcast.  Defined results:
null and empty texts and texts without any of the terms get the calibrated share of
such examples; without labels every score is 0; rows with a null id or label teach
nothing; repeated rows are scored each, and repeated labels count each; texts of any
length are read whole; an empty table gives no row; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm import calibration
from rasterway.llm import shared as S
from rasterway.llm import words as W

EXAMPLES, NEIGHBOURS, BLOCK = 10_000, 25, 1024
#: Postings from which on a block keeps a column whole.
DENSE = 128
#: Documents, and terms of them, that are searched at once.
BATCH, BATCH_CELLS = 512, 1 << 16
#: What a term needs: chi-squared, and examples that hold it.
ASSOCIATED, LEAST = 25.0, 4
#: Distance added to that of a neighbour before its vote is divided by it.
NEAR = 0.05
#: Documents' neighbours that a worker keeps for copies.
CACHE = 20_000
_U = np.uint64


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(term hashes, document of each) with repetitions."""
    starts, ends, first = W.split(data, offsets, W.FOLDED)
    return W.hashes(data, starts, ends, W.FOLDED).view(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def _holders(batches):
    """How many examples of each class hold each term."""
    for batch in batches:
        data, offsets = S.utf8(batch.column("text"))
        label = batch.column("label").to_numpy()
        for i, j in S.chunks(offsets):
            term, doc = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            known, at = np.unique(term, return_inverse=True)
            cell = np.unique(doc * max(len(known), 1) + at)
            doc, at = np.divmod(cell, max(len(known), 1))
            n = np.bincount(at * 2 + label[i:j][doc], minlength=2 * len(known)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n[:, 0]), pa.array(n[:, 1])], ["term", "n0", "n1"])


def _associated(texts: DataFrame, chosen: dict[int, int], totals: dict[int, int]) -> np.ndarray:
    """The terms of the examples ``texts`` (label, text) that go with a class, in ascending order."""
    if len(chosen) < 2:
        return np.zeros(0, np.int64)
    share = totals[1] / (totals[0] + totals[1])
    p0, p1 = F.col("n0") / chosen[0], F.col("n1") / chosen[1]
    p = p0 * (1 - share) + p1 * share
    counts = texts.select("label", "text").mapInArrow(_holders, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # A term in all examples goes with neither class.
    kept = counts.where((F.col("n0") + F.col("n1") >= LEAST) & ((p0 - p1) ** 2 * chosen[1] * (1 - share) >= ASSOCIATED * p * (1 - p)) & (p < 1))
    return np.sort(kept.select("term").toArrow()["term"].to_numpy())


def _cells_of(known: np.ndarray, column):
    """(first row, end, columns, counts, where each row's begin) of chunks of a text column.

    A row's columns of the ``known`` terms ascend.
    """
    data, offsets = S.utf8(column)
    for i, j in S.chunks(offsets):
        term, doc = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        one, back = np.unique(term, return_inverse=True)
        at = np.minimum(np.searchsorted(known, one), max(len(known) - 1, 0))
        at = np.where(known[at] == one, at, -1) if len(known) else np.full(len(one), -1)
        c = at[back]
        hit = c >= 0
        cell, n = np.unique(doc[hit] * max(len(known), 1) + c[hit], return_counts=True)
        doc, c = np.divmod(cell, max(len(known), 1))
        yield i, j, c, n, np.searchsorted(doc, np.arange(j - i + 1))


def _vectors(terms):
    """Documents to the columns and counts of the terms they hold."""

    def run(batches):
        for batch in batches:
            keep = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            for i, j, c, n, cuts in _cells_of(terms.value, batch.column("text")):
                cells = [np.stack([c[a:b], n[a:b]]).astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keep), pa.array(cells, pa.binary())], [*(batch.schema.names[k] for k in keep), "v"])

    return run


def _cells(v: bytes) -> np.ndarray:
    return np.frombuffer(v, np.int32).reshape(2, -1)


def _weighed(c: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length weights of one vector."""
    w = (1 + np.log(n)) * idf[c]
    return w / np.sqrt(w @ w) if len(w) else w


class Index:
    """Unit vectors in blocks, with the largest weight of each column in each block.

    Entries are sorted by their commonest column and then the heaviest, so that blocks are
    alike inside.  A block keeps columns of ``DENSE`` postings or more as rows of a matrix
    and the postings of the others by column in flat arrays.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: int):
        common = [int(c[n.argmax()]) if len(c) else -1 for c, n, _ in vectors]
        heavy = [int(c[w.argmax()]) if len(c) else -1 for c, _, w in vectors]
        self.order = np.lexsort([heavy, common])
        blocks = -(-len(vectors) // BLOCK)
        size = np.array([len(c) for c, _, _ in vectors], np.int64)[self.order]
        #: Where each entry's columns and weights begin, in this order.
        self.begin = np.append(0, np.cumsum(size))
        self.column = np.concatenate([np.zeros(0, np.int64), *(vectors[k][0] for k in self.order)]).astype(np.int32)
        self.weight = np.concatenate([np.zeros(0), *(vectors[k][2] for k in self.order)])
        self.most = columns
        entry = np.repeat(np.arange(len(vectors)), size)
        self.bound = np.zeros((columns, blocks), np.float32)
        np.maximum.at(self.bound, (self.column, entry // BLOCK), np.nextafter(self.weight.astype(np.float32), np.float32(2)))
        #: By block: each column's row of the matrix or -1, the matrix; where each other column's postings begin, their entries and weights.
        self.posts: list[tuple[np.ndarray, ...]] = []
        cuts = np.searchsorted(entry, np.arange(blocks + 1) * BLOCK)
        for a, b in zip(cuts, cuts[1:]):
            column, slot, weight = self.column[a:b], entry[a:b] % BLOCK, self.weight[a:b].astype(np.float32)
            dense = np.flatnonzero(np.bincount(column, minlength=columns) >= DENSE)
            place = np.full(columns, -1, np.int32)
            place[dense] = np.arange(len(dense))
            on = place[column] >= 0
            matrix = np.zeros((len(dense), BLOCK), np.float32)
            matrix[place[column[on]], slot[on]] = weight[on]
            by = np.flatnonzero(~on)[np.argsort(column[~on], kind="stable")]
            begin = np.searchsorted(column[by], np.arange(columns + 1)).astype(np.int32)
            self.posts.append((place, matrix, begin, slot[by].astype(np.int16), weight[by]))

    def nearest(self, c: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the k largest cosines and all that equal the last."""
        return self.nearest_of([(c, w)], k)[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` gives, of each (columns, weights)."""
        out = [(np.zeros(0, int), np.zeros(0))] * len(vectors)
        some = [i for i, (c, _) in enumerate(vectors) if len(c)]
        stop = np.cumsum([len(vectors[i][0]) for i in some])
        i = 0
        while i < len(some):
            before = stop[i - 1] if i else 0
            j = min(i + BATCH, max(i + 1, int(np.searchsorted(stop, before + BATCH_CELLS, side="right"))))
            for to, found in zip(some[i:j], self._batch([vectors[x] for x in some[i:j]], k)):
                out[to] = found
            i = j
        return out

    def _scores(self, block: int, row: np.ndarray, rows: int, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Single-precision cosines of ``rows`` vectors, given by cells, with a block's entries."""
        place, matrix, begin, slots, weights = self.posts[block]
        to = place[c]
        on = to >= 0
        q = np.zeros((rows, len(matrix)), np.float32)
        q[row[on], to[on]] = w[on]
        scores = q @ matrix
        row, c, w = row[~on], c[~on], w[~on]
        first = begin[c]
        n = begin[c + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        if len(at):
            scores += np.bincount(np.repeat(row, n) * BLOCK + slots[at], weights[at] * np.repeat(w, n), rows * BLOCK).reshape(rows, BLOCK)
        return scores

    def _batch(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int):
        """What ``nearest`` gives of vectors that are not empty.

        Each takes the blocks in the order of its own bounds; those that come to the same
        block together are multiplied at once, in single precision.  Entries within its
        error of the k-th best get their cosines in double precision.
        """
        size = np.array([len(c) for c, _ in vectors])
        start = np.cumsum(size) - size
        column = np.concatenate([c for c, _ in vectors]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors])
        bound = np.add.reduceat(weight[:, None] * self.bound[column], start, axis=0)
        order = np.argsort(-bound, axis=1, kind="stable")
        # No term is negative and no cosine exceeds 1, so a cell adds a rounding at most; twice, for the k-th and the entry.
        slack = (size + 6) * 2.0**-23 + 1e-9
        best = np.zeros((len(vectors), k), np.float32)
        found: list[tuple[np.ndarray, ...]] = []
        live = np.arange(len(vectors))
        for rank in range(bound.shape[1]):
            block = order[live, rank]
            reach = bound[live, block]
            on = (reach > 0) & (reach * (1 + 1e-5) >= best[live].min(1) - slack[live])
            live, block = live[on], block[on]
            for b in np.unique(block).tolist():
                own = live[block == b]
                n = size[own]
                at = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n)
                scores = self._scores(b, np.repeat(np.arange(len(own)), n), len(own), column[at], weight[at])
                better = np.flatnonzero(scores.max(1) > best[own].min(1))
                if len(better):
                    both = np.concatenate([best[own[better]], scores[better]], axis=1)
                    best[own[better]] = np.partition(both, -k, axis=1)[:, -k:]
                x, slot = np.nonzero((scores > 0) & (scores >= (best[own].min(1) - slack[own])[:, None]))
                found.append((own[x], b * BLOCK + slot, scores[x, slot]))
        if not found:
            return [(np.zeros(0, int), np.zeros(0))] * len(vectors)
        of, entry, score = (np.concatenate(x) for x in zip(*found))
        near = np.flatnonzero(score >= (best.min(1) - slack)[of])
        near = near[np.argsort(of[near], kind="stable")]
        cuts = np.searchsorted(of[near], np.arange(len(vectors) + 1))
        own, out = np.zeros(self.most), []
        for (c, w), a, b in zip(vectors, cuts, cuts[1:]):
            at = entry[near[a:b]]
            first, n = self.begin[at], self.begin[at + 1] - self.begin[at]
            cell = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            own[c] = w
            cosines = np.bincount(np.repeat(np.arange(len(at)), n), self.weight[cell] * own[self.column[cell]], len(at))
            own[c] = 0
            entries = self.order[at]
            if len(at) >= k:
                keep = cosines >= np.partition(cosines, -k)[-k] - 1e-9
                entries, cosines = entries[keep], cosines[keep]
            by = np.lexsort([entries, -cosines])
            out.append((entries[by], cosines[by]))
        return out


class Voters:
    """The index with each entry's votes: (negative, positive), and one entry for empty vectors."""

    def __init__(self, idf: np.ndarray, entries: list[tuple[bytes, float, float, list]]):
        self.idf = idf
        self.votes = np.array([[n, p] for _, n, p, _ in entries]).reshape(-1, 2)
        self.ids = [i for *_, i in entries]
        cells = [_cells(v) for v, *_ in entries]
        self.index = Index([(c, n, _weighed(c, n, idf)) for c, n in cells], len(idf))
        self.empty = next((k for k, (v, *_) in enumerate(entries) if not v), None)
        self.cache: dict[bytes, tuple] = {}

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(entries, cosines) of each (columns, counts)."""
        keys = [hashlib.blake2b(np.concatenate([c, n]).astype(np.int32).tobytes(), digest_size=16).digest() for c, n in vectors]
        known = {key: self.cache[key] for key in keys if key in self.cache}
        new = {key: v for key, v in zip(keys, vectors) if key not in known}
        nearest = self.index.nearest_of([(c, _weighed(c, n, self.idf)) for c, n in new.values()], NEIGHBOURS)
        none = (np.array([] if self.empty is None else [self.empty], int), np.ones(int(self.empty is not None)))
        found = {key: x if len(c) else none for (key, (c, _)), x in zip(new.items(), nearest)}
        if len(self.cache) + len(found) > CACHE:
            self.cache.clear()
        self.cache |= dict(list(found.items())[:CACHE])
        known |= found
        return [known[key] for key in keys]

    def share(self, at: np.ndarray, cosine: np.ndarray, own: np.ndarray | None = None) -> float:
        """The positive share of distance-weighted votes; ``own`` is taken from an equal entry's."""
        votes = self.votes[at]
        if own is not None and len(at):
            equal = cosine >= 1 - 1e-9
            votes = np.maximum(votes - np.where((equal & (np.cumsum(equal) == 1))[:, None], own, 0), 0)
        weight = votes / (NEAR + 1 - np.minimum(cosine, 1))[:, None]
        total = weight.sum()
        return float(weight[:, 1].sum() / total) if total > 0 else float(self.votes[:, 1].sum() / max(self.votes.sum(), 1e-9))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): doc_id, held_out, score and evidence.

    ``labels`` (doc_id, label 0 or 1) teach where the document is not held out.
    evidence lists up to five example ids nearest to the document.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    training = known.join(docs.where("NOT held_out").select("doc_id").distinct(), "doc_id")
    totals = {r.label: r.n for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = [training.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for k in (0, 1)]
    # At most EXAMPLES ids of each class: broadcast, so that texts need no shuffle.
    examples = S.written(picked[0].unionByName(picked[1]))
    chosen = {r.label: r.n for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not chosen:
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"))
    texts = docs.join(F.broadcast(examples), "doc_id")
    terms = _associated(texts, chosen, totals)
    known_terms = spark.sparkContext.broadcast(terms)

    def columns(batches):
        terms = known_terms.value
        total, rows = np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for *_, c, _, _ in _cells_of(known_terms.value, batch.column("text")):
                total[: len(terms)] += np.bincount(c, minlength=len(terms))
        total[-1] = rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["c", "n"])

    df = np.zeros(len(terms) + 1)
    found = docs.select("text").mapInArrow(columns, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    df[found["c"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    weight = {k: totals[k] / chosen[k] for k in chosen}
    labelled = S.written(texts.select("doc_id", "label", "text").mapInArrow(_vectors(known_terms), "doc_id long, label int, v binary"))
    entries: dict[bytes, list] = {}
    for r in labelled.orderBy("doc_id").toLocalIterator():  # 2 * EXAMPLES rows at most
        e = entries.setdefault(bytes(r.v), [0.0, 0.0, []])
        e[r.label] += weight[r.label]
        if len(e[2]) < 5:
            e[2].append(r.doc_id)
    state = spark.sparkContext.broadcast((idf, [(v, *e) for v, e in entries.items()]))
    name = uuid.uuid4().hex

    def raw(batches):
        voters = S.kept(("voters", name), lambda: Voters(*state.value))
        for batch in batches:
            label = batch.column("label").to_pylist()
            near = voters.neighbours([_cells(v) for v in batch.column("v").to_pylist()])
            out = [voters.share(*x, np.array([weight[0], 0]) if k == 0 else np.array([0, weight[1]])) for x, k in zip(near, label)]
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(label, pa.int32()), pa.array([weight[k] for k in label])], ["raw", "label", "weight"])

    steps = calibration.fit(labelled.select("label", "v").mapInArrow(raw, "raw double, label int, weight double"), 0.0, 1.0)

    def final(batches):
        voters = S.kept(("voters", name), lambda: Voters(*state.value))
        for batch in batches:
            for i, j, c, n, cuts in _cells_of(known_terms.value, batch.column("text")):
                near = voters.neighbours([(c[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])])
                share = np.array([voters.share(*x) for x in near])
                evidence = [[e for k in at[:5].tolist() for e in voters.ids[k]][:5] for at, _ in near]
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(calibration.apply(share, 0.0, 1.0, steps)), pa.array(evidence, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "evidence"])

    return docs.mapInArrow(final, "doc_id long, held_out boolean, score double, evidence array<long>")
