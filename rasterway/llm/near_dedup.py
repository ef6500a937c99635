"""Near-duplicate classes by order MinHash and banded alignment.

The items of a text are its five-word shingles, each labelled with how often it
came before; a text of fewer words is one shingle.  Two texts are linked if
aligning their shingles in order matches M of them and M / (n1 + n2 - M) is
``similarity`` or more.  Classes are the connected components of links.

1. Order MinHash: each of ``BANDS`` hash functions picks the two smallest shingles
   and keeps them in text order as a key.  Texts with equal words share a node.
2. Keys of one node alone are dropped.  In the others every node is compared with
   its bucket's centre, the node whose MinHash values are most common there.
   Large buckets are dealt into blocks, whose centres meet as a further bucket.
3. Candidates are verified by alignment within the band that the similarity
   leaves, and components are taken.
4. What is not in a bucket's largest component is compared with all of that
   bucket, in blocks, by parity sketches, whose differing bits are never more than the
   differing shingles: first the closest partner in each other component is verified,
   then all further partners in other components.

Defined results: null texts and texts without words form a class each by row, with
its id; rows of equal words share a class; a null id counts as the smallest; rows
that share an id each take their own text's class.  Texts of any length are compared
whole; an empty table gives no row.  Other columns pass through, but for class_id, which
is replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm import words as W
from rasterway.llm.components import components

SHINGLE = 5
BANDS = 16
#: MinHash values that elect a centre, one byte each.
SLOTS = 32
#: Bits of a text's parity sketch: each shingle flips one.
BITS = 2048
#: Nodes of a bucket that one task compares.
BLOCK = 2048
_U = np.uint64
_ODD = W.mix(np.arange(1, SLOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(words: np.ndarray, spans: W.Spans, a: int, b: int) -> np.ndarray:
    """Occurrence-labelled shingle hashes of the words a:b."""
    k = min(SHINGLE, b - a)
    at = np.arange(a, b - k + 1)
    h = spans.hash(at, at + k)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(s)), 0))
        h = h.copy()
        h[order] = W.mix(s + (np.arange(len(s)) - head).astype(_U) * _U(0xD6E8FEB86659FD93))
    else:
        h = W.mix(h)
    return h


def _sketch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all bands, slots, parity sketch) of labelled shingles."""
    parity = np.packbits(np.bincount((x >> _U(32)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1)
    one, slots, second = np.empty(SLOTS, np.int64), np.empty(SLOTS, np.uint8), np.empty(BANDS, np.int64)
    step = max(1, (1 << 20) // len(x))  # functions at once, so that long texts stay small
    for k in range(0, SLOTS, step):
        h = x[None, :] * _ODD[k : k + step, None]
        rows = np.arange(len(h))
        one[k : k + step] = first = h.argmin(1)
        slots[k : k + step] = (h[rows, first] >> _U(20)).astype(np.uint8)
        if k < BANDS and len(x) > 1:
            top = h[: BANDS - k]
            top[rows[: len(top)], first[: len(top)]] = _U(2**64 - 1)
            second[k : k + len(top)] = top.argmin(1)
    first = one[:BANDS]
    a, b = (np.minimum(first, second), np.maximum(first, second)) if len(x) > 1 else (first, first)
    keys = W.mix(W.mix(x[a] + _ODD[:BANDS]) + x[b])
    return keys.view(np.int64), slots, parity


def _sketches(batches):
    for batch in batches:
        data, offsets = S.utf8(batch.column("text"))
        ids = batch.column("doc_id")
        for i, j in S.chunks(offsets, S.WIDE_CHUNK_BYTES):
            chunk = data[offsets[i] : offsets[j]]
            starts, ends, first = W.split(chunk, offsets[i : j + 1] - offsets[i], W.SPACED)
            words = W.hashes(chunk, starts, ends, W.SPACED)
            spans = W.Spans(words)
            node, size, slots, parity, keys = [], [], [], [], []
            whole = np.stack([spans.hash(first[:-1], first[1:], w) for w in (0, 1)], 1)
            for k in range(j - i):
                a, b = first[k], first[k + 1]
                if a == b:
                    node.append(None), size.append(0), slots.append(None), parity.append(None), keys.append(None)
                    continue
                x = shingles(words, spans, a, b)
                key, slot, bits = _sketch(x)
                node.append(whole[k].tobytes()), size.append(len(x)), slots.append(slot.tobytes()), parity.append(bits.tobytes()), keys.append(key.tolist())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), batch.column("_tie").slice(i, j - i), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(slots, pa.binary()), pa.array(parity, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "_tie", "node", "size", "slots", "parity", "keys"],
            )


def aligned(x: np.ndarray, y: np.ndarray, similarity: float) -> float:
    """M / (n1 + n2 - M) of the best in-order matching of labelled shingles, or 0 below ``similarity``."""
    total = len(x) + len(y)
    need = similarity / (1 + similarity) * total
    if min(len(x), len(y)) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=False, return_indices=True)
    band = max(len(x), len(y)) - need + 1e-9
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    tails: list[int] = []
    for v in j[np.argsort(i, kind="stable")].tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    m = len(tails)
    return m / (total - m) if m >= need - 1e-9 else 0.0


def _verify(similarity: float):
    def labels(column):
        data, offsets = S.utf8(column)
        starts, ends, first = W.split(data, offsets, W.SPACED)
        words = W.hashes(data, starts, ends, W.SPACED)
        spans = W.Spans(words)
        return [shingles(words, spans, a, b) for a, b in zip(first[:-1], first[1:])]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                pairs = zip(labels(part.column("text_a")), labels(part.column("text_b")))
                ok = pa.array([aligned(x, y, similarity) >= similarity - 1e-9 for x, y in pairs])
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    return run


_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _slots(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _pairs(a: pa.Array, b: pa.Array) -> pa.Table:
    """Pairs with the smaller node first."""
    swap = pc.greater(a, b)
    return pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b)}, schema=_PAIR)


def _centre(slots: np.ndarray) -> int:
    """The row whose slots are most often the most common value of their column."""
    modes = np.array([np.bincount(c).argmax() for c in slots.T])
    return int((slots == modes).sum(1).argmax())


def _stars(table: pa.Table) -> pa.Table:
    """One block of a bucket: its centre with every other node; the centre goes on."""
    table = table.sort_by("node").combine_chunks()
    nodes = S.plain(table.column("node"))
    c = _centre(_slots(table.column("slots")))
    others = nodes.take(pa.array(np.flatnonzero(np.arange(len(nodes)) != c)))
    return _pairs(pa.array([nodes[c].as_py()] * len(others), pa.binary()), others)


def _most_apart(total: np.ndarray, similarity: float) -> np.ndarray:
    """Bits by which the parity sketches of a linked pair of ``total`` shingles can differ.

    Never more than the shingles that only one of both has.  This bound holds for every
    pair; beyond some 9000 shingles it leaves all pairs to the alignment.
    """
    return np.floor(total * (1 - similarity) / (1 + similarity) + 1e-9)


def _cross(similarity: float, best: bool):
    """Outsiders (left) of one bucket block with all nodes (right) in other components."""

    def words(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIR.empty_table()
        xs, ys = words(left.column("parity")), words(right.column("parity"))
        size_x, size_y = left.column("size").to_numpy(), right.column("size").to_numpy()
        codes = {c: i for i, c in enumerate(dict.fromkeys(left.column("class").to_pylist() + right.column("class").to_pylist()))}
        cx, cy = (np.array([codes[c] for c in t.column("class").to_pylist()]) for t in (left, right))
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for i in range(len(xs)):
            at = np.flatnonzero((cy != cx[i]) & (np.minimum(size_y, size_x[i]) >= similarity * np.maximum(size_y, size_x[i]) - 1e-9))
            apart = np.bitwise_count(ys[at] ^ xs[i]).sum(1, dtype=np.int64)
            near = apart <= _most_apart(size_y[at] + size_x[i], similarity)
            at, apart = at[near], apart[near]
            if best and len(at):
                order = np.lexsort([apart, cy[at]])
                at = at[order][np.append(True, np.diff(cy[at][order]) != 0)]
            a.append(np.full(len(at), i))
            b.append(at)
        x_node, y_node = S.plain(left.column("node")), S.plain(right.column("node"))
        return _pairs(x_node.take(pa.array(np.concatenate(a))), y_node.take(pa.array(np.concatenate(b))))

    return run


#: Stands for a null id: smaller than any other.
NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_tie", F.xxhash64("text"))


def _classified(docs: DataFrame, similarity: float) -> DataFrame:
    """(_id, _tie, class) of every distinct row; class is null where there are no words."""
    slim = _keyed(docs).select(F.col("_id").alias("doc_id"), "_tie", "text")
    schema = "doc_id long, _tie long, node binary, size int, slots binary, parity binary, keys array<long>"
    sketched = S.written(slim.mapInArrow(S.lean(_sketches), schema))
    some = sketched.where("node IS NOT NULL")
    nodes = some.groupBy("node").agg(F.min(F.struct("doc_id", "_tie")).alias("row"), F.first("size").alias("size"), F.first("slots").alias("slots"), F.first("parity").alias("parity"), F.first("keys").alias("keys"))
    nodes = S.written(nodes)
    exploded = nodes.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    shared = exploded.groupBy("key").count().where("count > 1")
    members = S.written(exploded.join(shared, "key").join(nodes.select("node", "size", "slots", "parity"), "node"))
    live = members.select("node").distinct().join(nodes.select("node", "row"), "node").select("node", "row.doc_id", "row._tie")
    # Rows that repeat id and text give one text here.
    texts = slim.join(live, ["doc_id", "_tie"])
    texts = S.written(texts.select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return S.written(pairs.join(a, "a").join(b, "b").mapInArrow(S.lean(_verify(similarity)), "a binary, b binary"))

    def stars(bucket: DataFrame) -> DataFrame:
        return bucket.groupBy("key", "block").applyInArrow(S.lean_group(_stars), "a binary, b binary").distinct()

    blocks = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / BLOCK)).alias("block")
    level = members.select("key", "node", "slots", "count", blocks)
    tried = S.written(stars(level))
    while level.where(f"count > {BLOCK}").limit(1).count():
        # The centres of a large bucket's blocks are the members of the next bucket.
        large = level.where(f"count > {BLOCK}")
        centres = large.groupBy("key", "block").applyInArrow(_centres, "key long, node binary, slots binary")
        counts = centres.groupBy("key").count()
        level = S.written(centres.join(counts, "key").select("key", "node", "slots", "count", blocks))
        tried = S.written(tried.unionByName(stars(level)).distinct())
    links = verified(tried)
    for best in (True, False):
        found = components(links)
        now = members.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
        sizes = now.groupBy("key", "class").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("m"), F.count("*").alias("k")).where("k > 1")
        now = now.join(largest.select("key", F.col("m.class").alias("main"), F.col("m.n").alias("inside")), "key")
        now = S.written(now.select("key", "node", "size", "parity", "class", "count", (F.col("class") != F.col("main")).alias("outside"), (F.col("count") - F.col("inside")).alias("out")))
        i, j = F.ceil(F.col("out") / BLOCK), F.ceil(F.col("count") / BLOCK)
        own = lambda n: F.pmod(F.xxhash64("node"), n)
        columns = ["key", "i", "j", "node", "size", "parity", "class"]
        left = now.where("outside").withColumn("i", own(i)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), j - 1))).select(columns)
        right = now.withColumn("j", own(j)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), i - 1))).select(columns)
        pairs = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(S.lean_groups(_cross(similarity, best)), "a binary, b binary").distinct()
        pairs = S.written(pairs.join(tried, ["a", "b"], "left_anti"))
        links = S.written(links.unionByName(verified(pairs)))
        tried = tried.unionByName(pairs)
    found = components(links)
    rows = sketched.select(F.col("doc_id").alias("_id"), "_tie", "node").distinct().join(found, "node", "left")
    return S.written(rows.select("_id", "_tie", F.coalesce("class", "node").alias("class")))


def classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with class_id, the smallest doc_id of each row's class."""
    docs = docs.drop("class_id", "_id", "_tie")
    rows = _classified(docs, similarity)
    named = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("_id").alias("least"))
    known = rows.join(named, "class", "left").select("_id", "_tie", F.coalesce("least", "_id").alias("class_id"))
    known = known.withColumn("class_id", F.when(F.col("class_id") != NO_ID, F.col("class_id")))
    return _keyed(docs).join(known, ["_id", "_tie"]).drop("_id", "_tie")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one row of each class: the smallest id, then text hash.

    Rows without words are kept, each distinct one once.
    """
    rows = _classified(docs.drop("_id", "_tie"), similarity)
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("_id", "_tie")).alias("r")).select("r._id", "r._tie")
    kept = first.unionByName(rows.where("class IS NULL").select("_id", "_tie"))
    once = Window.partitionBy("_id", "_tie").orderBy("_tie")
    return _keyed(docs).join(kept, ["_id", "_tie"]).withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*docs.columns)


def _centres(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    return table.slice(_centre(_slots(table.column("slots"))), 1).select(["key", "node", "slots"])
