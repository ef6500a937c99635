"""Token-id files compressed by Re-Pair grammars, one grammar a shard.

Documents are dealt out by ranges of their ids and encoded in order.  In each shard
frequent pairs of symbols become nonterminals, round after round and never across the
end of a document, until no pair can be replaced ``LEAST`` times more.  A shard row
holds its rules, in the order in which they were made, the lengths that they expand to,
the remaining symbols and where each document's begin: a document, or a range of its ids,
is decoded by the rules that it uses alone.  Shards are rows of a Parquet table: tasks that are run again leave one copy, and any store that Spark writes to will do.

Defined results: null and empty texts are the end id alone; repeated rows are written
each; rows that share an id come in the order of a text hash (equal texts are equal
rows); null ids come first; an empty table gives no shard and no row; texts of any length
are one document of one shard; columns other than doc_id and text are left alone,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm.tokens import encoder

#: Tokens of a shard (the last document may exceed it).
SHARD_TOKENS = 1 << 20
#: How often a pair must be replaced to be worth its rule.
LEAST = 24
_SLOT_BITS = 18
_U = np.uint64


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair codes that occur LEAST times or more, and how often."""
    s = np.sort(code)
    head = np.flatnonzero(s[1:] != s[:-1]) + 1
    count = np.diff(head, prepend=0, append=len(s))
    at = np.flatnonzero(count >= LEAST)
    return s[np.append(0, head)[at]], count[at]


def _winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which pairs at the places ``at`` are replaced: of overlapping ones those of higher rank.

    Runs of one pair (such as a a a a) take every other place from the left.
    """
    near = at[1:] == at[:-1] + 1
    win = np.ones(len(at), bool)
    win[1:] &= ~near | (rank[1:] >= rank[:-1])
    win[:-1] &= ~near | (rank[:-1] >= rank[1:])
    same = np.flatnonzero(near & (rank[1:] == rank[:-1])) + 1
    if len(same):
        again = np.zeros(len(at), bool)
        again[same] = True
        k = np.arange(len(at))
        head = np.maximum.accumulate(np.where(again, 0, k))
        win &= (k - head) % 2 == 0
    return win


def _slot(code: np.ndarray, turn: int) -> np.ndarray:
    """Multiplicative hashes of codes, others each turn."""
    bits = 8 * code.itemsize
    factor = (0x9E3779B97F4A7C15 >> (64 - bits)) + 2 * turn | 1
    return (code * code.dtype.type(factor) >> code.dtype.type(bits - _SLOT_BITS)).astype(np.intp)


def _found(code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the ``chosen`` codes in ``code``, which of them each is), in order of place."""
    tables, left = [], np.arange(len(chosen), dtype=np.int32)
    while len(left):  # codes that share a slot are looked up in turn
        _, one = np.unique(_slot(chosen[left], len(tables)), return_index=True)
        slots = _slot(chosen[left[one]], len(tables))
        key, name = np.zeros(1 << _SLOT_BITS, code.dtype), np.full(1 << _SLOT_BITS, -1, np.int32)
        key[slots], name[slots] = chosen[left[one]], left[one]
        tables.append((key, name))
        left = np.delete(left, one)
    places, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for a in range(0, len(code), 1 << 15):
        some = code[a : a + (1 << 15)]
        pair = np.full(len(some), -1, np.int32)
        for turn, (key, name) in enumerate(tables):
            where = _slot(some, turn)
            at = np.flatnonzero(key.take(where) == some)
            pair[at] = np.maximum(pair[at], name.take(where[at]))
        at = np.flatnonzero(pair >= 0)
        places.append(at + a), names.append(pair[at])
    return np.concatenate(places), np.concatenate(names)


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, where documents end, rules, rules after each round) of ``ids``; ``last`` marks final tokens.

    Rounds go on until no pair can be replaced LEAST times.  Symbols of a vocabulary
    that fits 16 bits stay within 16 bits: then rules end with these numbers, too.
    A pair's places all arise in one round, so later rounds look only at places next
    to new symbols and at frequent pairs that lost to an overlapping one.
    """
    symbols, last = ids.astype(np.uint32), last.copy()
    shift = _U(16 if first_rule < 1 << 16 else 32)
    room = (1 << int(shift) if first_rule < 1 << 16 else 1 << 31) - first_rule
    rules, rounds, made = [np.zeros((0, 2), np.uint32)], [], 0
    active = np.flatnonzero(~last)
    while room > made and len(active):
        left, right = symbols[active], symbols[active + 1]
        code = left << np.uint32(16) | right if shift == 16 else left.astype(_U) << shift | right
        chosen, count = _counted(code)
        order = np.argsort(-count, kind="stable")[: room - made]
        chosen = chosen[order]
        at, pair = _found(code, chosen)
        at = active[at]
        win = _winners(at, -pair)
        good = np.bincount(pair[win], minlength=len(chosen)) >= LEAST
        if not good.any():
            break
        win &= good[pair]
        number = np.cumsum(good) - 1
        both = chosen[good].astype(_U)
        rules.append(np.stack([both >> shift, both & ((_U(1) << shift) - _U(1))], 1).astype(np.uint32))
        new = at[win]
        symbols[new] = (first_rule + made + number[pair[win]]).astype(np.uint32)
        last[new] |= last[new + 1]
        keep = np.ones(len(symbols), bool)
        keep[new + 1] = False
        to = np.cumsum(keep, dtype=np.int32) - 1
        lost = at[~win]
        symbols, last = symbols[keep], last[keep]
        look = np.zeros(len(symbols) + 1, bool)
        look[to[lost[keep[lost]]]] = look[to[new]] = look[to[new] - 1] = True  # the spare place takes -1
        look = look[:-1]
        look[last] = False
        active = np.flatnonzero(look)
        made += len(rules[-1])
        rounds.append(made)
    return symbols, np.flatnonzero(last) + 1, np.concatenate(rules), np.array(rounds, np.uint32)


def expansions(rules: np.ndarray, rounds: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all rules' expansions one after another, where each begins, their lengths)."""
    length, begin, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    for a, b in zip([0, *rounds.tolist()], rounds.tolist()):
        symbols = rules[a:b].ravel().astype(np.int64)
        ids, size = _expanded(symbols, first_rule, flat, begin, length)
        begin = np.concatenate([begin, len(flat) + np.cumsum(size)[1::2] - size.reshape(-1, 2).sum(1)])
        length = np.concatenate([length, size.reshape(-1, 2).sum(1)])
        flat = np.concatenate([flat, ids])
    return flat, begin, length


def _expanded(symbols: np.ndarray, first_rule: int, flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many stand for each symbol)."""
    rule = np.flatnonzero(symbols >= first_rule)
    k = symbols[rule] - first_rule
    size = np.ones(len(symbols), np.int64)
    size[rule] = length[k]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    plain = symbols < first_rule
    out[at[plain]] = symbols[plain]
    inner = np.repeat(at[rule] - (np.cumsum(size[rule]) - size[rule]), size[rule]) + np.arange(size[rule].sum())
    out[inner] = flat[np.repeat(begin[k] - at[rule], size[rule]) + inner]
    return out, size


def lengths(rules: np.ndarray, rounds: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.zeros(len(rules), np.int64)
    for a, b in zip([0, *rounds.tolist()], rounds.tolist()):
        own = rules[a:b].astype(np.int64)
        out[a:b] = np.where(own >= first_rule, out[np.maximum(own - first_rule, 0)], 1).sum(1)
    return out


class Shard:
    """Reads documents of one shard row; a document, or a part of it, by the rules that it uses alone."""

    def __init__(self, row: dict):
        wide = np.uint16 if row["width"] == 2 else np.uint32
        self.first_rule = row["first_rule"]
        self.rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        self.symbols = np.frombuffer(row["symbols"], wide)
        self.ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.rounds = np.frombuffer(row["rounds"], np.uint32)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def decode(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the symbols a:b, and how many stand for each, by the expansions of all rules (for whole shards)."""
        if self._whole is None:
            self._whole = expansions(self.rules, self.rounds, self.first_rule)[:2]
        return _expanded(self.symbols[a:b].astype(np.int64), self.first_rule, *self._whole, self.lengths)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids [start, stop) of the shard's k-th document.

        Stored lengths tell which symbols, and in each round of replacing rules by their
        pairs which of these, hold wanted ids; no other rule is looked at.
        """
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        symbols, skipped = self.symbols[a:b].astype(np.int64), 0
        while True:
            rule = symbols >= self.first_rule
            size = np.ones(len(symbols), np.int64)
            size[rule] = self.lengths[symbols[rule] - self.first_rule]
            last = skipped + np.cumsum(size)
            stop = int(last[-1]) if stop is None and len(last) else stop
            keep = (last > start) & (last - size < (stop or 0))
            if not keep.any():
                return np.zeros(0, np.uint32)
            skipped = int((last - size)[keep][0])
            symbols, rule = symbols[keep], rule[keep]
            if not rule.any():
                return symbols.astype(np.uint32)
            pairs = np.repeat(symbols, 1 + rule)
            first = (np.cumsum(1 + rule) - 1 - rule)[rule]
            pairs[first], pairs[first + 1] = self.rules[symbols[rule] - self.first_rule].astype(np.int64).T
            symbols = pairs


_SHARD = "first_id long, part int, shard int, n_tokens long, width int, first_rule int, doc_ids binary, no_ids binary, rules binary, rounds binary, lengths binary, symbols binary, ends binary"


def write(docs: DataFrame, path: str, end_id: int = 0, tokenizer: str | None = None) -> None:
    """Writes the documents' ids, in ascending doc_id order, as shards below ``path``."""

    def run(batches):
        from pyspark import TaskContext

        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        first_rule = own.tokenizer.get_vocab_size()
        #: Ids, numbers of tokens, doc_ids and whether they are null, of the next shard's documents.
        held: list[tuple[np.ndarray, ...]] = []
        number = size = 0

        def flush():
            ids, count, doc, none = (np.concatenate(x) for x in zip(*held))
            last = np.zeros(len(ids), bool)
            last[np.cumsum(count) - 1] = True
            symbols, ends, rules, rounds = compress(ids, last, first_rule)
            wide = np.uint16 if first_rule + len(rules) <= 1 << 16 else np.uint32
            row = [None if none[0] else int(doc[0]), part, number, len(ids), np.dtype(wide).itemsize, first_rule, doc.tobytes(), none.tobytes(), rules.tobytes(), rounds.tobytes(), lengths(rules, rounds, first_rule).astype(np.uint32).tobytes(), symbols.astype(wide).tobytes(), ends.astype(np.uint32).tobytes()]
            kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            fields = [x.split() for x in _SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(row, fields)], [name for name, _ in fields])

        for batch in batches:
            keys, none = S.longs(batch.column("doc_id")), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for row, ids, at in own.encode_ended(batch.column("text"), end_id):
                i, n = 0, len(at) - 1
                while i < n:
                    j = min(n, int(np.searchsorted(at, at[i] + SHARD_TOKENS - size)))
                    held.append((ids[at[i] : at[j]], np.diff(at[i : j + 1]), keys[row + i : row + j], none[row + i : row + j]))
                    size += int(at[j] - at[i])
                    i = j
                    if size >= SHARD_TOKENS:
                        yield flush()
                        held, size, number = [], 0, number + 1
        if held:
            yield flush()

    n = S.groups_for(docs)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    ordered.mapInArrow(run, _SHARD).write.parquet(path)


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    shards = spark.read.schema(_SHARD).parquet(path)
    # Where each shard begins: totals of blocks of parts first, then within each block.
    counts = shards.select("part", "shard", "n_tokens").withColumn("block", F.expr("part div 1024"))
    blocks = counts.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("block", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, "block").select("part", "shard", (F.col("inside") + F.col("ahead")).alias("begin"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                ids, size = shard.decode(0, len(shard.symbols))
                doc, none = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_ids"], bool)
                ends = np.cumsum(size)[shard.ends - 1]
                starts = np.append(0, ends[:-1])
                parts = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [pa.array(doc, pa.int64(), mask=none), pa.array(starts + row["begin"]), pa.array(ends - starts), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return shards.join(begins, ["part", "shard"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
