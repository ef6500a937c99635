"""Substring deduplication by recompression.

Removed is each word covered by a window of ``window`` words whose sequence also
starts earlier, in a document with a smaller id or before it in the same one.

1. Every document is parsed by recompression (``recompression``).  Its short
   symbols are keyed by the words they depend on, its high-level symbols, two by
   two, by the words they span.  Keys are dealt out over the cluster, one record
   a key and batch, so a passage that all documents share stays small.
2. A pair of high-level symbols that starts earlier elsewhere proves all windows
   inside it repeated.  A window that holds a short symbol seen only once is
   unique.  All other windows go on by the 128-bit hash of their words, and
   all but the first start of each are repeated.
3. The repeated windows meet their documents again, and covered words go.

Defined results: null and empty texts have no words and keep none; rows that are
equal in id and text count as one document and each gets its result; rows that
share an id with other texts come in the order of a 64-bit text hash, by which they are
known (of a million texts of one id, two have one hash with a chance below 1 in 30
million); a null id comes before all others.  Texts of any length are parsed whole, in one task each; an empty
table gives no row.  Columns beside id and text pass through untouched; those named
n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm import recompression as R
from rasterway.llm import shared as S
from rasterway.llm import words as W

#: Rounds for short symbols, and further ones for high-level symbols.
LOW_ROUNDS, HIGH_ROUNDS = 4, 8
#: Records gathered in a task before they are dealt out.
BATCH_RECORDS = 1 << 20

_KEY = np.dtype([("key", "u8"), ("doc", "i8"), ("tie", "u8"), ("at", "u4"), ("many", "u1")])
_SPAN = np.dtype([("key", "u8"), ("key2", "u8"), ("doc", "i8"), ("tie", "u8"), ("at", "u4"), ("len", "u4")])
_POINT = np.dtype([("doc", "i8"), ("tie", "u8"), ("at", "u4")])
_RANGE = np.dtype([("doc", "i8"), ("tie", "u8"), ("at", "u4"), ("len", "u4")])
#: to: group that the records go to next; kind: symbol, pair, window, repeated symbol, removed range.
_PACKED = "to int, kind string, records binary"
_SCHEMA = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("records", pa.binary())])


def _home(records: np.ndarray, n: int) -> np.ndarray:
    """The group of a document; the same for its rows and for records about it.

    It depends on the text, too, so that rows without an id, or with one id, spread.
    """
    doc = records["doc"].astype(np.int64)
    return ((doc ^ (doc >> 17) ^ records["tie"].astype(np.int64)) % n).astype(np.int32)


def _packed(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [(to, kind, S.pack(r)) for kind, records, bucket in parts if len(records) for to, r in S.dealt(records, bucket)]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def _ties(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of each text."""
    view = memoryview(data)
    return np.array([xxhash.xxh64_intdigest(view[a:b], 42) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)


def _earlier(records: np.ndarray, keys: list[str]) -> np.ndarray:
    """Which records start after another record of the same key."""
    if not len(records):
        return np.zeros(0, bool)
    order = np.lexsort([records["at"], records["tie"], records["doc"], *[records[k] for k in reversed(keys)]])
    r = records[order]
    new = np.ones(len(r), bool)
    new[1:] = np.logical_or.reduce([r[k][1:] != r[k][:-1] for k in keys])
    head = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    late = np.zeros(len(r), bool)
    late[order] = (r["doc"] != r["doc"][head]) | (r["tie"] != r["tie"][head]) | (r["at"] != r["at"][head])
    return late


def _docs(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = S.utf8(batch.column("text"))
    return S.longs(batch.column("doc_id")), data, offsets, _ties(data, offsets)


def _parsed(data: np.ndarray, offsets: np.ndarray):
    """(words, first, spans, short symbols, which of them a window can hold)."""
    starts, ends, first = W.split(data, offsets, W.SPACED)
    words = W.hashes(data, starts, ends, W.SPACED)
    return starts, ends, first, words, R.low_symbols(words, first, LOW_ROUNDS)


def _holdable(s: R.Symbols, first: np.ndarray, window: int) -> np.ndarray:
    return (s.lo >= first[s.doc]) & (s.hi <= first[s.doc + 1]) & (s.hi - s.lo <= window)


def _records(dtype, doc, tie, at, **rest) -> np.ndarray:
    out = np.zeros(len(doc), dtype)
    out["doc"], out["tie"], out["at"] = doc, tie, at
    for k, v in rest.items():
        out[k] = v
    return out


def _symbols(window: int, n: int):
    """Documents to records of short symbols and of pairs of high-level symbols."""

    def flush(keys: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        k, p = np.concatenate(keys), np.concatenate(pairs)
        keys.clear(), pairs.clear()
        # One record a key: the first in order; others are repeated here already.
        order = np.lexsort([k["at"], k["tie"], k["doc"], k["key"]])
        new = np.ones(len(k), bool)
        new[1:] = np.diff(k["key"][order]) != 0
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group] if len(k) else np.zeros(0, int)
        many = np.zeros(len(k), bool)
        many[order] = size > 1
        one = np.zeros(len(k), bool)
        one[order] = new
        k["many"] = many
        known = k[many]
        points = _records(_POINT, known["doc"], known["tie"], known["at"])
        # As to pairs, the first goes on; a later one is removed already.
        late = _earlier(p, ["key", "key2"])
        gone = p[late]
        ranges = _records(_RANGE, gone["doc"], gone["tie"], gone["at"], len=gone["len"])
        k, p = k[one], p[~late]
        return _packed(
            [
                ("symbol", k, (k["key"] % np.uint64(n)).astype(np.int32)),
                ("pair", p, (p["key"] % np.uint64(n)).astype(np.int32)),
                ("repeated", points, _home(points, n)),
                ("removed", ranges, _home(ranges, n)),
            ]
        )

    def run(batches):
        keys, pairs, held = [np.empty(0, _KEY)], [np.empty(0, _SPAN)], 0
        for batch in batches:
            ids, data, offsets, ties = _docs(batch)
            for i, j in S.chunks(offsets, S.WIDE_CHUNK_BYTES):
                _, _, first, words, s = _parsed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc, tie, spans = ids[i:j], ties[i:j], W.Spans(words)
                ok = np.flatnonzero(_holdable(s, first, window))
                d = s.doc[ok]
                keys.append(_records(_KEY, doc[d], tie[d], s.lo[ok] - first[d], key=spans.hash(s.lo[ok], s.hi[ok])))
                h = R.high_symbols(s, HIGH_ROUNDS, LOW_ROUNDS + 1)
                a = np.flatnonzero(h.doc[1:] == h.doc[:-1])
                d, begin, end = h.doc[a], h.begin[a], h.end[1:][a]
                long = end - begin >= window
                d, begin, end = d[long], begin[long], end[long]
                pairs.append(_records(_SPAN, doc[d], tie[d], begin - first[d], len=end - begin, key=spans.hash(begin, end), key2=spans.hash(begin, end, 1)))
                held += len(keys[-1]) + len(pairs[-1])
                if held >= BATCH_RECORDS:
                    yield flush(keys, pairs)
                    keys, pairs, held = [np.empty(0, _KEY)], [np.empty(0, _SPAN)], 0
        yield flush(keys, pairs)

    return run


def _by_kind(table: pa.Table) -> dict[str, list]:
    kinds: dict[str, list] = {}
    for kind, records in zip(table.column("kind").to_pylist(), table.column("records")):
        kinds.setdefault(kind, []).append(records.as_buffer())
    return kinds


def _known(kinds: dict[str, list], to: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Results that are final already, passed on to their documents' group."""
    out = []
    for kind, dtype in (("repeated", _POINT), ("removed", _RANGE)):
        if kind in kinds:
            r = S.unpack(kinds[kind], dtype)
            out.append((kind, r, np.full(len(r), to, np.int32)))
    return out


def _compare(n: int):
    """Records of one key group: which symbols occur twice, which spans start earlier."""

    def run(table: pa.Table) -> pa.Table:
        kinds = _by_kind(table)
        out = _known(kinds, table.column("to")[0].as_py())
        if "symbol" in kinds:
            k = S.unpack(kinds["symbol"], _KEY)
            order = np.argsort(k["key"], kind="stable")
            same = np.diff(k["key"][order]) == 0
            twice = np.zeros(len(k), bool)
            twice[order[1:]] = same
            twice[order[:-1]] |= same
            r = k[twice & (k["many"] == 0)]
            r = _records(_POINT, r["doc"], r["tie"], r["at"])
            out.append(("repeated", r, _home(r, n)))
        for kind in ("pair", "window"):
            if kind in kinds:
                p = S.unpack(kinds[kind], _SPAN)
                r = p[_earlier(p, ["key", "key2"])]
                r = _records(_RANGE, r["doc"], r["tie"], r["at"], len=r["len"])
                out.append(("removed", r, _home(r, n)))
        return pa.Table.from_batches([_packed(out)])

    return run


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions some range covers."""
    delta = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0


class _Found:
    """What is known about the documents of one group, by document."""

    def __init__(self, records: np.ndarray):
        order = np.lexsort([records["at"], records["tie"], records["doc"]])
        self.records = records[order]
        self.keys = self.records["doc"].astype(np.int64)

    def of(self, doc: int, tie: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, doc), np.searchsorted(self.keys, doc, side="right")
        r = self.records[a:b]
        return r[r["tie"] == tie]


def _ranges_of(found: _Found, ids, ties, first) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the ranges that ``found`` has, as positions in the chunk."""
    begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(ids)):
        r = found.of(ids[k], ties[k])
        if len(r):
            begin.append(first[k] + r["at"].astype(np.int64))
            end.append(begin[-1] + (r["len"] if "len" in r.dtype.names else 1))
    return np.concatenate(begin), np.concatenate(end)


def _windows(window: int, n: int):
    """Documents and their repeated symbols to the windows still in question."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        kinds = _by_kind(known)
        out = _known({k: v for k, v in kinds.items() if k == "removed"}, known.column("to")[0].as_py()) if known.num_rows else []
        repeated, removed = (_Found(S.unpack(kinds.get(k, []), t)) for k, t in (("repeated", _POINT), ("removed", _RANGE)))
        ids, data, offsets, ties = _docs(docs)
        found = [np.empty(0, _SPAN)]
        for i, j in S.chunks(offsets, S.WIDE_CHUNK_BYTES):
            _, _, first, words, s = _parsed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total = len(words)
            open_ = np.zeros(total, bool)
            size = np.diff(first)
            for a, m in zip(first[:-1], size):
                open_[a : a + max(0, m - window + 1)] = True
            ok = _holdable(s, first, window)
            lo, hi = s.lo[ok], s.hi[ok]
            at, _ = _ranges_of(repeated, ids[i:j], ties[i:j], first)
            again = np.zeros(total + 1, bool)
            again[at] = True
            once = ~again[lo]
            open_ &= ~_covered(total, np.maximum(hi[once] - window, 0), lo[once] + 1)
            begin, end = _ranges_of(removed, ids[i:j], ties[i:j], first)
            open_ &= ~_covered(total, begin, np.maximum(end - window + 1, begin))
            at = np.flatnonzero(open_)
            doc = np.searchsorted(first, at, side="right") - 1
            spans = W.Spans(words)
            found.append(_records(_SPAN, ids[i:j][doc], ties[i:j][doc], at - first[doc], len=window, key=spans.hash(at, at + window), key2=spans.hash(at, at + window, 1)))
        p = np.concatenate(found)
        late = _earlier(p, ["key", "key2"])
        gone = p[late]
        ranges = _records(_RANGE, gone["doc"], gone["tie"], gone["at"], len=gone["len"])
        p = p[~late]
        out += [("removed", ranges, _home(ranges, n)), ("window", p, (p["key"] % np.uint64(n)).astype(np.int32))]
        return pa.Table.from_batches([_packed(out)])

    return run


def _kept(columns: list[str]):
    """Documents and their removed ranges to the words that stay."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        removed = _Found(S.unpack(_by_kind(known).get("removed", []), _RANGE))
        ids, data, offsets, ties = _docs(docs)
        n_words, n_removed, texts = [], [], []
        for i, j in S.chunks(offsets, S.WIDE_CHUNK_BYTES):
            chunk = data[offsets[i] : offsets[j]]
            starts, ends, first = W.split(chunk, offsets[i : j + 1] - offsets[i], W.SPACED)
            begin, end = _ranges_of(removed, ids[i:j], ties[i:j], first)
            gone = _covered(len(starts), begin, end)
            body = chunk.tobytes()
            for k in range(j - i):
                a, b = first[k], first[k + 1]
                at = np.flatnonzero(~gone[a:b]) + a
                n_words.append(b - a)
                n_removed.append(b - a - len(at))
                texts.append(b" ".join([body[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())]))
        out = docs.select(columns)
        out = out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))
        return out.append_column("kept_text", pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))

    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (see the module's account).

    Needs doc_id and text; other columns stay.  Names that clash with the new
    columns' are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "_home")
    columns = docs.columns
    n = S.groups_for(docs) | 1
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long", "n_removed long", "kept_text string"])
    records = docs.select("doc_id", "text").mapInArrow(S.lean(_symbols(window, n)), _PACKED)
    known = records.groupBy("to").applyInArrow(S.lean_group(_compare(n)), _PACKED)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = docs.withColumn("_home", F.pmod(doc.bitwiseXOR(F.shiftright(doc, 17)).bitwiseXOR(tie), F.lit(n)).cast("int"))
    open_windows = dealt.groupBy("_home").cogroup(known.groupBy("to")).applyInArrow(S.lean_groups(_windows(window, n)), _PACKED)
    decided = open_windows.groupBy("to").applyInArrow(S.lean_group(_compare(n)), _PACKED)
    return dealt.groupBy("_home").cogroup(decided.groupBy("to")).applyInArrow(S.lean_groups(_kept(columns)), schema)


def digests(kept: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
