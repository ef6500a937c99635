"""Alignment of the tokens that two tokenizers make of one text.

Tokens are intervals of bytes.  A task gathers documents into chunks; for each block of a
chunk DuckDB holds one table of intervals a tokenizer.  An ASOF join finds for every A
token the B token in which it ends, which tells the offsets where both end; a window
numbers these; two more ASOF joins range the tokens of both into the groups between them;
and a join by group gives the linked pairs of ids of each document.  Tables of a block
are dropped before the next, so that a worker holds one block's.  A chunk numbers its
distinct pairs and counts their documents; Spark merges these partial counts, finds the
highest of each A id and sends each chunk the counts of its own pairs back.  Only distinct
pairs of chunks are shuffled as rows, never tokens or links.

Defined results: null and empty texts, and texts whose tokens' bytes differ from a space
and the text, have no tokens (zeros, empty digest); rows that share an id and repeated
rows each count as documents; of pairs with equal counts all are best; texts of any length
are aligned whole; an empty table gives no row; columns other than doc_id and text are
not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm import tokens

#: Text bytes of a block, which DuckDB aligns at once, and of a chunk, which numbers its pairs.
BLOCK_BYTES, CHUNK_BYTES = 1 << 20, 12 << 20
#: Bytes of a group beyond which it is wide.
WIDE = 64
#: Different spaced words whose pieces a worker remembers.
WORDS = 1 << 19
#: Ids of remembered words beyond which all are forgotten.
HELD_IDS = 1 << 23
#: A space as a piece vocabulary shows it.
_MARK = "▁"
_SPACED = re.compile(" +[^ ]*")
_PAIRS = np.dtype([("pair", "<u4"), ("n", "<u4")])

_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()),
     ("ids", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
)
_DDL = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, ids array<long>, docs array<int>"

_ALIGNED = """
CREATE OR REPLACE TEMP TABLE ends AS SELECT a.stop FROM (SELECT stop FROM a) a ASOF JOIN (SELECT stop FROM b) b ON a.stop <= b.stop WHERE a.stop = b.stop;
CREATE OR REPLACE TEMP TABLE cuts AS
SELECT stop, (row_number() OVER (ORDER BY stop))::INT - 1 AS grp, stop - lag(stop, 1, 0) OVER (ORDER BY stop) > {wide} AS wide FROM ends;
CREATE OR REPLACE TEMP TABLE ga AS SELECT a.stop, a.doc, a.id, cuts.grp, cuts.wide FROM a ASOF JOIN cuts ON a.stop <= cuts.stop;
CREATE OR REPLACE TEMP TABLE gb AS SELECT b.stop, b.id, cuts.grp, cuts.wide FROM b ASOF JOIN cuts ON b.stop <= cuts.stop;
"""
#: Groups of more bytes than WIDE link each id once, with how often it stands there, so that a link a pair of tokens is never made.
_LINKED = """
SELECT doc, pair, sum(n)::BIGINT AS n FROM (
  SELECT doc, ga.id::BIGINT << 32 | gb.id AS pair, count(*) AS n FROM ga JOIN gb USING (grp) WHERE NOT ga.wide AND NOT gb.wide GROUP BY 1, 2
  UNION ALL
  SELECT x.doc, x.id::BIGINT << 32 | y.id AS pair, x.n * y.n AS n
  FROM (SELECT grp, doc, id, count(*) AS n FROM ga WHERE wide GROUP BY ALL) x
  JOIN (SELECT grp, id, count(*) AS n FROM gb WHERE wide GROUP BY ALL) y USING (grp)
) GROUP BY doc, pair ORDER BY doc, pair
"""
_DROPPED = "".join(f"DROP TABLE {t};" for t in ("ends", "cuts", "ga", "gb"))


class PlainEncoder(tokens.Encoder):
    """Byte-level ids; strings of special tokens are ordinary text."""

    def __init__(self, path: str | None = None):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        shown = {chr(b): b for b in range(256) if b not in tokens._SHOWN} | {c: b for b, c in tokens._SHOWN.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            pieces[k] = bytes(shown[c] for c in piece) if all(c in shown for c in piece) else piece.encode()
        self.pieces = pieces


class PieceEncoder:
    """Ids of a piece vocabulary.

    No piece holds a space behind another character, so words with the spaces before them
    are encoded each by itself, and words seen before are looked up.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.pieces = [bytes([int(n[1:-1], 16)]) if self.library.is_byte(k) else n.replace(_MARK, " ").encode() for k, n in enumerate(names)]
        self.apart = not any(re.search(f"[^{_MARK}]{_MARK}", n) for n in names)
        self.space = [self.library.piece_to_id(_MARK)]
        self._clear()

    def _clear(self) -> None:
        #: A word's number, and by number the place and number of its ids.
        self.known: dict[str, int] = {}
        self.place, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts with a space before each, which the library adds itself."""
        if not self.apart:
            parts = self.library.encode([t[1:] for t in texts], num_threads=1)
            number = np.array([len(x) for x in parts], np.int64)
            return np.array(list(chain.from_iterable(parts)), np.int32), np.append(0, np.cumsum(number))
        words = [_SPACED.findall(t) for t in texts]
        if len(self.known) > WORDS:
            self._clear()
        known = self.known
        new = list(set(chain.from_iterable(words)) - known.keys())
        if new:
            parts = self.library.encode([w[1:] for w in new], num_threads=1)
            parts = [self.space if w == " " else p for w, p in zip(new, parts)]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            begin = len(self.ids)
            self.place = np.concatenate([self.place, begin + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(parts), np.int32, int(size.sum()))])
        number = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(number.sum()))
        size = self.size[index]
        stop = np.append(0, np.cumsum(size))
        at = np.repeat(self.place[index] - stop[:-1], size)
        at += np.arange(len(at))
        ids = self.ids[at]
        if len(self.ids) > HELD_IDS:
            self._clear()
        return ids, stop[np.append(0, np.cumsum(number))]


class _Pieces:
    """Bytes of the pieces of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ``ids``, where each stops)."""
        size = self.size[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.begin[ids] - stop + size, size)
        at += np.arange(len(at))
        return self.data[at], stop


class Aligner:
    """Both tokenizers and a DuckDB connection of a worker process."""

    def __init__(self, a: str, b: str):
        self.a, self.b = PlainEncoder(a), PieceEncoder(b)
        self.bytes_a, self.bytes_b = _Pieces(self.a.pieces), _Pieces(self.b.pieces)
        # Digests take ids as text: with a comma, a bar and a semicolon behind.
        most = max(len(self.a.pieces), len(self.b.pieces))
        self.shown = pa.array([f"{k}{s}" for s in ",|;" for k in range(most)])
        self.most = most
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")

    def _same(self, ids, offsets, pieces: _Pieces, data, bounds) -> tuple[np.ndarray, np.ndarray]:
        """(whether each text's tokens join to its bytes, where each token stops among these tokens' bytes)."""
        joined, stop = pieces.joined(ids)
        ends = np.append(0, stop)[offsets]
        same = np.diff(ends) == np.diff(bounds)
        if len(joined) == len(data) and same.all():
            wrong = np.flatnonzero(joined != data)
            same[np.searchsorted(bounds, wrong, side="right") - 1] = False
        else:
            for k in np.flatnonzero(same):
                same[k] = np.array_equal(joined[ends[k] : ends[k + 1]], data[bounds[k] : bounds[k + 1]])
        return same, stop

    def aligned(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """(counts by name, digests, (pairs of ids, links of each)) of every text; A ids are the upper halves of pairs."""
        n = len(texts)
        counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests, pairs = [""] * n, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        some = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        if not len(some):
            return counts, digests, pairs
        texts = pc.binary_join_element_wise(" ", texts.take(pa.array(some)), "")
        data, bounds = S.utf8(texts)
        ids_a, at_a = self.a._chunk(data, bounds)
        ids_b, at_b = self.b.encode(texts.to_pylist())
        good = np.ones(len(some), bool)
        tables = {}
        for name, ids, at, pieces in (("a", ids_a, at_a, self.bytes_a), ("b", ids_b, at_b, self.bytes_b)):
            same, stop = self._same(ids, at, pieces, data, bounds)
            good &= same
            tables[name] = ids.astype(np.int32), np.repeat(np.arange(len(some), dtype=np.int32), np.diff(at)), stop, at
        if not good.any():
            return counts, digests, pairs
        for name, (ids, doc, stop, at) in tables.items():
            # Stops count from the beginning of the block's good texts.
            own = stop - np.append(0, stop)[at[doc]]
            size = np.where(good, np.diff(bounds), 0)
            on = good[doc]
            place = (own + (np.cumsum(size) - size)[doc])[on]
            self.db.register(name, pa.table({"doc": doc[on], "id": ids[on], "stop": place if place[-1] >> 31 else place.astype(np.int32)}))
        self.db.execute(_ALIGNED.format(wide=WIDE))
        a = self.db.execute("SELECT doc, id, grp FROM ga ORDER BY stop").fetchnumpy()
        b = self.db.execute("SELECT id, grp FROM gb ORDER BY stop").fetchnumpy()
        links = self.db.execute(_LINKED).fetchnumpy()
        self.db.execute(_DROPPED)
        for name in ("a", "b"):
            self.db.unregister(name)
        doc_a, id_a, grp_a, id_b, grp_b = (np.asarray(x) for x in (a["doc"], a["id"], a["grp"], b["id"], b["grp"]))
        first_a = np.searchsorted(grp_a, np.arange(grp_a[-1] + 2))
        first_b = np.searchsorted(grp_b, np.arange(grp_a[-1] + 2))
        grp_doc = doc_a[first_a[:-1]]
        counts["n_a"][some] = np.bincount(doc_a, minlength=len(some))
        counts["n_b"][some] = np.bincount(grp_doc, np.diff(first_b), len(some)).astype(np.int64)
        counts["n_groups"][some] = np.bincount(grp_doc, minlength=len(some))
        self._digest(digests, some, grp_doc, (id_a, grp_a, first_a), (id_b, grp_b, first_b))
        doc, pair, n = np.asarray(links["doc"]), np.asarray(links["pair"]), np.asarray(links["n"]).astype(np.int64)
        cuts = np.searchsorted(doc, np.arange(len(some) + 1))
        for k, to in enumerate(some.tolist()):
            pairs[to] = pair[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]]
            counts["n_links"][to] = pairs[to][1].sum()
        return counts, digests, pairs

    def _digest(self, digests, some, grp_doc, a, b) -> None:
        """SHA-256 of each text's groups, in order, A ids before B ids."""
        (id_a, grp_a, first_a), (id_b, grp_b, first_b) = a, b
        shown = np.empty(len(id_a) + len(id_b), np.int64)
        behind_a, behind_b = np.zeros(len(id_a), np.int64), np.zeros(len(id_b), np.int64)
        behind_a[first_a[1:] - 1], behind_b[first_b[1:] - 1] = 1, 2
        shown[np.arange(len(id_a)) + first_b[grp_a]] = id_a + behind_a * self.most
        shown[np.arange(len(id_b)) + first_a[grp_b + 1]] = id_b + behind_b * self.most
        body, offsets = S.utf8(self.shown.take(pa.array(shown)))
        body = body.tobytes()
        group = np.searchsorted(grp_doc, np.arange(len(some) + 1))
        ends = offsets[first_a[group] + first_b[group]].tolist()
        for k, to in enumerate(some.tolist()):
            if ends[k + 1] > ends[k]:
                digests[to] = hashlib.sha256(body[ends[k] : ends[k + 1] - 1]).hexdigest()


def aligner(a: str, b: str) -> Aligner:
    return S.kept(("aligner", a, b), lambda: Aligner(a, b))


def default_paths() -> tuple[str, str]:
    """The public vocabularies of A and B; installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _blocks(batches):
    """(doc_ids, texts) of about BLOCK_BYTES each, in order."""
    for batch in batches:
        texts = S.strings(batch.column("text"))
        _, offsets = S.utf8(texts)
        for i, j in S.chunks(offsets, BLOCK_BYTES):
            yield batch.column("doc_id").slice(i, j - i), texts.slice(i, j - i), int(offsets[j] - offsets[i])


def _aligned(paths: tuple[str, str]):
    """Batches of doc_id and text to a row a document, and a row a chunk with its pairs and the documents of each."""

    def run(batches):
        own = aligner(*paths)
        chunk = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def out():
            pairs = [p for r in rows for p in r[3]]
            codes, back, docs = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True, return_counts=True)
            links = np.concatenate([n for _, n in pairs])
            at = 0
            for ids, counts, digests, own_pairs in rows:
                blobs = []
                for p, _ in own_pairs:
                    record = np.empty(len(p), _PAIRS)
                    record["pair"], record["n"] = back[at : at + len(p)], links[at : at + len(p)]
                    blobs.append(S.pack(record) if len(p) else None)
                    at += len(p)
                m = len(ids)
                columns = [pa.array(np.full(m, chunk)), ids, *(pa.array(counts[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digests, pa.string()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(m, _SCHEMA.field("ids").type), pa.nulls(m, _SCHEMA.field("docs").type)], schema=_SCHEMA)
            if len(codes):
                last = {"ids": pa.array([codes], pa.list_(pa.int64())), "docs": pa.array([docs.astype(np.int32)], pa.list_(pa.int32())), "chunk": pa.array([chunk])}
                yield pa.RecordBatch.from_arrays([last.get(f.name, pa.nulls(1, f.type)) for f in _SCHEMA], schema=_SCHEMA)

        for ids, texts, size in _blocks(batches):
            rows.append((ids.cast(pa.int64()), *own.aligned(texts)))
            held += size
            if held >= CHUNK_BYTES:
                yield from out()
                rows, held, chunk = [], 0, chunk + 1
        if rows:
            yield from out()

    return run


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with n_best and count_sum, from the counts of its numbered pairs."""
    k = counts.column("k").to_numpy()
    size = int(k.max()) + 1 if len(k) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[k], best[k] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    n_best, total = [], []
    for blob in docs.column("pairs").to_pylist():
        p = S.unpack([blob] if blob else [], _PAIRS)
        n = p["n"].astype(np.int64)
        n_best.append(int((n * best[p["pair"]]).sum()))
        total.append(int((n * count[p["pair"]]).sum()))
    return docs.drop_columns(["chunk", "pairs"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def aligned_chunks(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The table of chunks: rows of documents with their linked pairs, and of chunks with their distinct pairs."""
    return S.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(paths or default_paths()), _DDL))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count, best: the documents that hold each pair of ids linked, and whether none of its A id has more."""
    partial = chunks.where("ids IS NOT NULL").select(F.explode(F.arrays_zip("ids", "docs")).alias("p"))
    counts = partial.groupBy(F.col("p.ids").alias("pair")).agg(F.sum("p.docs").alias("count"))
    # An A id has no more pairs than B has ids.
    same = Window.partitionBy("a")
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count")
    return counts.withColumn("best", F.col("count") == F.max("count").over(same))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every document."""
    chunks = aligned_chunks(docs, paths)
    counts = S.written(pair_counts(chunks).select("pair", "count", "best"))
    own = chunks.where("ids IS NOT NULL").select("chunk", F.posexplode("ids").alias("k", "pair"))
    answers = own.join(counts, "pair").select(F.col("chunk").alias("of"), "k", "count", "best")
    rows = chunks.where("ids IS NULL").drop("ids", "docs")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_summed, schema)
