"""Best-fit packing of token sequences by minimum bin slack.

1. Documents are tokenised where they lie; those longer than a sequence are cut
   into full pieces behind a shorter first one.
2. Only the number of pieces of each length, at most ``capacity`` counts, comes to the
   driver.  There each bin takes the longest length left and, by bitset
   subset-sum over the lengths still available, the combination that fills it
   most.  As long as the lengths last, the same combination fills further bins, so
   a few thousand patterns plan any number of bins.
3. Pieces learn their rank among those of equal length from counts by bucket,
   and rank and length give sequence and offset.  The plan that tasks look up has
   no more rows than patterns times lengths in them, whatever the corpus.

Defined results: null and empty texts are one piece, the end id alone; repeated
rows are packed each; a null id is kept as null; pieces of equal length are taken in the
order of their other columns, and of equal pieces it does not matter which goes where;
a text of any length becomes as many pieces as it needs; an empty table gives no row;
columns of the documents other than doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterway.llm import shared as S
from rasterway.llm.tokens import encoder


def fullest(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length (count available) sum up closest to ``target`` from below.

    Bit s of ``reach`` says that some combination sums up to s.  Longer lengths
    come first, in doubling groups, and the walk back prefers to leave out.
    """
    reach, limit, steps = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, group = min(counts[length], target // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left, group = left - take, group * 2
        if reach >> target & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin, bins filled so) until no length is left."""
    counts, out = dict(counts), []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        chosen = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[k] // n for k, n in chosen.items())
        out.append((chosen, bins))
        for k, n in chosen.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
    return out


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces in a bin, offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for chosen, bins in patterns:
        offset = 0
        for length, n in chosen.items():
            rows.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += length * n
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placed(ranges: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                rows, at = ranges[int(k)], np.flatnonzero(length == k)
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                q = rank[at] - r[:, 0]
                sequence[at] = r[:, 1] + q // r[:, 2]
                offset[at] = r[:, 3] + q % r[:, 2] * k
            keep = [n for n in batch.schema.names if n not in ("_rank", "_bucket")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a long column length, 1 to capacity) with sequence_id and offset.

    ``pieces`` must be stored: it is read twice and has to stay the same.
    """
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal lengths may be a third of all: they spread over buckets.
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(partitions)).cast("int"))
    counts = bucketed.groupBy("length", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy(*pieces.columns))
    ranked = bucketed.withColumn("_own", own).join(offsets, ["_bucket", "length"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias("_rank"))
    # At most ``capacity`` rows.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(_placed(_ranges(plan(histogram, capacity))), schema)


def pieces_of(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""

    def run(batches):
        for batch in batches:
            for row, ids, at in encoder(path).encode_ended(batch.column("text"), end_id):
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                # The first piece holds what full ones leave.
                start = np.where(piece > 0, n[doc] - (pieces[doc] - piece) * capacity, 0)
                length = np.where(piece > 0, capacity, n[doc] - (pieces[doc] - 1) * capacity)
                raw, begin = memoryview(ids).cast("B"), (4 * (at[:-1][doc] + start)).tolist()
                parts = [raw[a : a + b] for a, b in zip(begin, (4 * length).tolist())]
                columns = [batch.column("doc_id").take(pa.array(doc + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(list(map(bytes, parts)), pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenised pieces of ``docs`` with their sequence and place in it."""
    return pack(S.written(pieces_of(docs, capacity, end_id, path, keep_ids)), capacity)
