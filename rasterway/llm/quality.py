"""Document quality by random Fourier features, ridge and isotonic calibration.

1. Each text becomes a row of statistics: shares of kinds of characters and words,
   repetition, lengths.  Texts are read once; later steps use the statistics.
2. Random Fourier features cos(w x + b) approximate a Gaussian kernel over the
   standardised statistics.  Every task sums its part of the normal equations,
   the sums are added up in two rounds, and one ridge system of fixed size is solved.
3. Ridge scores of the training rows are calibrated by isotonic regression.

Labels are those of (doc_id, label); rows without a label or with a null one teach
nothing.  Defined results: null and empty texts have the statistics of an empty
text and are scored; without any label every score is 0.5; repeated rows are scored
each, and repeated labels count each; texts with equal statistics score alike; texts of
any length are read whole; an empty table gives no row; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm import calibration
from rasterway.llm import shared as S
from rasterway.llm import words as W

#: Fourier features, kernel width in standard deviations, ridge, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 7
#: Range of ridge scores that calibration resolves.
LOW, HIGH = -0.5, 1.5
#: First-round sums.
FAN_IN = 64

#: Kinds of bytes that are counted.
_KINDS = {
    "upper": lambda b: 0x41 <= b <= 0x5A,
    "lower": lambda b: 0x61 <= b <= 0x7A,
    "digit": lambda b: 0x30 <= b <= 0x39,
    "comma": lambda b: b in b".,;:'\"()-",
    "shout": lambda b: b in b"!?",
    "sign": lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~",
    "line": lambda b: b == 0x0A,
    "space": lambda b: b in b" \t\r\x0b\x0c",
    "wide": lambda b: b >= 0x80,
    "control": lambda b: b < 0x09 or 0x0E <= b < 0x20,
}
_TABLE = np.array([[k(b) for b in range(256)] for k in _KINDS.values()])
STATISTICS = len(_KINDS) + 11


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, STATISTICS) of UTF-8 texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, STATISTICS))
    sums = np.zeros(len(data) + 1, np.int64)
    for k, table in enumerate(_TABLE):
        np.cumsum(table[data], out=sums[1:])
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    lines = out[:, list(_KINDS).index("line")] + 1
    out[:, : len(_KINDS)] /= np.maximum(size, 1)[:, None]
    starts, ends, first = W.split(data, offsets, W.SPACED)
    words = W.hashes(data, starts, ends, W.SPACED)
    lengths = ends - starts
    count = np.diff(first)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words):
        np.cumsum(np.append(False, words[1:] == words[:-1]), out=again[1:])
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_TABLE[4] | _TABLE[5])[data], out=signs[1:])
    noisy = np.append(0, np.cumsum(signs[ends] > signs[starts]))
    total = np.append(0, np.cumsum(lengths))
    square = np.append(0, np.cumsum(lengths.astype(float) ** 2))
    at = len(_KINDS)
    for k in range(n):
        a, b, m = first[k], first[k + 1], max(1, count[k])
        mean = (total[b] - total[a]) / m
        spread = max(0.0, (square[b] - square[a]) / m - mean * mean) ** 0.5
        repeats = np.sort(words[a:b])
        head = np.flatnonzero(np.append(True, repeats[1:] != repeats[:-1])) if b > a else np.zeros(1, int)
        most = np.diff(np.append(head, b - a)).max() if b > a else 0
        pairs = words[a : max(a, b - 1)] * np.uint64(3) + words[a + 1 : b] if b - a > 1 else words[a:a]
        out[k, at:] = (
            np.log1p(count[k]), min(mean, 50.0), min(spread, 50.0), len(head) / m, most / m, (again[b] - again[a + 1]) / m if b > a else 0.0,
            len(np.unique(pairs)) / max(1, len(pairs)), (noisy[b] - noisy[a]) / m, np.log1p(size[k] / lines[k]), np.log1p(lines[k]), float(count[k] == 0),
        )
    return out


_SCHEMA = "doc_id long, held_out boolean, x binary"


def _statistics_of(batches):
    for batch in batches:
        data, offsets = S.utf8(batch.column("text"))
        for i, j in S.chunks(offsets):
            x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "held_out", "x"])


def _rows(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, STATISTICS)


def summed(partials: DataFrame, width: int) -> np.ndarray:
    """The sum of float64 vectors, one a task (v binary), in two rounds; ``width`` numbers."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for v in table.column("v"):
            total += np.frombuffer(v.as_buffer(), np.float64)
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    first = partials.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("g")).applyInArrow(add, "v binary")
    rows = first.groupBy().applyInArrow(add, "v binary").collect()
    return np.frombuffer(rows[0].v, np.float64) if rows else np.zeros(width)


class Fourier:
    """Standardised statistics to Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ self.w + self.b) * (2 / FEATURES) ** 0.5
        return np.hstack([z, np.ones((len(z), 1))])


def _moments(batches):
    total = np.zeros(2 * STATISTICS + 1)
    for batch in batches:
        x = _rows(batch)
        total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _normal(fourier: Fourier):
    def run(batches):
        m = FEATURES + 1
        total = np.zeros((m, m + 1))
        for batch in batches:
            z = fourier(_rows(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return run


def _scored(fourier: Fourier, weights: np.ndarray, table: np.ndarray | None):
    def run(batches):
        for batch in batches:
            raw = fourier(_rows(batch)) @ weights
            score = raw if table is None else calibration.apply(raw, LOW, HIGH, table)
            names = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): doc_id, held_out and score.

    ``labels`` (doc_id, label 0 or 1) teach where the document is not held out.
    """
    rows = S.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(_statistics_of, _SCHEMA))
    labels = labels.where("label IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))
    training = S.written(rows.where("NOT held_out").join(labels, "doc_id").select("x", "label"))
    moments = summed(training.mapInArrow(_moments, "v binary"), 2 * STATISTICS + 1)
    n = moments[0]
    if not n:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    mean = moments[1 : STATISTICS + 1] / n
    fourier = Fourier(mean, np.maximum(moments[STATISTICS + 1 :] / n - mean * mean, 0) ** 0.5)
    m = FEATURES + 1
    system = summed(training.mapInArrow(_normal(fourier), "v binary"), m * (m + 1)).reshape(m, m + 1)
    penalty = RIDGE * n / m * np.eye(m)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(system[:, :-1] + penalty + 1e-9 * n * np.eye(m), system[:, -1])
    raw = training.mapInArrow(_scored(fourier, weights, None), "label double, score double")
    table = calibration.fit(raw.select(F.col("score").alias("raw"), "label", F.lit(1.0).alias("weight")), LOW, HIGH)
    return rows.mapInArrow(_scored(fourier, weights, table), "doc_id long, held_out boolean, score double")
