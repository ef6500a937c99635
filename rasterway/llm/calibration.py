"""Isotonic calibration from counts in fixed bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of raw scores; what comes to the driver has this many rows at most.
BINS = 4096


def pool(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of positives, by pooling adjacent violators; empty bins interpolate."""
    filled = np.flatnonzero(total > 0)
    if not len(filled):
        return np.zeros(len(total))
    blocks: list[list[float]] = []
    for n, p in zip(total[filled], positive[filled]):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, p1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + p1, blocks[-1][2] + k1]
    values = np.concatenate([np.full(k, p / n) for n, p, k in blocks])
    return np.interp(np.arange(len(total)), filled, values)


def fit(scored: DataFrame, low: float, high: float) -> np.ndarray:
    """Calibrated value of each bin from (raw, label, weight) rows, whatever their number."""
    at = F.floor((F.col("raw") - low) / (high - low) * BINS)
    bins = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).cast("int").alias("bin")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("p"))
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in bins.collect():
        total[r.bin], positive[r.bin] = r.n, r.p
    return pool(total, positive)


def apply(raw: np.ndarray, low: float, high: float, table: np.ndarray) -> np.ndarray:
    return table[np.clip(np.floor((raw - low) / (high - low) * BINS), 0, BINS - 1).astype(int)]
