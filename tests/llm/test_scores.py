"""Quality and toxicity: the parts against plain versions, held-out accuracy, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterway.llm import calibration, quality, toxicity

NICE = "the quiet river runs past green fields and old stone houses where people meet in the evening".split()
RUDE = "idiot moron trash stupid loser hate disgusting".split()


def documents(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        bad = d % 4 == 0
        words = [rng.choice(RUDE if bad and rng.random() < 0.4 else NICE) for _ in range(rng.randint(20, 60))]
        if bad:
            words += ["$$$", "!!!", "BUY", "BUY"] * 4
        rows.append((d, " ".join(words), d % 3 == 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, bad int")


def auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return (a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2


@pytest.mark.parametrize("op", [quality, toxicity])
def test_held_out_accuracy(spark, op):
    docs = documents(spark)
    got = op.score(docs.select("doc_id", "held_out", "text"), docs.select("doc_id", F.col("bad").alias("label"))).toPandas()
    both = got.merge(docs.select("doc_id", "bad").toPandas(), on="doc_id")
    assert len(both) == 240 and both.score.between(0, 1).all()
    held = both[both.held_out]
    assert auc(held.score.to_numpy(), held.bad.to_numpy()) > 0.95


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edge_cases(spark, op):
    docs = documents(spark, 60).select("doc_id", "held_out", "text", F.lit("x").alias("score"), F.lit(1).alias("label"))
    more = spark.createDataFrame([(900, False, None, "x", 1), (901, True, "", "x", 1), (902, True, "word " * 50000, "x", 1), (None, True, "idiot", "x", 1), (3, False, "again", "x", 1)], docs.schema)
    docs = docs.unionByName(more)
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(60)] + [(5, None), (None, 1), (900, 0), (7777, 1)], "doc_id long, label int")
    got = op.score(docs, labels).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert {900, 901, 902, None} <= {r.doc_id for r in got}
    none = op.score(docs, labels.limit(0)).collect()
    assert len(none) == 65 and len({r.score for r in none}) == 1
    assert op.score(docs.limit(0), labels).collect() == []


def test_held_out_labels_teach_nothing(spark):
    docs = documents(spark, 120)
    labels = docs.select("doc_id", F.col("bad").alias("label"))
    turned = docs.select("doc_id", F.when(F.col("held_out"), 1 - F.col("bad")).otherwise(F.col("bad")).alias("label"))
    for op in (quality, toxicity):
        a, b = ({r.doc_id: r.score for r in op.score(docs.select("doc_id", "held_out", "text"), x).collect()} for x in (labels, turned))
        assert a == b


@pytest.mark.parametrize("block", [4, 1024])
def test_index_finds_what_a_full_scan_finds(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(150):
        c = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.integers(1, 4, len(c)).astype(float)
        vectors.append((c, rng.integers(1, 3, len(c)), w / np.linalg.norm(w) if len(c) else w))
    index = toxicity.Index(vectors, 40)
    dense = np.zeros((150, 40))
    for k, (c, _, w) in enumerate(vectors):
        dense[k, c] = w
    for c, _, w in vectors[:60]:
        entries, cosines = index.nearest(c, w, 7)
        q = np.zeros(40)
        q[c] = w
        full = dense @ q
        if not len(c):
            assert not len(entries)
            continue
        last = np.sort(full)[-7]
        want = np.flatnonzero((full >= last - 1e-9) & (full > 0))
        assert sorted(entries.tolist()) == want.tolist()
        assert np.allclose(cosines, full[entries])


@pytest.mark.parametrize("dense, batch, cells", [(1, 512, 1 << 16), (20, 7, 30), (1000, 1, 1)])
def test_vectors_searched_together_find_what_a_full_scan_finds(monkeypatch, dense, batch, cells):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    monkeypatch.setattr(toxicity, "BATCH", batch)
    monkeypatch.setattr(toxicity, "BATCH_CELLS", cells)
    rng = np.random.default_rng(6)
    full = np.zeros((700, 50))
    for v in full:
        c = rng.choice(50, rng.integers(0, 30), replace=False)
        v[c] = rng.integers(1, 5, len(c))
        v /= max(np.linalg.norm(v), 1)
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in full]
    index = toxicity.Index([(c, np.ones(len(c), int), w) for c, w in vectors], 50)
    for (entries, cosines), v in zip(index.nearest_of(vectors[:200], 9), full):
        c = full @ v
        want = np.flatnonzero((c >= np.sort(c)[-9] - 1e-9) & (c > 0))
        assert sorted(entries.tolist()) == want.tolist()
        assert np.allclose(cosines, c[entries], atol=1e-12) and (np.diff(cosines) <= 0).all()


def test_calibration_rises(spark):
    rng = random.Random(0)
    rows = [(x := rng.random(), int(rng.random() < x), 1.0) for _ in range(4000)]
    table = calibration.fit(spark.createDataFrame(rows, "raw double, label int, weight double"), 0.0, 1.0)
    got = calibration.apply(np.linspace(0, 1, 21), 0.0, 1.0, table)
    assert (np.diff(got) >= -1e-12).all()
    assert np.abs(got - np.linspace(0, 1, 21))[1:-1].max() < 0.15


@pytest.mark.parametrize("clean, most", [(160, 10_000), (640, 60)])
def test_terms_of_few_examples_count_at_any_balance(spark, monkeypatch, clean, most):
    monkeypatch.setattr(toxicity, "EXAMPLES", most)
    common = " ".join(NICE)
    rows = [(i, False, f"{common} word{i % 9}", 0) for i in range(clean)]
    # Four rude words in four examples each, held by no clean one.
    rows += [(10_000 + i, False, f"{common} rude{i % 4}", 1) for i in range(16)]
    rows += [(20_000 + i, True, f"{common} rude{i % 4}", 1) for i in range(8)] + [(30_000, True, common, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string, label int")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "held_out", "text"), docs.select("doc_id", "label")).collect()}
    assert all(got[20_000 + i].score > 0.9 and set(got[20_000 + i].evidence) == {10_000 + i % 4 + 4 * k for k in range(4)} for i in range(8))
    assert got[30_000].score < 0.1


def test_scores_equal_a_plain_computation(spark):
    """Every step over again, in plain Python, for a small corpus."""
    docs = documents(spark, 160, seed=3)
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "held_out", "text"), docs.select("doc_id", F.col("bad").alias("label"))).collect()}
    rows = docs.collect()
    texts = {r.doc_id: Counter(re.findall(r"[0-9a-z]+", r.text.lower())) for r in rows}
    examples = [r for r in rows if not r.held_out]
    n = [sum(r.bad == k for r in examples) for k in (0, 1)]
    share = n[1] / sum(n)
    terms = set()
    for t in {t for r in examples for t in texts[r.doc_id]}:
        held = [sum(t in texts[r.doc_id] for r in examples if r.bad == k) for k in (0, 1)]
        p0, p1 = held[0] / n[0], held[1] / n[1]
        p = p0 * (1 - share) + p1 * share
        if sum(held) >= toxicity.LEAST and p < 1 and (p0 - p1) ** 2 * n[1] * (1 - share) >= toxicity.ASSOCIATED * p * (1 - p):
            terms.add(t)
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in x for x in texts.values()))) + 1 for t in terms}

    def vector(d):
        v = {t: (1 + math.log(m)) * idf[t] for t, m in texts[d].items() if t in terms}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    vectors = {r.doc_id: vector(r.doc_id) for r in rows}

    def share_of(d, without=None):
        # Vectors without terms are like each other alone.
        cosines = [(sum(x * vectors[r.doc_id].get(t, 0) for t, x in vectors[d].items()) or float(not vectors[d] and not vectors[r.doc_id]), r) for r in examples]
        found = [c for c, _ in cosines if c > 0]
        # Equal vectors are one entry.
        distinct = sorted({tuple(sorted((t, texts[r.doc_id][t]) for t in vectors[r.doc_id])): c for c, r in cosines if c > 0}.values(), reverse=True)
        least = distinct[min(len(distinct), toxicity.NEIGHBOURS) - 1] - 1e-9 if found else 0
        votes = [0.0, 0.0]
        for c, r in cosines:
            if c > 0 and c >= least and r.doc_id != without:
                votes[r.bad] += 1 / (toxicity.NEAR + 1 - min(c, 1))
        return votes[1] / sum(votes) if sum(votes) else share

    raw = np.array([share_of(r.doc_id, r.doc_id) for r in examples])
    at = np.clip(np.floor(raw * calibration.BINS), 0, calibration.BINS - 1).astype(int)
    table = calibration.pool(np.bincount(at, minlength=calibration.BINS).astype(float), np.bincount(at, [r.bad for r in examples], calibration.BINS))
    for r in rows:
        assert abs(got[r.doc_id].score - calibration.apply(np.array([share_of(r.doc_id)]), 0.0, 1.0, table)[0]) < 1e-6


def test_quality_equals_a_plain_computation(spark):
    """Kernel features, normal equations, ridge and calibration over again, on one machine."""
    docs = documents(spark, 160, seed=5)
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "held_out", "text"), docs.select("doc_id", F.col("bad").alias("label"))).collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    one = [quality.statistics(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0] for r in rows]
    x, y = np.array(one), np.array([r.bad for r in rows], float)
    learn = np.array([not r.held_out for r in rows])
    fourier = quality.Fourier(x[learn].mean(0), x[learn].std(0))
    z = fourier(x)
    m = z.shape[1]
    penalty = quality.RIDGE * learn.sum() / m * np.eye(m)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z[learn].T @ z[learn] + penalty + 1e-9 * learn.sum() * np.eye(m), z[learn].T @ y[learn])
    raw = z @ weights
    at = np.clip(np.floor((raw - quality.LOW) / (quality.HIGH - quality.LOW) * calibration.BINS), 0, calibration.BINS - 1).astype(int)
    table = calibration.pool(np.bincount(at[learn], minlength=calibration.BINS).astype(float), np.bincount(at[learn], y[learn], calibration.BINS))
    assert np.mean([abs(got[r.doc_id] - table[k]) < 1e-4 for r, k in zip(rows, at)]) > 0.97  # a sum's last digits may move a row to the next bin


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.STATISTICS))
    f = quality.Fourier(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    z = f(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - kernel).max() < 0.3 and np.abs(z @ z.T - kernel).mean() < 0.06
