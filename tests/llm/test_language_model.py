import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterway.llm import language_model as op
from rasterway.llm.language_id import held_out


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def grams(words):
    words = ["<0>", "<1>", *words]
    return [tuple(words[k - 2 : k + 1]) for k in range(2, len(words))]


class Counts:
    def __init__(self, texts):
        self.one, self.two, self.three, self.c1, self.c2 = (Counter() for _ in range(5))
        for t in texts:
            for u, v, w in grams(tokens(t)):
                self.one[w] += 1
                self.two[v, w] += 1
                self.three[u, v, w] += 1
                self.c1[v] += 1
                self.c2[u, v] += 1
        self.total, self.words = sum(self.one.values()), len(self.one)

    def base(self, w):
        return (self.one[w] + 0.5) / (self.total + 0.5 * (self.words + 1))

    def parts(self, u, v, w):
        kind = lambda c: min(int(math.log2(c)) + 1, op.CLASSES) if c else 0
        bucket = kind(self.c2[u, v]) * (op.CLASSES + 1) + kind(self.c1[v])
        return bucket, [self.three[u, v, w] / self.c2[u, v] if self.c2[u, v] else 0.0, self.two[v, w] / self.c1[v] if self.c1[v] else 0.0, self.base(w)]


def brute(rows, roles):
    """Scores with exact expectation-maximisation over every deleted position."""
    fit = Counts(t for (_, t), r in zip(rows, roles) if r == op.FIT)
    points = [fit.parts(*g) for (_, t), r in zip(rows, roles) if r == op.TUNE for g in grams(tokens(t))]
    side = op.CLASSES + 1
    lam = {b: [1.0 * (b // side > 0), 1.0 * (b % side > 0), 1.0] for b in range(side * side)}
    lam = {b: [x / sum(v) for x in v] for b, v in lam.items()}
    may = {b: [x > 0 for x in v] for b, v in lam.items()}
    for _ in range(op.ROUNDS):
        own = {b: [0.0] * 3 for b in lam}
        for b, m in points:
            p = [x * y for x, y in zip(lam[b], m)]
            for k in range(3):
                own[b][k] += p[k] / sum(p)
        overall = [sum(v[k] for v in own.values()) + 1.0 for k in range(3)]
        for b, v in own.items():
            v = [(x + op.PRIOR * o / sum(overall)) * ok for x, o, ok in zip(v, overall, may[b])]
            lam[b] = [x / sum(v) for x in v]
    train = Counts(t for (_, t), r in zip(rows, roles) if r != op.APART)
    out = []
    for (doc, text), role in zip(rows, roles):
        ws = tokens(text)
        found = [train.parts(*g) for g in grams(ws)]
        score = sum(math.log10(sum(x * y for x, y in zip(lam[b], m))) for b, m in found)
        out.append((doc, role == op.APART, len(ws), sum(train.one[w] > 0 for w in ws), train.total, sum(math.log10(train.base(w)) for w in ws), score))
    return out, lam, train


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Été", "ÉTÉ", "The", "the"]
    rows = []
    for d in range(n):
        w, out = rng.choice(words), []
        for _ in range(rng.randint(0, 80)):
            w = words[(words.index(w) * 7 + rng.choice([0, 0, 0, 1, 5, rng.randrange(30)])) % len(words)]
            out.append(w + rng.choice([" ", " ", "\n", "\t\x0b"]))
        rows.append((d, "".join(out)))
    return rows


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    rows = made_up(2, 150) + [(None, "The the w1"), (None, None), (5, ""), (5, "w1 w2 w3 " * 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    roles = {(r.doc_id, r.text): op.APART if r.h else op.TUNE if r.d else op.FIT for r in frame.select("doc_id", "text", held_out(5, 1).alias("h"), op.deleted().alias("d")).collect()}
    assert all((roles[r] == op.APART) == (zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1) for r in rows)
    want, lam, train = brute(rows, [roles[r] for r in rows])
    got = [tuple(r) for r in op.score(frame, held_out(5, 1)).collect()]
    key = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 2))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9)
        # The table of ratios keeps means of cells instead of single positions.
        assert g[6] == pytest.approx(w[6], rel=3e-3, abs=1e-2)
    # Probabilities after a context add up to one over all words and the unknown one.
    for u, v in [("<0>", "<1>"), ("w1", "w2"), ("?", "w3"), ("?", "?")]:
        total = 0.0
        for w in [*train.one, "unknown"]:
            b, m = train.parts(u, v, w)
            total += sum(x * y for x, y in zip(lam[b], m))
        assert total == pytest.approx(1.0)


def test_held_out_text_like_the_corpus_beats_the_base_and_shuffled_words(spark):
    rows = made_up(3, 300)
    rng = random.Random(1)
    mixed = [(10_000 + d, " ".join(rng.sample(t.split(), len(t.split())))) for d, t in rows]
    frame = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    got = {r.doc_id: r for r in op.score(frame, (F.col("doc_id") >= 10_000) | (held_out(5, 1))).collect()}
    apart = [d for d, t in rows if got[d].held_out and len(t.split()) > 10]
    assert np.mean([got[d].score > got[d].base_score for d in apart]) > 0.9
    assert np.mean([got[d].score > got[10_000 + d].score for d in apart]) > 0.9


def test_empty_tables_and_no_training(spark):
    assert op.score(spark.createDataFrame([], "doc_id long, text string"), held_out(5, 1)).count() == 0
    rows = [(1, "a b", "x", 1), (2, None, "y", 2)]
    got = op.score(spark.createDataFrame(rows, "doc_id int, text string, words string, role int"), F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
