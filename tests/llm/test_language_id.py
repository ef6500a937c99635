import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterway.llm import language_id as op


def segmentations(word, rows, other):
    """Every segmentation of ``word`` as rows of pieces; an unknown character stands alone."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in rows or k == 1:
            for rest in segmentations(word[k:], rows, other):
                yield [rows.get(word[:k], other), *rest]


def test_passes_sum_all_segmentations():
    rows = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", op.MARK, op.MARK + "a"])}
    prob = np.random.default_rng(0).random((len(rows) + 1, 3))
    words = [op.MARK + "".join(x) for n in range(10) for x in (itertools.product("abx", repeat=n) if n < 6 else ["abaxbabab"[:n]])]
    edges = op.Edges(op.Lattice(rows), words)
    want = np.array([[sum(np.prod([prob[r, k] for r in s]) for s in segmentations(w, rows, len(rows))) for k in range(3)] for w in words])
    assert np.allclose(np.exp(edges.likelihoods(prob)), want)
    sums, scale = edges.backward(prob[edges.row])
    assert np.allclose((sums * np.exp(scale))[edges.base], want[edges.order])


def test_long_words_neither_vanish_nor_are_cut():
    rows = {"a": 0, "aa": 1}
    prob = np.array([[1e-9], [1e-30], [1e-12]])
    # f(n) = p1 f(n-1) + p2 f(n-2), by its logarithm.
    logs = [0.0, math.log(1e-9)]
    for _ in range(999):
        x, y = logs[-1] + math.log(1e-9), logs[-2] + math.log(1e-30)
        logs.append(max(x, y) + math.log1p(math.exp(min(x, y) - max(x, y))))
    got = op.Edges(op.Lattice(rows), ["a" * n for n in (1000, 7, 300)]).likelihoods(prob)[:, 0]
    assert np.allclose(got, [logs[1000], logs[7], logs[300]])
    edges = op.Edges(op.Lattice(rows), ["a" * 1000])
    sums, scale = edges.backward(prob[edges.row])
    assert np.isclose(np.log(sums[0, 0]) + scale[0, 0], logs[1000])
    assert (np.abs(np.log(sums)) < 600).all()


def test_expected_counts_are_shares_of_all_segmentations():
    rows = {p: i for i, p in enumerate([op.MARK, "a", "aa", op.MARK + "a"])}
    prob = np.random.default_rng(2).random((len(rows) + 1, 2))

    class State:
        value = prob

    words, langs, n = ["aaa" * 5, "a", "ba"], ["x", "y", "x"], [3, 5, 2]
    (out,) = op._expected(rows, {"x": 0, "y": 1}, State)([pa.RecordBatch.from_arrays([pa.array(words), pa.array(langs), pa.array(n)], ["word", "lang", "n"])])
    want = Counter()
    for w, lang, m in zip(words, langs, n):
        k = "xy".index(lang)
        paths = [(s, math.prod(prob[r, k] for r in s)) for s in segmentations(op.MARK + w, rows, len(rows))]
        for s, p in paths:
            for r in s:
                want[r, k] += m * p / sum(p for _, p in paths)
    got = {(r["r"], r["k"]): r["n"] for r in out.to_pylist()}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in got)


def test_words_are_runs_of_letters():
    assert op.words_of("Straße, l'ÉTÉ—no²½①x_1 İz 漢字\u2003ab\u00a0c٣d") == ["straße", "l", "été", "no", "x", *"İz".lower().replace("\u0307", " ").split(), "漢字", "ab", "c", "d"]
    assert op.words_of("²½ 12 --") == []


def test_marks_stay_with_their_letters():
    assert op.words_of("हिन्दी भाषा।") == ["हिन्दी", "भाषा"] and op.words_of("שָׁלוֹם 12 عَرَبِيّ") == op.words_of("שָׁלוֹם") + op.words_of("عَرَبِيّ")
    assert len(op.words_of("שָׁלוֹם")) == 1 and op.words_of("cafe\u0301, CAFÉ") == ["café", "café"]
    assert op.words_of("\u093f \u0301 \u0951x \u20dd") == ["\u0951x"]
    model = op.Model(["x"], {"a": 0}, np.full((2, 1), 0.5))
    assert model.texts(["\u0301 \u093f 7", "हिन्दी"])[0] == ["und", "x"]


def test_text_is_the_product_of_its_words(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 2)
    rows = op.vocabulary()
    prob = np.random.default_rng(0).random((len(rows) + 1, 2)) / 10
    model = op.Model(["x", "y"], rows, prob)
    total = model.words(["the", "cat", "the"]).sum(0)
    for _ in range(2):
        langs, scores = model.texts(["The cat, THE 42!", None, "² ½ ①", "cat"])
        assert langs[0] == ["x", "y"][int(total.argmax())] and langs[1] == langs[2] == "und"
        assert math.isclose(scores[0], 1 / (1 + math.exp(-op.TEMPER * abs(total[0] - total[1]))))


def test_learns_and_edge_cases(spark):
    en, de = "the house and the river of this town with water", "der fluss und das haus in dieser stadt mit wasser"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", i) for i in range(60)]
    rows += [(100, None, "en", 0), (101, "", None, 0), (102, "123 !!", "de", 0), (None, "the water of the town", None, 0), (1, en, "en", 1), (103, "haus " * 20000, "de", 0), (104, "wasser" * 400, "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = op.identified(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[None][0] == "en" and got[103][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert op.identified(df.limit(0)).collect() == []
    nothing = op.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
