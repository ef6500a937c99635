import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rasterway.llm import spelling as op


def brute_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {(a, b) for a in words for b in words if a != b and near(a, b)}


def brute(rows, least=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least and len(w) >= 5}
    near = {}
    for a, b in brute_near(counts):
        near.setdefault(a, []).append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near.get(w, [])), counts[form[w]] if w in form else None) for w, n in counts.items()}


def made_up(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "É", "Bb", "ÿ"]) + w[k + rng.randint(0, 1) :]
            words.append(w)
        rows.append((d, " ".join(words) if words else None))
    return rows


@pytest.mark.parametrize("group", [20000, 12, 1])
def test_near_pairs_equal_brute_force_at_any_size_of_groups(spark, group):
    rng = random.Random(group)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"aaaaaaa" * 3, "aaaaaaa" * 3 + "a", "\U0001f600ab", "\U0001f600b"})
    got = [tuple(r) for r in op.near_pairs(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), group).select("word", "near").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(words)


def test_wavelet_reports_what_lies_in_both_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = op.Wavelet(values)
        q = rng.integers(0, n + 1, (50, 4))
        left, right, low, high = q[:, :2].min(1), q[:, :2].max(1), q[:, 2:].min(1), q[:, 2:].max(1)
        query, value = tree.report(left, right, low, high)
        for k in range(50):
            want = sorted(v for v in values[left[k] : right[k]] if low[k] <= v < high[k])
            assert sorted(value[query == k]) == want


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "HELD", 50)
    rows = made_up(1, 250) + [(None, "abcde abcde abcde fghij"), (None, ""), (7, None), (3, "x" * 400 + " " + "x" * 399), (3, "x" * 400), (4, ("x" * 400 + " ") * 3 + ("x" * 399 + " ") * 7)]
    got = [tuple(r) for r in op.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form for _, form, *_ in want) and any(root != form for _, form, root, *_ in want if form)


def test_ties_copies_and_long_chains(spark):
    rows = [(100, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96 + ["aaaac"] * 6))] * 2
    got = {r.word: r for r in op.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {tuple(r) for r in got.values()} == brute(rows)
    assert len(got) >= 6


def test_empty_and_clashing_columns(spark):
    assert op.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "house house House hous hous hous mouse mouse mouse", "x", 5, "y")]
    got = op.variants(spark.createDataFrame(rows, "doc_id int, text string, word string, n int, key string"))
    assert {tuple(r) for r in got.collect()} == brute([r[:2] for r in rows]) and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
