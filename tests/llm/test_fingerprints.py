import hashlib
from collections import Counter

import numpy as np

from rasterway.llm import fingerprints as op


def prints(texts):
    return op.fingerprints(*op._utf8(texts))


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


def test_collisions_follow_generalised_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a = [f"w{i}" for i in rng.integers(0, 80, rng.integers(5, 200))]
        b = a[: rng.integers(1, len(a) + 1)] + [f"w{i}" for i in rng.integers(0, 80, rng.integers(0, 60))]
        f = prints([" ".join(a), " ".join(b)])
        errors.append(op.likeness(f[0], f[1]) - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_samples_are_those_of_the_definition():
    text = "a b b c c c d " * 3 + "e"
    counts = Counter(text.split())
    hashes = {w: op.W.hashes(*[np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), op.W.SPACED])[0] for w in counts}
    values = {w: op._values(np.array([hashes[w]]), np.array([np.log(n)], np.float32))[0] for w, n in counts.items()}
    want = np.min(list(values.values()), axis=0)
    assert (prints([text])[0] == (want & np.uint64(0xFFFF)).astype(np.uint16)).all()
    # Greater weights win: a word's share of samples follows its weight.
    wins = np.array([np.argmin([values[w][s] for w in counts]) for s in range(op.SAMPLES)])
    assert (wins == list(counts).index("c")).mean() > (wins == list(counts).index("e")).mean()


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "x y " * 300000 + "end", "a", 1), (2, None, "b", 2)]
    out = op.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int")).collect()
    assert {r.doc_id: r.n_chars for r in out} == {1: 1200003, 2: 0}


def test_batches_do_not_matter(monkeypatch):
    texts = [" ".join(f"w{i * k}" for i in range(50)) for k in range(1, 8)] + ["", " \n", "one"]
    whole = prints(texts)
    assert all((prints([t])[0] == whole[k]).all() for k, t in enumerate(texts))
    monkeypatch.setattr(op, "ROWS", 7)
    monkeypatch.setattr(op, "HELD", 11)
    assert (prints(texts) == whole).all()
    assert (whole[7] == whole[8]).all() and (whole[7] != whole[9]).all()


def test_equals_direct_computation(spark):
    rows = [(d, "".join(chr(97 + (d * i) % 26) + (" " if i % 4 == 0 else "") for i in range(d * 7))) for d in range(40)] + [(None, "null id é"), (12, "again 12"), (50, None)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = op.fingerprinted(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for a, b in zip(order, order[1:] + order[:1]):
        (d, text), (e, following) = rows[a], rows[b]
        if 12 in (d, e):
            continue
        text, following = text or "", following or ""
        n = len(text) // 2
        half = text[: len(text) - n] + following[:n]
        f = prints([text, half, following])
        (r,) = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(half.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (op.likeness(f[0], f[1]), op.likeness(f[0], f[2]))
        assert len(r.fingerprint) == 4 * op.SAMPLES and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert op.fingerprinted(df.limit(0)).collect() == []
    (one,) = op.fingerprinted(df.where("doc_id = 9")).collect()
    assert one.near_next == 1.0
