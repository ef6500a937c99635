import random
import re
from collections import Counter

from rasterway.llm import components
from rasterway.llm import near_dedup as op


def labelled(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(ws))
    seen, out = Counter(), []
    for i in range(len(ws) - k + 1 if ws else 0):
        g = tuple(ws[i : i + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute(rows):
    items = {d: labelled(t) for d, t in rows}
    parent = {d: d for d in items}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in items:
        for b in items:
            if a < b and items[a] and items[b]:
                total = len(items[a]) + len(items[b])
                if min(len(items[a]), len(items[b])) / max(len(items[a]), len(items[b])) >= 0.8 and (m := lcs(items[a], items[b])) / (total - m) >= 0.8:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: root(d) for d in items}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    rows, base = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "one two three"), (5, " \n")], [text(rng.randint(20, 120)) for _ in range(6)]
    for d in range(6, 90):
        ws = list(rng.choice(base)) if d % 3 else text(rng.randint(1, 60))
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = f"e{d}"
        rows.append((d, " ".join(ws)))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in op.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want
    assert len(set(want.values())) < len(want) - 10


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(d, " ".join(base[:d] + ["new%d" % d] + base[d + 1 :])) for d in range(60)] + [(100 + d, f"other text number {d} of its own kind entirely {d}") for d in range(5)]
    got = {r.doc_id: r.class_id for r in op.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[d] for d in range(60)} == {0}
    assert all(got[100 + d] == 100 + d for d in range(5))


def test_one_of_each_and_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, None, 3), (3, "", 4), (1, "x y", 5)], "doc_id long, text string, class_id int")
    out = op.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 1, "x y"), (False, 2, ""), (False, 3, ""), (True, 0, "a b c d e f")]
    assert op.classes(df.limit(0)).collect() == []


def test_long_texts(spark):
    rng = random.Random(4)
    many = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    other = list(many)
    for _ in range(300):
        other[rng.randrange(len(other))] = "edited"
    rows = [(1, " ".join(many)), (2, " ".join(other)), (3, " ".join(many[:20_000])), (4, " ".join(reversed(many)))]
    got = {r.doc_id: r.class_id for r in op.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tables = []
    monkeypatch.setattr(components, "written", lambda df, write=components.written: tables.append(write(df)) or tables[-1])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        # Chains of five nodes each.
        links = [(k, k + 1) for k in range(3000) if k % 5 < 4]
        found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["node"], r["class"]) for r in found) == [(k, k - k % 5) for k in range(3000)]
    assert len(tables) > 2 and all(len(t.inputFiles()) <= components.LEAST_FILES for t in tables[1:])
