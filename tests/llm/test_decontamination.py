import random
import re

from rasterway.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for key, text in items:
        ws = words(text)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            wins.setdefault(tuple(ws[i : i + m]), set()).add(str(key))
    out = {}
    for key, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in {len(w) for w in wins}:
            for i in range(len(ws) - m + 1):
                if (w := tuple(ws[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[w]
        out[key] = (len(ws), len(hit), sorted(found), bool(hit))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"Wört{i}" for i in range(30)] + [f"x{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, ", ".join(text(rng.randint(10, 40)))) for i in range(20)]
    items += [(100, "Short item here"), (101, "x1"), (102, None), (103, " .,; "), (104, items[0][1]), (105, "a " * 30)]
    docs = [(0, None), (1, ""), (2, "..."), (3, "SHORT item-here again x1"), (4, "a " * 40), (5, "a " * 9)]
    for i in range(6, 120):
        ws = text(rng.randint(0, 80))
        if i % 2:
            source = words(rng.choice(items[:20])[1])
            at = rng.randint(0, len(ws))
            ws[at:at] = source[rng.randint(0, 5) : rng.randint(6, 40)]
        docs.append((i, " ".join(ws)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in op.decontaminate(d, b).collect()}
    assert got == brute(docs, items)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (1, "two", 6), (None, "one two", 7)], "doc_id long, text string, n_words long")
    items = spark.createDataFrame([(None, "one"), (3, "two"), (3, "one two")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.item_ids) for r in op.decontaminate(docs, items).collect())
    assert got == [(-1, 2, 2, ["3"]), (1, 1, 1, ["3"]), (1, 2, 2, ["3"]), (1, 2, 2, ["3"])]
    assert op.decontaminate(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in op.decontaminate(docs, items.limit(0)).collect()} == {0}


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one"), (None, "two"), (3, "one")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit, r.item_ids, r.contaminated) for r in op.decontaminate(docs, items).collect())
    assert got == [(1, 2, ["3"], True), (2, 0, [], False)]


def test_long_texts_with_many_occurrences(spark):
    window = " ".join(f"k{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"{window} gap " * 8000), (2, "a b " * 50_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, window), (8, window.upper())], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in op.decontaminate(docs, items).collect()}
    assert got == {1: (88_000, 80_000, ["7", "8"]), 2: (100_000, 0, [])}
