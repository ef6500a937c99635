import numpy as np
import zlib
import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

from rasterway.llm import substring_dedup as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            seen.setdefault(tuple(words[d][i : i + window]), (d, i))
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if seen[tuple(ws[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, long = text(60), text(700)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "a " * 90), (5, "b " + "a " * 50 + "c"), (6, "x y z " * 40)]
    for d in range(7, 80):
        ws = text(rng.randint(5, 150))
        if d % 3 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = passage[rng.randint(0, 10) : rng.randint(25, 60)]
        if d % 11 == 0:
            ws = list(long)
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = "edited"
        rows.append((d, rng.choice([" ", "\n", "  "]).join(ws)))
    rows.append((80, rows[20][1]))
    return rows


def run(spark, rows, **columns):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r[0]: tuple(r[1:]) for r in op.digests(op.remove_repeats(df)).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a " * 30, 1, "k"), (1, "a " * 30, 2, "l"), (1, "a " * 30, 2, "l")], "doc_id long, text string, n_words int, kind string")
    out = op.remove_repeats(df).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed, r.kind) for r in out) == [(False, 30, 30, "l"), (False, 30, 30, "l"), (True, 30, 29, "k")]
    assert len(out) == 3
    assert run(spark, []) == {}


def test_rows_without_an_id_spread_and_long_texts(spark):
    rng = random.Random(9)
    many = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(None, f"null {k} " + " ".join(many[k * 40 : k * 40 + 40])) for k in range(30)] + [(5, " ".join(many)), (6, " ".join(many[100:400]) + " own end")]
    out = op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.n_words): r.n_removed for r in out}
    assert got[6, 302] == 300 and got[5, 60_000] == 1200 and got[None, 42] == 0
    homes = {int(op._home(op._records(op._POINT, np.array([-(2**63)]), np.array([zlib.crc32(t.encode())], np.uint32), np.array([0])), 65)[0]) for d, t in rows if d is None}
    assert len(homes) > 10


def test_texts_of_one_id_that_share_a_crc_keep_their_own_words(spark):
    seen = {}
    for k in range(1_000_000):
        text = f" {k}x".join("abcdefghijklmnopqrstuvw")
        crc = zlib.crc32(text.encode())
        if crc in seen and seen[crc] != text:
            break
        seen[crc] = text
    a, b = seen[crc], text
    for ids in ((1, 5, 5), (None, 5, 5), (None, None, None)):
        got = op.remove_repeats(spark.createDataFrame(list(zip(ids, (a, a, b))), "doc_id long, text string")).collect()
        assert sum(r.n_removed for r in got if r.kept_text == b) == 0 and any(r.kept_text == b for r in got)


HELD = """
import random, re
from pathlib import Path
import pyarrow as pa
from rasterway.llm import shared, substring_dedup as op
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
rng = random.Random(3)
text = lambda: " ".join(f"word{rng.randrange(50_000)}" for _ in range(400))
batch = lambda: pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([text() for _ in range(2000)])], ["doc_id", "text"])
before = held()
for _ in shared.lean(op._symbols(20, 64))(batch() for _ in range(2)):
    pass
print(held() - before)
"""


def test_workers_keep_no_freed_memory():
    """A worker is used again by the next operator: what this one needed is not held until then."""
    out = subprocess.run([sys.executable, "-c", HELD], env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])}, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 75
