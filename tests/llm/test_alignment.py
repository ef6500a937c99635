import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rasterway.llm import alignment as op

PATHS = op.default_paths()


def plain_tokens(text):
    """[(id, bytes)] of both tokenizers, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = plain_tokens.__dict__.setdefault("t", Tokenizer.from_file(PATHS[0]))
    t.encode_special_tokens = True
    sp = plain_tokens.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=PATHS[1]))
    shown, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            shown[chr(b)] = b
        else:
            shown[chr(256 + k)] = b
            k += 1
    a = [(i, bytes(shown[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def brute(rows):
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = plain_tokens(text)
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = []
                for side in (a, b):
                    at, own = 0, []
                    for _, x in side:
                        at += len(x)
                        own.append(at)
                    ends.append(own)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                low = 0
                for c in cuts:
                    groups.append([[i for (i, _), e in zip(side, own) if low < e <= c] for side, own in zip((a, b), ends)])
                    low = c
        docs.append((doc_id, groups))
    held = Counter()
    links = []
    for _, groups in docs:
        own = Counter((x, y) for a, b in groups for x in a for y in b)
        held.update(own.keys())
        links.append(own)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, groups), own in zip(docs, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            sum(n for p, n in own.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in own.items()),
        ))
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    bits = ["the ", "house", " ", "  ", "\n", "été", "学校", "हिन्दी", "😀", "​", "a", "ing ", "1234", "<s>", "<|endoftext|>", "</s>", "<0x41>", "tion", "\t", ".", "'s", "\r\n", "====", " ", "Ġ", "\x00"]
    rows = []
    for d in range(n):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.05:
            text += "▁x"
        rows.append((d, text))
    return rows


def test_words_with_their_spaces_are_encoded_as_whole_texts_are():
    own = op.PieceEncoder(PATHS[1])
    texts = [t for _, t in made_up(5, 600) if t] + [" ", "  ", " a", "a ", "\n", "x" * 500 + " " + "  y" * 300]
    ids, at = own.encode([" " + t for t in texts])
    assert own.apart
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.library.encode(t), t


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    monkeypatch.setattr(op, "CHUNK_BYTES", 2 * block)
    rows = made_up(1, 120) + [(None, "no id"), (None, "no id"), (7, None), (7, ""), (8, "▁"), (9, "=" * 3000 + " " * 70 + "a" * 2000), (10, "the house " * 400)]
    got = op.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_texts_that_do_not_come_back_have_no_tokens():
    own = op.aligner(*PATHS)
    counts, digests, pairs = own.aligned(pa.array(["a b", "▁a", "", "c"]))
    assert counts["n_a"].tolist() == [2, 0, 0, 1] and digests[1] == digests[2] == "" and digests[3]
    assert [len(p) for p, _ in pairs] == [2, 0, 0, 1] and (np.array([n.sum() for _, n in pairs]) == counts["n_links"]).all()


def test_nothing_of_a_block_stays():
    own = op.aligner(*PATHS)
    for text in ("the house " * 2000, "a"):
        own.aligned(pa.array([text, "=" * 300 + " x"]))
        assert own.db.execute("SELECT count(*) FROM duckdb_tables()").fetchall() == [(0,)]
        assert own.db.execute("SELECT sum(memory_usage_bytes) FROM duckdb_memory()").fetchall()[0][0] < 2 << 20


def test_empty_and_clashing_columns(spark):
    assert op.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_links == 0
    rows = [(1, "one two", 5, "x", 2.0)]
    got = op.align(spark.createDataFrame(rows, "doc_id int, text string, chunk int, pairs string, n_a double"))
    assert [tuple(r) for r in got.collect()] == brute([r[:2] for r in rows])
