import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterway.llm import packing, shared, token_files
from rasterway.llm.tokens import Encoder, default_path

PLAIN = Tokenizer.from_file(default_path())
ENCODER = Encoder()
TEXTS = ["", " ", "a", "it's  two\n\n spaces ", "x y z\t w", "née ß\r\n<|endoftext|> end", "word " * 3000, None, "a\nb c\nd", "\x1c a \x85b c"]


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def encoded(encoder, texts):
    """Ids of each text, by chunks of a column."""
    return [x[a:b].tolist() for _, x, at in encoder.encode_column(pa.array(texts)) for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "a", "'s", "B1", "é", " ", "\t", "..", "　", "\x1c", "  ", "don't", "🙂", "<|endoftext|>", "\x85", "\u2009", "Ünï", "q" * 40])).map("".join))
def test_pieces_equal_whole_text(text):
    assert encoded(ENCODER, [text]) == [ids(text)]


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("rasterway.llm.tokens.SLOTS", 4)
    monkeypatch.setattr("rasterway.llm.tokens.ARENA", 8)
    e = Encoder()
    for text in ("one two three four", "five six seven one one", "one two", "x" * 40 + " " + "y" * 40, "y" * 40):
        assert encoded(e, [text, text]) == [ids(text)] * 2


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 40))
def test_fullest_is_the_best_sum(counts, target):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    chosen = packing.fullest(counts, target)
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= target)
    assert all(n <= counts[k] for k, n in chosen.items())


def best_fit_decreasing(counts, capacity):
    room = [0] * (capacity + 1)
    bins = 0
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            r = next((r for r in range(k, capacity + 1) if room[r]), None)
            if r is None:
                bins, r = bins + 1, capacity
            else:
                room[r] -= 1
            room[r - k] += 1
    return bins


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    counts = {rng.randint(1, 256): rng.randint(1, 500) for _ in range(150)}
    used = defaultdict(int)
    bins = 0
    for chosen, n in packing.plan(counts, 256):
        assert sum(k * m for k, m in chosen.items()) <= 256
        bins += n
        for k, m in chosen.items():
            used[k] += m * n
    assert used == counts
    assert bins <= best_fit_decreasing(counts, 256) * 1.005 + 1


def frame(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (None, "no id"), (3, "again 3")], "doc_id long, text string")


def test_packing(spark):
    rows = packing.pack_documents(frame(spark), capacity=64, keep_ids=True).collect()
    places, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.piece, r.start, r.ids))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for d, text in enumerate(TEXTS):
        if d != 3:
            got = np.frombuffer(b"".join(x for _, _, x in sorted(documents[d])), "<u4").tolist()
            assert got == [*ids(text), 2]
    assert len(documents[6]) == -(-(len(ids(TEXTS[6])) + 1) // 64)
    assert packing.pack_documents(frame(spark).limit(0)).collect() == []


@pytest.mark.parametrize("tokens", [50, 1 << 20])
def test_token_files(spark, monkeypatch, tokens):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", tokens)
    path = shared.shared_dir(spark)
    token_files.write(frame(spark), path)
    rows = token_files.read(spark, path, keep_ids=True).collect()
    by_start = sorted(rows, key=lambda r: r.start)
    assert by_start[0].doc_id is None
    at, last = 0, -1
    for r in by_start:
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert got in [[*ids(t), 0] for t in ([TEXTS[r.doc_id], "again 3"] if r.doc_id is not None else ["no id"])]
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert len(rows) == len(TEXTS) + 2
    shards = spark.read.parquet(path).collect()
    shard = token_files.Shard(shards[0].asDict())
    documents = [shard.document(k).tolist() for k in range(len(shard.ends))]
    assert sum(documents, []) == shard.decode(0, len(shard.symbols))[0].tolist()


def test_grammar_round_trip_and_gain():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 40, rng.integers(2, 9)) for _ in range(30)]
    seq = np.concatenate([phrases[i] for i in rng.integers(0, 30, 4000)] + [np.zeros(101, int)]).astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[rng.integers(0, len(seq), 300)] = True
    last[-1] = True
    for first_rule in (40, 65530, 70000):  # the second leaves room for six rules
        symbols, ends, rules, rounds = token_files.compress(seq, last, first_rule)
        assert len(rules) == 6 or len(symbols) < len(seq) / 2
        row = dict(width=4, first_rule=first_rule, rules=rules.tobytes(), rounds=rounds.tobytes(), lengths=token_files.lengths(rules, rounds, first_rule).astype(np.uint32).tobytes(), symbols=symbols.astype(np.uint32).tobytes(), ends=ends.astype(np.uint32).tobytes())
        shard = token_files.Shard(row)
        assert (shard.decode(0, len(symbols))[0] == seq).all()
        flat, begin, length = token_files.expansions(rules, rounds, first_rule)
        assert (length == shard.lengths).all() and all(n == len(flat[b : b + n]) for b, n in zip(begin, length))
        stops = np.flatnonzero(last) + 1
        alone = token_files.Shard(row)
        for k in (0, 7, 50):
            whole = seq[(stops[k - 1] if k else 0) : stops[k]]
            assert (alone.document(k) == whole).all()
            for a, b in ((0, 1), (3, 9), (5, 5), (len(whole) - 2, len(whole) + 5)):
                assert alone.document(k, max(a, 0), b).tolist() == whole[max(a, 0) : b].tolist()
        assert alone._whole is None  # no rule was expanded but those of these documents
        if len(rules) != 6:  # no pair is left that occurs often apart from itself
            pairs = Counter((int(a), int(b)) for k, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if k not in set(ends.tolist()) and a != b)
            assert max(pairs.values(), default=0) < 2 * token_files.LEAST


def test_winners_take_turns():
    at, rank = np.array([0, 1, 2, 3, 7, 8, 9]), np.array([5, 5, 5, 5, 1, 9, 1])
    assert token_files._winners(at, rank).tolist() == [True, False, True, False, False, True, False]


def test_no_documents(spark):
    path = shared.shared_dir(spark)
    token_files.write(frame(spark).limit(0), path)
    assert token_files.read(spark, path).collect() == []


def test_other_columns_do_not_matter(spark):
    wide = frame(spark).selectExpr("*", "'x' AS n_tokens", "1 AS start", "2 AS length", "3 AS ids", "4 AS _rank", "5 AS first_id", "6 AS piece")
    path = shared.shared_dir(spark)
    token_files.write(wide, path)
    assert token_files.read(spark, path).count() == packing.pack_documents(wide).where("piece = 0").count() == len(TEXTS) + 2


def test_rows_without_an_id_spread_over_partitions(spark):
    many = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text")
    path = shared.shared_dir(spark)
    token_files.write(many, path)
    shards = spark.read.parquet(path).select("part").distinct().count()
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert shards > 10 and len(rows) == 4000 and rows[-1].start + rows[-1].n_tokens == sum(r.n_tokens for r in rows)
