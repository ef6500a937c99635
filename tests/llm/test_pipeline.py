"""The corpus pipeline, stage by stage, on documents whose fate is known."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rasterway.llm import shared

EN = "the a house river town water people evening stone quiet field with where and of old green past meet run".split()
DE = "der die das haus fluss stadt wasser leute abend stein still feld mit wo und von alt vorbei treffen lauf".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + (str(rng.randrange(10**6)) if rng.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    rows = [(d, prose(rng, EN if d % 2 else DE, rng.randint(60, 120)), "en" if d % 2 else "de", "web", 0) for d in range(80)]
    passage, item = prose(rng, EN, 60), prose(rng, EN, 14)
    rows += [(100, rows[3][1], "en", "web", 0), (101, rows[3][1] + " one more", "en", "web", 0)]
    rows += [(110 + k, f"{prose(rng, EN, 40)} {passage} {prose(rng, EN, 40)}", "en", "web", 0) for k in range(3)]
    rows += [(120, f"{prose(rng, EN, 50)} {item.upper()} {prose(rng, EN, 50)}", "en", "web", 0)]
    rows += [(130, None, None, "web", None), (131, "", "en", None, 0), (132, "12 34 !!", "de", "web", 0)]
    base = shared.shared_dir(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([("b1", item), ("b2", None), ("b3", "")], "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, folder))
        assert docs.columns == columns, name
        seen.append({r.doc_id: r for r in docs.collect()})
    spoken, single, cut, clean = seen
    assert set(spoken) == {*range(80), 100, 101, 110, 111, 112, 120}
    assert set(single) == set(spoken) - {100, 101}
    assert set(cut) == set(single)
    assert cut[110].text == " ".join(single[110].text.split()) and cut[7].text == single[7].text
    for d in (111, 112):
        assert len(cut[d].text.split()) == 80 and cut[d].n_chars == len(cut[d].text)
    assert set(clean) == set(cut) - {120}
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(clean)
    whole = pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_an_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = shared.written(stage(spark, docs, folder))
        assert docs.count() == 0


def test_other_columns_come_back_unchanged(spark, folder):
    """Columns named as operators name theirs, very long texts, null and repeated ids."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20 OR doc_id >= 110")
    names = ["score", "Lang_Pred", "n_words", "n_removed", "kept_text", "n_hit", "item_ids", "contaminated", "class_id", "_id", "_tie", "_key", "held_out", "a.b"]
    rng = random.Random(5)
    more = [(None, prose(rng, EN, 70), "en", "web", 0), (7, prose(rng, DE, 90), "de", "web", 0), (500, prose(rng, EN, 30_000), "en", "web", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    tag = F.concat_ws("/", F.col("doc_id").cast("string"), F.substring("text", 1, 12))
    docs = shared.written(docs.select("*", *(F.concat(F.lit(n), tag).alias(n) for n in names)))
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, folder))
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[n].startswith(n) and r[n] == n + r["score"][5:] for r in rows for n in names)
        ids = [r.doc_id for r in rows]
        assert ids.count(7) == 2 and ids.count(None) == 1 and 500 in ids
