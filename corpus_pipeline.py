"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.

Defined results, for every stage: null and empty texts have no language and go with the
first stage, and so does a text of which no word is left with the third; rows with a null
id or with an id that others have are rows like all others; repeated rows and near copies
leave one, that of the smallest id (null first) and then text hash; texts of any length are
worked on whole; an empty table gives an empty one; columns other than doc_id and text
(n_chars apart, which follows the text) come back unchanged, whatever their names, as
stages work beside them under other names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.llm import decontamination, language_id, near_dedup, packing, shared, substring_dedup


def beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """``stage`` of ``docs``, whose columns other than doc_id, text and ``needed`` have names that no operator gives."""
    others = {c: f"_own{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", *needed)}
    out = stage(docs.withColumnsRenamed(others))
    return out.select(*(F.col(f"`{others.get(c, c)}`").alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or without a likely language go."""
    return beside(docs, lambda d: language_id.identified(d).where("lang_pred <> 'und' AND score >= 0.5"), "lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return beside(docs, near_dedup.one_of_each)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go, and documents with no word left."""

    def kept(d: DataFrame) -> DataFrame:
        return substring_dedup.remove_repeats(d).where("n_words > n_removed").withColumn("text", F.col("kept_text"))

    out = beside(docs, kept)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return beside(docs, lambda d: decontamination.decontaminate(d, items).where("NOT contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the language model nor the alignment of near duplicates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir))
    return docs
