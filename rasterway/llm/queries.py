"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.llm import alignment, decontamination, fingerprints, html_text, language_id, language_model, near_dedup, packing, quality, shared, spelling, substring_dedup, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def _labelled(spark: SparkSession, sf_dir: str, label: str, share: int, left: int) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", language_id.held_out(share, left).alias("held_out"), "text")
    return docs, _table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(*_labelled(spark, sf_dir, "quality", 3, 1))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(*_labelled(spark, sf_dir, "toxic", 4, 2))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identified(docs)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.shared_dir(spark)
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"), language_id.held_out(5, 1))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}
