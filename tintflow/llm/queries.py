"""The queries of this package, one opN_<name> for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, html_text, jaccard_join, langid, licenses, lm_scoring, packing, quality, suffix_dedup
from .common import in_fold, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    out = lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[(F.round(c, 6) + 0.0).alias(c) for c in ("target_loss", "background_loss", "score")])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 5, 0)
    out = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held, keep={"held_out": held})
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_sets(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_fold(F.col("doc_id"), 3, 1)
    out = langid.identify(table(spark, sf_dir, "documents"), learn=~held)
    return out.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_benchmark_decontamination, op3_lm_scoring, op4_quality_classifier, op5_license_scan, op6_suffix_array_dedup, op7_ngram_jaccard_join, op8_html_extraction, op9_language_id, op10_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_best_fit_packing": packing.oracle(), "op2_benchmark_decontamination": decontam.oracle(), "op3_lm_scoring": lm_scoring.oracle(), "op5_license_scan": licenses.oracle(), "op6_suffix_array_dedup": suffix_dedup.oracle(),
        "op7_ngram_jaccard_join": jaccard_join.oracle(),
    }
