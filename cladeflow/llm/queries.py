"""Queries of the operators in this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeflow.llm import best_fit_packing, decontamination, exact_dedup, html_extraction, language_id, license_scan, ngram_join, pii, secret_scan, suffix_dedup
from cladeflow.llm.oracles import ORACLES  # noqa: F401  part of this module's face
from cladeflow.runtime import Scratch, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.of_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op1")).drop("row_hash")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op6"))
    return found.drop("row_hash")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    ledger = secret_scan.BlobLedger(spark, scratch.path("ledger"))
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents"), ledger, scratch))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"), Scratch(spark, "op7"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan(table(spark, sf_dir, "documents"), Scratch(spark, "op3")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    index = exact_dedup.DigestIndex(spark, scratch.path("index"))
    return exact_dedup.decide(table(spark, sf_dir, "documents"), index, scratch)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents"), Scratch(spark, "op9"), k=4, num=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii": op3_pii,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_best_fit_packing": op10_best_fit_packing,
}
