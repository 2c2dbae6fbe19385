"""The operators applied to the driver tables: one query each, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import bpe, embedding_dedup, exact_dedup, fingerprints, html_text, importance, license_texts, licenses, lm_scoring, merkle, mixing, near_dedup, secrets, toxicity
from furrow.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir), singles=True)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op4_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_texts.scan_license_texts(documents(spark, sf_dir))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(*exact_dedup.halves(documents(spark, sf_dir)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("times")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_lm_scoring,
        op3_html_extraction,
        op4_license_scans,
        op4_license_texts,
        op5_document_fingerprints,
        op6_near_dedup,
        op7_exact_dedup,
        op8_bpe,
        op9_secret_scans,
        op10_source_mixing,
        op11_importance_resampling,
        op12_merkle_manifest,
        op13_embedding_near_dedup,
    )
}

#: DuckDB SQL where SQL can express the result.
ORACLES: dict[str, str] = {
    "op4_license_scans": licenses.SQL,
    "op4_license_texts": license_texts.sql(),
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_source_mixing": mixing.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_merkle_manifest": merkle.sql(),
    "op13_embedding_near_dedup": embedding_dedup.SQL,
}
