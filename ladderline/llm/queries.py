"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ladderline.llm.common import documents, remove, shared_dir
from ladderline.llm.fingerprints import compare_with_next
from ladderline.llm.infill import digests
from ladderline.llm.licenses import scan_licenses
from ladderline.llm.mixing import mixing_rates
from ladderline.llm.near_dups import near_duplicates
from ladderline.llm.packing import pack
from ladderline.llm.pii import find_personal_data
from ladderline.llm.quality_knn import quality_scores
from ladderline.llm.quality_rules import MEASURES, judged
from ladderline.llm.secrets import scan_secrets
from ladderline.llm.source_audit import audit_sources
from ladderline.llm.substring_dups import without_copies
from ladderline.llm.token_counts import count_tokens
from ladderline.llm.twins import ORACLE_SQL


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir)).drop("text_hash")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(documents(spark, sf_dir)).drop("kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", *MEASURES)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir)).drop("found", "secret_score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, which begins empty, so that every call counts all texts; it goes when the counts are written."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    found = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), cache)
    remove(spark, cache)
    return found


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op1's result SQL can say: which text follows which, and the edited texts."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def personal_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3's result SQL can say: the spans of plain patterns."""
    return op3_pii(spark, sf_dir).drop("spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10's result SQL can say: the spans of plain patterns."""
    return op10_secret_scans(spark, sf_dir).drop("spans")


__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_fingerprints, op2_packing, op3_pii, op4_quality_classifier, op5_license_scans, op6_mixing, op7_suffix_dedup, op8_quality_rules, op9_near_dedup, op10_secret_scans, op11_token_counts, op12_infill, op13_source_audit, edited_texts, personal_base_spans, secret_base_spans)
}
