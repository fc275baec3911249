"""The corpus pipeline: documents pass the quality rules, lose near copies and personal data, are mixed, and are packed.

Defined cases: null, empty and short texts go with the quality rules; a long text passes every stage whole; of rows that repeat a doc_id all go or
stay together in near-dedup (rows that are equal copies under one id stay), and each is packed; a row without doc_id is linked with nothing, and
mixing, which draws by doc_id, drops or keeps all such rows alike; an empty table gives an empty table; further columns travel along, whatever
their names, up to packing, whose result has pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ladderline.llm.common import cut, documents, remove_tables, tables_written
from ladderline.llm.mixing import mix
from ladderline.llm.near_dups import keep_one
from ladderline.llm.packing import pack
from ladderline.llm.pii import sanitise
from ladderline.llm.quality_rules import keep_good

#: Tokens of good to tokens of toxic documents after mixing. Poor ones have gone with the quality rules, and have no target of their own.
COMPOSITION = {"good": 0.98, "toxic": 0.02}
#: Bytes of texts that a stage sends to a Python worker at once, on both sides of the pipe; stages set it for the session (Spark's own default is 64 MB), and run() puts back what was set before.
ARROW_BATCH, _SETTING = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set(_SETTING, ARROW_BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COMPOSITION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]
#: Hashing, tokenising and the fit are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next.

    Tables that a stage needs no more are removed once the next one is written, and the session's setting is as it was before.
    """
    before = spark.conf.get(_SETTING, None)
    docs, since = documents(spark, sf_dir), tables_written()
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = cut(docs, f"pipeline-{name}")
            # what is read from here on is the last table: a stage's result, or the pieces that packing has written
            remove_tables(spark, since, but_last=1)
            since = tables_written() - 1
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)
    return docs
