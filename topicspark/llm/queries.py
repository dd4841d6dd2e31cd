"""The training-data operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from topicspark.llm import alignment, ann, bpe, langid, lm, mixing, quality, simhash, tokenfile, toxicity, urlrules, whitening, winnowing
from topicspark.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op1_ann(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op3_lm(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_langid(table(spark, sf_dir, "documents"))


def op5_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.op5_urlrules(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_mixing(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7_simhash(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op8_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op9_tokenfile(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.op11_decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op12_aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op13_whitening(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    own = (op1_ann, op2_toxicity, op3_lm, op4_langid, op5_urlrules, op6_mixing, op7_simhash, op8_bpe, op9_tokenfile, op10_quality, op11_winnowing, op12_alignment, op13_whitening)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.oracle_sql(), "op11_winnowing": winnowing.oracle_sql()}
