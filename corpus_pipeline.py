"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

Toxic documents go, then those that fail the quality rules, then all but one document of each near-duplicate group (five-word
shingles, similarity 0.8); what is left is mixed to target weights (a document taken for two epochs is two rows) and encoded. All
stages but the last return the columns of documents.

Each stage defines its edge cases in its operator: null and empty texts are not toxic, fail the quality rules, and so go there.
Rows that repeat an id are judged row by row, and near-duplicates are found between rows, with or without an id; the row of the
smallest id stays (null last), of one id that whose text's hash is least. In mixing, rows of one id and leaf, or without an id, stand
or fall together. A score right at a threshold is toxic, or kept. Other columns go along, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import bpe, mixing, quality, simhash, toxicity
from topicspark.llm.common import clear_shared, made_folders, shared_dir, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, mixing.source_domain(F.col("source")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.op8_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", not_toxic), ("quality_rules", good_quality), ("simhash_near_dedup", near_dedup), ("mixing", mixed), ("byte_bpe", encoded)]

#: Classifiers, fingerprints and tokens have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), set(made_folders(spark))
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # what the stage wrote for itself, and the documents that it read, are of no use any more
        clear_shared(spark, [p for p in made_folders(spark) if p != path and p not in before])
    return docs
