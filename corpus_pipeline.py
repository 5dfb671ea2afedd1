"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, decontaminate, near_dup, pii, quality
from plumbline.llm._shared import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and blank texts go; repeated rows stay or go together; a null id and an empty table do no harm.
    """
    return quality.passed(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id.

    Rows that are repeated whole stay once; rows that share an id but not the text stay if the id does. Rows with a null
    id and null, empty or blank texts are no copies of anything and stay. An empty table stays empty.
    """
    gone = near_dup.classify(docs).where("NOT kept").select("doc_id")
    left = docs.join(stored(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)
    again = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).distinct())


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all rows of an id go if one of them does. Null ids and null texts stay; an empty table or benchmark removes nothing."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text (null for a null text). Every row stays, repeated ones too; an empty table stays empty."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left: doc_id, n_tokens, ids (little-endian unsigned 32-bit). Null and empty texts have none; every row stays."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("personal data", redact),
    ("byte-level BPE", tokenize),
]

#: Suffix arrays, similarity joins and BPE are no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
