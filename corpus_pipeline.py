"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.  All but the last return the
columns of ``documents``; the last returns, for each document, its place among all ids and their checksum, read back
from the binary files.  Mixing repeats documents whose rate is above one, so later stages see an id more than once.
SQL can't express the stages (learnt models, hashed signatures), so tests hold each against a plain version.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import common, decontam, langid, mixing, neardup, queries, tokens

ORACLE_SQL = None


def settled(stage):
    """The stage, begun with what the driver is done with given back to the system."""

    @wraps(stage)
    def whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.settle(spark)
        return stage(spark, docs, sf_dir)

    return whole


@settled
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model of those with a language."""
    return langid.keep(docs, langid.fit(docs))


@settled
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 80 % or more."""
    return neardup.deduplicate(docs, 80)


@settled
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@settled
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dropped or repeated as their rates for the target mixture say."""
    fitted = mixing.fit(docs, queries.domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), queries.MIXTURE)
    return mixing.mixed(docs, fitted)


@settled
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens and the checksum of the ids."""
    folder, files = tokens.write(docs, queries.tokenizer_path())
    return tokens.read(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixture),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
