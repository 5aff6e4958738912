"""The corpus pipeline: language ID, quality, exact and near deduplication, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but
the last return the columns of documents. run() applies them to the documents of a folder, each written to the shared folder
before the next reads it. SQL cannot express the fitted models and the tokenizer, so there is no ORACLE_SQL; the stages are
tested against plain versions of themselves.

Null texts count as empty; empty texts have no language and go in the first stage. Columns that documents have besides pass through. An empty table gives no sequences.
Every stage judges rows, not ids: of several texts under one id, or under none, each is kept or goes on its own. Language and quality judge a row where
it is; the two stages that drop copies find rows by the file and place that they are stored in, which is what is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, language, packing, quality, simhash
from loomline.llm.common import forget, written
from loomline.llm.tokens import public_tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; lang is what they declare, source is their host."""
    return language.keep_identified(docs, "text", F.col("lang"), F.col("source"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from those of the labels that are not held out, takes for good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints that differ in four bits at most, the one with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [("language ID", known_language), ("quality classifier", good_quality), ("exact dedup", no_exact_copies), ("SimHash near-dedup", no_near_copies), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
