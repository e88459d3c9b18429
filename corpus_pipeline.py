"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents: the classifier drops what it rejects, the Jaccard join keeps the smallest doc_id of each group, decontamination
drops documents with a leaked test item, and mixing returns each document as often as the mix takes it. The last stage
writes token ids and returns what it reads back: doc_id, start, n_tokens, ids_crc32.

Nulls, empty and long texts, ties, repeats and empty tables: as in the operators that the stages call.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, decontaminate, jaccard, mixing, tokens
from tessera.llm.common import drop_scratch, scratch_path, table

#: No SQL: boosted trees and byte-pair encoding. The stages are tested against brute-force versions instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_score", classifier.score(F.col("text"), model)).where("_score >= 0.3").drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written in planes and read back."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-ID output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. A stage's intermediate tables go as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    since = drop_scratch(spark, sys.maxsize, "")
    for n, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return made
        path = scratch_path(spark, f"stage-{n}")
        made.write.parquet(path)
        since = drop_scratch(spark, since, path)
        docs = spark.read.parquet(path)
    return docs
