"""A corpus pipeline of four stages: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. ``run`` starts
from the ``documents`` table, writes each stage's rows as Parquet into the shared folder and
reads them again for the next one, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedmine.llm import packing, quality, secret_scan, simhash
from feedmine.llm.common import shared_folder
from feedmine.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; all others go."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_rules(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id."""
    prepare(spark)
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and ``n_chars`` set anew; a clean text stays as it is."""
    prepare(spark)
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most 4096 ids."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1, capacity=4096)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: Hashing, trained trees and best-fit packing aren't SQL; tests/llm hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
