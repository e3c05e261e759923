"""Cleaning a corpus in five stages; each is one operator over all that the stage before it kept.

The classifier drops documents of low quality, exact and near copies are reduced to one document each, the sources are
mixed to their target weights (a document is repeated as often as the mix takes it), and the mix is tokenized.
run() writes each stage as Parquet to the shared checkpoint folder, so a lost executor repeats one stage at most; the
folder is the caller's to remove once the result is read. Empty tables give no rows, columns of any name pass through.

SQL can express neither the classifier nor the tokenizer: there is no ORACLE_SQL, and tests hold each stage against a
brute-force version on a small table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import bpe, exact_dedup, mixing, ngram_join, quality_model
from pitpanel.llm.common import shared_folder, table
from pitpanel.llm.queries import tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of documents it is given, does not reject.

    Null texts count as empty and are scored, too; repeated rows are judged alike; without labels all stay.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z's case) the document with the largest doc_id.

    Null texts count as empty, so one of them stays; null doc_ids lose to others; of repeated rows one stays.
    """
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingle similarity of 0.8 or more, the one with the smallest doc_id.

    Texts without words are no one's copy; null doc_ids lose to others; of repeated rows one stays.
    """
    return ngram_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a null source is a source, an empty text has no size."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each document's whole text; null texts have none."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), *tokenizer()).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", tokenized),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
