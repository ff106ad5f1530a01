"""Corpus pipeline: the stages a raw document table passes on its way to training data.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a DataFrame that is written as
Parquet and read back as the next one's documents. All but the last return the columns of ``documents``; the last returns the
encoded corpus. NULL texts fail the quality rules; empty tables pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featpipe.llm import decontaminate, jaccard, pieces, quality, surrogates
from featpipe.llm.common import read, stored
from featpipe.llm.queries import PII_KEY

# None: the learned rules, surrogates and token ids have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality.keep_good(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word shingles of similarity 0.8 or more."""
    return jaccard.one_of_each_group(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars follows the new text."""
    out = surrogates.replace_entities(docs, PII_KEY).drop("n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, encoded: doc_id, n_tokens and the digests of ids and decoded text."""
    return pieces.digests(pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", private_data),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result lies in the shared folder before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
