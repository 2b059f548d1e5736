"""A corpus from raw documents: quality, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import materialise, table, unused
from fieldquarry.llm.mil_q import THRESHOLD, scored
from fieldquarry.llm.minhash import near_duplicates
from fieldquarry.llm.packing import pack
from fieldquarry.llm.pii import pseudonymise
from fieldquarry.llm.pii_q import key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out fold, doesn't reject."""
    own = unused("score", docs.columns)
    return scored(docs, table(spark, sf_dir, "labels"), own).filter(F.col(own) >= THRESHOLD).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates (similarity 0.8 or more); rows without an id stay."""
    gone = near_duplicates(docs, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(materialise(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms; ``n_chars`` follows the text."""
    out = pseudonymise(docs, key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", dedup), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None  # a classifier and tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
