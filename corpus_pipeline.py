"""The corpus pipeline: documents -> kept -> one of each class -> masked -> mixed -> encoded.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame, which is written
as Parquet and read again.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import jaccard_join, mixing, piece_codec, quality_rules, secrets
from lectern.llm.common import stored, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or a certified cutoff rejects."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked documents."""
    return jaccard_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; every document stays."""
    return secrets.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or cut documents so that sources meet their budgets."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the ids, four bytes each, of every row of the mix."""
    return piece_codec.encoded(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mix),
    ("piece_encoding", encode),
]

#: Encoding and the label-driven cutoffs have no counterpart in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
