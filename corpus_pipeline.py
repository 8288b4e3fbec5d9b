"""From raw documents to token ids: quality filter, exact and near deduplication, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and gives it to the next. All stages but the last return the columns of ``documents``.

Defined results: a null text is an empty one in every stage, but stays null. Rows without an id are judged as others are; they have no
near copies. Rows that share an id are rows of their own, except as near copies, where they are one document. A null source is a source.
Further columns of ``documents`` come along up to the source mix. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from spendweave.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row that is left, as little-endian 32-bit numbers."""
    return byte_bpe.encode(docs).select("doc_id", F.floor(F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]

#: No SQL has the classifier, the Newton steps or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
