"""Exact deduplication: two passes over a Bloom filter, so that only possibly repeated rows shuffle.

The first pass counts the two filter bits of every text's 64-bit hash and keeps the bits that were set
twice. The second pass tests every row: a row with an unset bit is unique and passes straight through. The
others meet by SHA-256. The filter has 16 bits a row and is broadcast, so it has at most 32 MB (``MAX_BLOCKS``). For more rows
than that (16 million) the first pass counts the hashes themselves, 8 bytes a row and reduced map-side, and the filter holds only those that
were found twice. So unique rows pass straight through at any size while at most 16 million texts are repeated; beyond, some of
them join the shuffle and the result stays exact.

Defined results: a null text counts as the empty text; texts are equal when their UTF-8 bytes are. The row
with the largest id stays; a null id is smaller than any other. Rows that share both text and the largest id
are one document: marking gives all of them ``kept``, dropping leaves one. Other columns pass unchanged,
whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.llm.common import MAX_BLOCKS, attach, block_count, bloom_filter, fresh, maybe_in, stored


def _flagged(docs: DataFrame, text_col: str, max_blocks: int) -> tuple[DataFrame, str, int]:
    """``docs`` with a flag column (may occur twice), its name, and the number of rows."""
    total = docs.count()
    hashed, flag = fresh(docs, "_hash"), fresh(docs, "_repeated")
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    blocks = block_count(total, most=1 << 60)
    if blocks <= max_blocks:
        repeated = bloom_filter(rows.select(hashed), hashed, blocks, least=2)
    else:
        again = stored(rows.groupBy(hashed).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(hashed), "repeated-hashes")
        blocks = block_count(again.count(), most=max_blocks)
        repeated = bloom_filter(again, hashed, blocks)
    return maybe_in(rows, hashed, repeated, blocks, flag).drop(hashed), flag, total


def _sha(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    flagged, flag, total = _flagged(docs.select(id_col, text_col), text_col, max_blocks)
    rows = stored(flagged.select(F.col(id_col), _sha(text_col).alias("text_sha256"), F.col(flag).alias("repeated")), "exact-rows")
    unique = rows.where("not repeated").select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = rows.where("repeated").select(id_col, "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    marked = attach(again, groups, "text_sha256", "group_size", total)
    return unique.unionByName(marked.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``. Only possibly repeated rows shuffle."""
    flagged, flag, total = _flagged(docs, text_col, max_blocks)
    sha, keep, size = fresh(docs, "_sha"), fresh(docs, "_keep"), fresh(docs, "_size")
    unique = flagged.where(~F.col(flag)).select(*docs.columns)
    again = stored(flagged.where(F.col(flag)).withColumn(sha, _sha(text_col)).drop(flag), "exact-repeated")
    groups = again.groupBy(sha).agg(F.max(id_col).alias(keep), F.count(F.lit(1)).alias(size))
    kept = attach(again, groups, sha, size, total).where(F.col(id_col).eqNullSafe(F.col(keep)))
    return unique.unionByName(kept.dropDuplicates([id_col, sha]).select(*docs.columns))
