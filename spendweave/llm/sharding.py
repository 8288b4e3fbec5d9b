"""Sharding by extendible hashing: a bucket is a prefix of the key's hash, and only oversized buckets split.

Every row has a 60-bit hash of its key. A shard is the shortest prefix whose rows fit the byte limit. The
sizes come from one histogram by a prefix a few bits longer than an even split would need; its sums give
all shorter prefixes. Buckets that are still too large there are counted again with more bits, they alone,
until every shard fits or cannot split: rows of one key always share a shard, so a key that is larger than
the limit gets a shard of its own, marked by ``shard_bytes`` above the limit.

Shards are written as folders of Parquet files, and their rows and bytes are taken from what is read back.

Defined results: a null or empty text has 0 bytes; null keys hash like the text '\\0'. An empty table has no
shards. Rows that fit together are one shard with the empty prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.llm.common import fresh, stored
from spendweave.session import cut_lineage

HASH_BITS = 60
#: Bytes of text a shard may have.
SHARD_BYTES = 16 << 20
#: Bits that the histogram has beyond an even split, and bits that each further count adds.
SPARE_BITS = 4
#: Shards whose prefixes and names, some 100 bytes each, may be broadcast.
MOST_BROADCAST_SHARDS = 200_000


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0"))), 1, 15), 16, 10).cast("long")


def _prefix(hashed: Column, depth: Column) -> Column:
    return F.call_function("shiftright", hashed, (F.lit(HASH_BITS) - depth).cast("int"))


def _name(prefix: Column, depth: Column) -> Column:
    """The prefix in bits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0")))


def shard_directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Shards (depth, prefix, shard_bytes, shard_rows) of rows (h, bytes)."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, SPARE_BITS + max(0, math.ceil(math.log2(max(1, total / limit)))))
    open_rows, shards = rows, None
    while True:
        fine = open_rows.groupBy(_prefix(F.col("h"), F.lit(high)).alias("fine")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        fine = cut_lineage(fine)
        levels = fine.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
            "prefix", F.call_function("shiftright", F.col("fine"), (F.lit(high) - F.col("depth")).cast("int")))
        sums = levels.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("h0") == F.col("h1")))
        found = levels.select("fine", "depth", "prefix").join(fits.drop("h0", "h1"), ["depth", "prefix"]).groupBy("fine").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s"))
        found = cut_lineage(found)
        leaves = found.select("s.*").distinct()
        shards = leaves if shards is None else shards.unionByName(leaves)
        left = fine.join(found.select("fine"), "fine", "left_anti")
        if high == HASH_BITS or left.isEmpty():
            return shards
        open_rows = open_rows.withColumn("fine", _prefix(F.col("h"), F.lit(high))).join(left.select("fine"), "fine", "left_semi").drop("fine")
        low, high = high + 1, min(HASH_BITS, high + SPARE_BITS)


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: the key, ``n_bytes``, ``shard`` (its hash prefix in bits), ``shard_depth``, ``shard_bytes``, ``shard_rows``."""
    sized = stored(docs.select(
        F.col(key_col).alias("_key"), key_hash(F.col(key_col)).alias("h"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes")), "shard-sizes")
    shards = stored(shard_directory(sized.select("h", "bytes"), limit), "shard-directory")
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most HASH_BITS + 1
    if not depths:
        depths = [0]
    probe = sized.select("*", F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")).withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
    name = _name(F.col("prefix"), F.col("depth"))
    return probe.join(shards, ["depth", "prefix"]).select(
        F.col("_key").alias(key_col), F.col("bytes").alias("n_bytes"), name.alias("shard"), F.col("depth").cast("int").alias("shard_depth"),
        "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> str:
    """Writes the rows of ``docs`` with one folder per shard under ``path``; returns the name of the folders' column.

    The name is ``shard``, with underscores before it if ``docs`` has such a column; its values are ``s`` and the prefix. Rows meet the
    directory by a join for each depth that occurs, of a broadcast up to ``MOST_BROADCAST_SHARDS`` shards, so texts are shuffled once,
    to their shards; adaptive execution splits a shard that one key makes too large over several files.
    """
    column, hashed = fresh(docs, "shard"), fresh(docs, "_hash")
    rows = docs.withColumn(hashed, key_hash(F.col(key_col)))
    sizes = stored(rows.select(F.col(hashed).alias("h"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes")), "shard-sizes")
    shards = stored(shard_directory(sizes, limit).select("depth", "prefix"), "shard-directory")
    few = shards.count() <= MOST_BROADCAST_SHARDS
    names = []
    for (depth,) in shards.select("depth").distinct().orderBy("depth").collect():  # at most HASH_BITS + 1
        prefix, name = fresh(docs, f"_prefix{depth}"), fresh(docs, f"_name{depth}")
        own = shards.where(F.col("depth") == depth).select(F.col("prefix").alias(prefix), _name(F.col("prefix"), F.lit(depth)).alias(name))
        rows = rows.join(F.broadcast(own) if few else own, _prefix(F.col(hashed), F.lit(depth)) == F.col(prefix), "left")
        names.append(F.col(name))
    placed = rows.select(*docs.columns, F.concat(F.lit("s"), F.coalesce(*names, F.lit(""))).alias(column))
    placed.hint("rebalance", column).write.partitionBy(column).option("compression", "zstd").parquet(path)
    return column


def read_shards(spark: SparkSession, path: str, schema: T.StructType, column: str = "shard") -> DataFrame:
    """The rows that ``write_shards`` wrote, with their shard's folder; also if there are none."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(column, T.StringType())])).parquet(path)


def shard_report(rows: DataFrame, column: str = "shard", key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``assign_shards`` tells of every row, from the rows of the shards that were read back."""
    own = rows.select(
        F.col(key_col).alias("_key"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.substring(F.col(column), 2, HASH_BITS).alias("shard"))
    sums = own.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return own.join(sums, "shard").select(
        F.col("_key").alias(key_col), "n_bytes", "shard", F.length("shard").alias("shard_depth"), "shard_bytes", "shard_rows")
