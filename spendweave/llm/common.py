"""What several operators share: stored tables, hot keys, Bloom filters, connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.session import cut_lineage, new_dir

#: Keys with at least 1/HOT_SHARE of all rows are hot, so there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: ``bitmap_construct_agg`` makes bitmaps of so many bits (4 KB).
BLOCK_BITS = 32768
#: Most 4 KB blocks of a Bloom filter that is broadcast: 32 MB.
MAX_BLOCKS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later steps neither repeat nor lose them."""
    path = new_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per ``key`` of ``groups``, safe when a key holds a third of all rows.

    ``size`` counts a group's rows. Keys with ``total / HOT_SHARE`` rows or more are at most ``HOT_SHARE``
    and are broadcast; the others are joined by a shuffle in which no key is large. ``rows`` is read twice,
    so pass a stored table. Rows without a key get nulls.
    """
    least = max(1000, math.ceil(total / HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) >= least))
    names = [c for c in groups.columns if c != key]
    with_hot = rows.where(F.col(key).isNotNull()).join(hot, key)
    cold = rows.where(F.col(key).isNotNull()).join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) < least), key, "left")
    kinds = dict(groups.dtypes)
    keyless = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    out = [c for c in rows.columns] + names
    return with_hot.select(*out).unionByName(cold.select(*out)).unionByName(keyless.select(*out))


def block_count(rows: int, bits_per_row: int = 16, most: int = MAX_BLOCKS) -> int:
    """Blocks of a filter for so many rows: a power of two, at most ``most``."""
    return min(most, 1 << max(0, math.ceil(math.log2(max(1, rows) * bits_per_row / BLOCK_BITS))))


def _cells(hashed: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a 64-bit hash and its two bits there."""
    return F.pmod(hashed, F.lit(blocks)), [F.shiftright(hashed, by).bitwiseAND(F.lit(BLOCK_BITS - 1)) for by in (21, 42)]


def bloom_filter(hashes: DataFrame, column: str, blocks: int, least: int = 1) -> DataFrame:
    """A blocked Bloom filter with two bits a hash: (block, bitmap) rows of 4 KB, at most ``blocks`` of them.

    ``least=2`` keeps the bits that were set twice, so it finds hashes that may occur more than once. The bits are
    counted as 8-byte numbers, map-side first.
    """
    block, bits = _cells(F.col(column), blocks)
    cells = hashes.where(F.col(column).isNotNull()).select(F.explode(F.array(*[block * BLOCK_BITS + b for b in bits])).alias("cell"))
    cells = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return cells.groupBy(F.floor(F.col("cell") / BLOCK_BITS).alias("block")).agg(
        F.bitmap_construct_agg(F.pmod(F.col("cell"), F.lit(BLOCK_BITS))).alias("bitmap"))


def maybe_in(df: DataFrame, column: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Adds the boolean ``flag``: whether the filter may hold the hash in ``column`` (never a false no)."""
    block, bits = _cells(F.col(column), blocks)
    place, held = fresh(df, "_block"), fresh(df, "_bitmap")

    def bit_set(bit: Column) -> Column:
        byte = F.substring(F.col(held), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1

    probe = F.broadcast(bloom.select(F.col("block").alias(place), F.col("bitmap").alias(held)))
    found = df.withColumn(place, block).join(probe, place, "left")
    is_set = F.col(held).isNotNull() & bit_set(bits[0]) & bit_set(bits[1])
    return found.select(*df.columns, F.coalesce(is_set, F.lit(False)).alias(flag))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that is reachable.

    Large-star and small-star steps by turns (Kiveris et al. 2014). Each step reduces map-side before its
    shuffle; the edges stay distributed and are checkpointed, and only a count and a checksum reach the driver.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star, seen = cut_lineage(star), None
    while True:
        state = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
