"""Ranking: top rows of each group, and full ranks that never put a group into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.session import stored


# Rows of a slice, which one task ranks.
SLICE_ROWS = 100_000


def _slices(df: DataFrame, keys: list, partitions: int | None) -> DataFrame:
    """The rows range-partitioned on the keys, with the slice's number: as many slices as the rows ask for.

    The rows are written first, so that counting them and sampling the bounds do not compute them again, and the slices are
    written because a second run would sample other bounds.
    """
    rows = stored(df, "unranked")
    partitions = partitions or max(1, math.ceil(rows.count() / SLICE_ROWS))
    return stored(rows.repartitionByRange(partitions, *keys).withColumn("_slice", F.spark_partition_id()), "slices")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark limits each task to ``n`` rows before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, nth).where(F.col(rank) <= n)


def ranked(
    df: DataFrame,
    group: list[str],
    order: dict[str, bool],
    rank: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """1-based rank of every row in its group; ``order`` maps column to descending.

    Rows are range-partitioned on group and order, so a hot group spreads over many tasks. Each
    task ranks its own slice and the slice is shifted by the counts of the slices before it. The
    order must be total, or the rank of equal rows is arbitrary.
    """
    keys = [F.col(c).asc() for c in group]
    keys += [F.col(c).desc() if down else F.col(c).asc() for c, down in order.items()]
    sliced = _slices(df, keys, partitions)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice a group reaches: at most `partitions` rows per group.
    shifts = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    shifts = shifts.select([F.col(c).alias(f"_g_{c}") for c in group] + [F.col("_slice").alias("_g_slice"), "_shift"])
    match = F.col("_slice") == F.col("_g_slice")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    own = Window.partitionBy("_slice", *group).orderBy(*keys[len(group):])
    return (
        sliced.withColumn("_own", F.row_number().over(own))
        .join(shifts, match)
        .withColumn(rank, (F.col("_own") + F.col("_shift")).cast("bigint"))
        .drop("_own", "_shift", "_slice", "_g_slice", *[f"_g_{c}" for c in group])
    )


def running_count(values: DataFrame, group: str, value: str, weight: str, partitions: int | None = None) -> DataFrame:
    """Adds ``_before``: total weight of the smaller values of the group. Values must be distinct per group.

    Same slicing as :func:`ranked`: slices add up their own weights and are shifted by earlier slices.
    """
    sliced = _slices(values, [F.col(group), F.col(value)], partitions)
    earlier = Window.unboundedPreceding
    shifts = (
        sliced.groupBy(group, "_slice")
        .agg(F.sum(weight).alias("_rows"))
        .withColumn(
            "_shift",
            F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_slice").rowsBetween(earlier, -1)), F.lit(0)),
        )
        .drop("_rows")
    )
    own = Window.partitionBy("_slice", group).orderBy(value).rowsBetween(earlier, -1)
    return (
        sliced.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
        .join(shifts, [group, "_slice"])
        .withColumn("_before", F.col("_own") + F.col("_shift"))
        .drop("_own", "_shift", "_slice")
    )
