"""Rows dealt by a key once, for all that is then grouped or joined on it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that a task may get unreduced; at most one key in so many rows has more.
HOT_ROWS = 1_000_000
# Rows that a task gets, so that it sorts them in memory whatever the size of the input.
TASK_ROWS = 100_000
# Keys are counted by hash first; only those of a slot with more than HOT_ROWS rows are counted one by one.
SLOTS = 1 << 16


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows are dealt to. The same number lets frames dealt by one key meet without another exchange."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def dealt(rows: DataFrame, key: str, reduced: Callable[[DataFrame], DataFrame], tasks: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows, hash-partitioned by ``key`` over ``tasks`` (as many as the rows ask for, if not given), so that groupings on at least the
    key and joins on just the key need no further exchange. With ``by`` they are dealt by these columns as Spark deals for a join on them.

    Rows of keys with more than ``HOT_ROWS`` go through ``reduced`` first, which merges rows that mean the same and keeps the columns;
    other rows would gain little from it and would be shuffled twice.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    slots = rows.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    crowded = F.array_compact(F.collect_list(F.when(F.col("_rows") > HOT_ROWS, F.col("_slot"))))  # at most one slot for HOT_ROWS rows
    count, crowded = slots.agg(F.coalesce(F.sum("_rows"), F.lit(0)), crowded).first()
    if crowded:
        hot = rows.where(slot.isin(crowded)).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT_ROWS).select(key)
        hot = F.broadcast(hot)  # at most one key for HOT_ROWS rows
        rows = rows.join(hot, key, "left_anti").select(rows.columns).unionByName(reduced(rows.join(hot, key, "left_semi")).select(rows.columns))
    return rows.repartition(*by) if by else rows.repartition(tasks or tasks_for(rows.sparkSession, count), key)
