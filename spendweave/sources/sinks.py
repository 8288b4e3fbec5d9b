"""Table sinks. Tables are parquet folders partitioned by tenant or period."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD, PAIR, TENANT = ["billing_period_start"], ["prior_period_start", "current_period_start"], ["user_id"]

# Rows of a task that writes all partitions it has rows of: few enough to be sorted in memory, many enough for files of some size.
WRITE_ROWS = 1_000_000
# What a file scan gives a task before tasks are put together to so many rows.
SCAN_BYTES = 16 << 20
_SCAN = "spark.sql.files.maxPartitionBytes"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a table, replacing only the partitions that occur in ``df``.

    The rebalance hint lets adaptive execution split a hot partition over several files and merge
    small ones. Writing the same rows again leaves the same table.
    """
    if partition_by:
        out = df.hint("rebalance", *partition_by)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Writes a table in as many buckets of a key, and returns it as the session's catalog knows it.

    Rows dealt by the key over ``buckets`` tasks are written where they lie. Readers that group by the key, or join with rows dealt
    alike, move nothing.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def table_exists(spark: SparkSession, path: str) -> bool:
    files, target = _folder(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that a job wrote aside and nothing reads any more."""
    files, target = _folder(spark, path)
    files.delete(target, True)


def _partition(keys: list[str], values: tuple[Any, ...]) -> str:
    """The folder of a partition. Keys are dates and numbers, whose text needs no escaping."""
    for value in values:
        if not isinstance(value, (date, int, type(None))):
            raise TypeError(f"partition value {value!r} is neither a date nor a number")
    return "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in zip(keys, values, strict=True))


@contextmanager
def _small_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, tasks that scan files get few bytes, so that a task's rows follow from how many tasks are put together."""
    before = spark.conf.get(_SCAN)
    spark.conf.set(_SCAN, str(SCAN_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_SCAN, before)


def replace_partitions(df: DataFrame, path: str, keys: list[str], scope: list[tuple[Any, ...]], in_place: bool = False) -> None:
    """Replaces the partitions of ``scope`` and all others that occur in ``df``. A partition of the scope without rows is emptied.

    Rows are moved once to lie by partition. With ``in_place`` each task writes its rows to a file for each partition instead, which
    moves nothing: for many rows of a stored table, which are counted first, and few partitions, such as months.

    Rows are written aside in one job, then each partition's folder is removed and the new one, if any, moved into its place.
    So nothing is lost if the job fails, and a call that is broken off later may be repeated. ``scope`` is a list of periods or
    tenants, bounded by their number.
    """
    spark = df.sparkSession
    files, root = _folder(spark, path)
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"  # readers skip names that begin with an underscore
    write = lambda rows: rows.write.partitionBy(*keys).option("compression", "zstd").parquet(staged)
    if in_place:
        with _small_scans(spark):
            write(df.coalesce(max(1, math.ceil(df.count() / WRITE_ROWS))))
    else:
        write(df.hint("rebalance", *keys))
    _, aside = _folder(spark, staged)
    new = _partitions(files, aside, "", len(keys))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in sorted({_partition(keys, values) for values in scope} | set(new)):
        target = hadoop(root, name)
        files.delete(target, True)
        if name in new:
            files.mkdirs(target.getParent())
            if not files.rename(hadoop(aside, name), target):
                raise OSError(f"{name} could not be moved to {path}")
    files.delete(aside, True)


def _partitions(files, root, below: str, depth: int) -> list[str]:
    """Names of the partition folders so many levels down."""
    if depth == 0:
        return [below]
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    out = []
    for name in names:
        child = root.suffix(f"/{name}")
        out += _partitions(files, child, f"{below}/{name}" if below else name, depth - 1)
    return out


def replace_period_pair(variance: DataFrame, path: str, pairs: list[tuple[date, date]] | None = None) -> None:
    """Replaces the rows of every (prior, current) pair in ``variance``, and of the pairs named, which may have none now."""
    replace_partitions(variance, path, PAIR, pairs or [])


def replace_periods(df: DataFrame, path: str, periods: list[date] | None = None) -> None:
    """Replaces the billing periods in ``df`` and those named. Silver rows are a pure function of bronze, so this is their upsert."""
    replace_partitions(df, path, PERIOD, [(p,) for p in periods or []])


def replace_tenants(df: DataFrame, path: str, tenants: list[int]) -> None:
    """Replaces all rows of the tenants by those of ``df`` (with ``user_id``), in one job."""
    replace_partitions(df.where(F.col("user_id").isin(tenants)), path, TENANT, [(t,) for t in tenants])


def replace_tenant(df: DataFrame, path: str, tenant: int) -> None:
    """Replaces all rows of one tenant."""
    replace_tenants(df.withColumn("user_id", F.lit(tenant).cast("int")), path, [tenant])


def replace_pr_events(events: DataFrame, path: str, periods: list[date]) -> None:
    """Replaces the pull-request events around the given billing periods; a period none falls near any more is emptied."""
    replace_partitions(events, path, PERIOD, [(p,) for p in periods])


def export_period_tables(tables: dict[str, tuple[DataFrame, str]], root: str, period=None, in_place: bool = False) -> None:
    """Exports tables below ``root``; each comes with its period column.

    With a period only that period is replaced, also by nothing. False, zero and empty text are kept as they are. ``in_place`` if the
    tables are stored; the rows of a single period are few and move all the same.
    """
    for name, (df, column) in tables.items():
        rows = df if period is None else df.where(F.col(column) == F.lit(period))
        replace_partitions(rows, f"{root}/{name}", [column], [] if period is None else [(period,)], in_place and period is None)


def write_gl_csv(journal: DataFrame, path: str, compression: str = "none") -> None:
    """The journal as CSV; with ``gzip`` each file is compressed whole, which readers of CSV tell by its name."""
    journal.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
