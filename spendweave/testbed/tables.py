"""Spark frames of the mapped billing tables, and the stored tables later layers read.

Bronze lines, change events, silver resources and the gold variance report are written once per
session to the shared folder and read back, as a pipeline of stored tables would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.operators.dealing import tasks_for
from spendweave.operators.iac import SOURCE_ORDER, iac_union
from spendweave.operators.pairs import SIGNALS, consecutive_pairs
from spendweave.operators.silver import billing_periods, resources
from spendweave.plans.variance import compute_variance
from spendweave.session import new_dir, setting
from spendweave.sources.sinks import write_bucketed, write_table
from spendweave.testbed import mapping

_tables: dict[tuple[str, str, str], DataFrame] = {}
# Shuffled bytes of a join's side that a task may hold as a hash table; adaptive execution asks for no less than its advisory size.
HASHED_BYTES = str(64 << 20)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("lineitem", "part", "orders") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: given(spark, sf_dir, n) for n in names})


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, mapping.BILLING_LINES)


def mapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines with tags as a map; untagged lines have NULL tags."""
    flat = flat_lines(spark, sf_dir)
    pairs = [x for column, key in mapping.TAG_KEYS.items() for x in (F.lit(key), F.col(column))]
    tags = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return flat.withColumn("tags", F.when(F.size(tags) > 0, tags)).drop(*mapping.TAG_KEYS)


def billing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze charge lines."""
    return _stored(spark, sf_dir, "lines", mapped_lines)


def iac_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: _mapped(spark, sf_dir, mapping.iac_source(name, rank)) for rank, name in enumerate(SOURCE_ORDER)}


def iac_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iac_union(iac_sources(spark, sf_dir))


def mapped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, mapping.CHANGE_EVENTS)


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "events", mapped_events)


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged pull requests: pr_number, title, author, merged_at, commit_sha."""
    rows = _mapped(spark, sf_dir, mapping.PULL_REQUESTS).where("merged_at is not null")
    return rows.select(F.col("number").cast("string").alias("pr_number"), "title", "author", "merged_at", "commit_sha")


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all pull requests; positions only need the right order."""
    return _mapped(spark, sf_dir, mapping.PR_FILES).select(
        F.col("number").cast("string").alias("pr_number"), F.col("file_pos").alias("file_seq"), "filename", "status",
        "patch",
    )


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(billing_lines(spark, sf_dir), iac_index(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consecutive_pairs(billing_periods(billing_lines(spark, sf_dir)))


def variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance report of all consecutive months from stored resources and their signals."""
    silver = _resources_with_signals(spark, sf_dir)
    return compute_variance(
        billing_lines(spark, sf_dir), silver, change_events(spark, sf_dir), tasks=resource_tasks(spark, sf_dir), ids=silver)


def resource_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that resources are dealt over, and buckets that they are stored in."""
    return tasks_for(spark, billing_lines(spark, sf_dir).count())


def _stored(spark: SparkSession, sf_dir: str, name: str, build, bucket_by: str | None = None) -> DataFrame:
    """Table written on first use in a session, then read like any stored table.

    Rows are written by the tasks that make them. The reports read all periods, so moving every row once more to lie by
    period would gain them nothing.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        path = new_dir(spark, name)
        rows = build(spark, sf_dir)
        # Kept as a frame, so the files are listed once. Joins whose one side turns out small in every task do not sort the other.
        with setting(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASHED_BYTES):
            if bucket_by:
                _tables[key] = write_bucketed(rows, path, bucket_by, resource_tasks(spark, sf_dir))
            else:
                write_table(rows, path)
                _tables[key] = spark.read.parquet(path)
    return _tables[key]


def _resources_with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources and the signals of their lines, which one pass over the lines gives, in buckets of their ids."""
    build = lambda spark, sf_dir: resources(
        billing_lines(spark, sf_dir), iac_index(spark, sf_dir), signals=True, tasks=resource_tasks(spark, sf_dir))
    # Object-hash aggregates give up after few groups and sort anew at each level; sort aggregates share the order of the first.
    with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        return _stored(spark, sf_dir, "resources", build, "resource_id")


def gold_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources_with_signals(spark, sf_dir).drop(*SIGNALS)


def gold_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "variance", variance, "resource_id")
