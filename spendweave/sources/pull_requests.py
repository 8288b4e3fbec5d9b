"""Landed pull-request exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PR_EXPORT = (
    "number bigint, title string, merged_at string, merge_commit_sha string, user struct<login string>, "
    "files array<struct<filename string, status string, patch string>>"
)


def scan_pr_events(
    spark: SparkSession, path: str, since: date | None = None, until: date | None = None, multi_line: bool = False
) -> DataFrame:
    """Merged pull requests in a window that touch at least one ``.tf`` file, with those files."""
    rows = spark.read.schema(PR_EXPORT).option("multiLine", multi_line).json(path)
    merged = F.to_date(F.substring("merged_at", 1, 10))
    prs = rows.select(
        F.col("number").cast("string").alias("pr_number"), "title", F.col("user.login").alias("author"),
        merged.alias("merged_at"), F.coalesce("merge_commit_sha", F.lit("")).alias("commit_sha"),
        F.filter("files", lambda f: F.endswith(f["filename"], F.lit(".tf"))).alias("tf_files"),
    ).where("merged_at is not null")
    if since is not None:
        prs = prs.where(F.col("merged_at") >= F.lit(since))
    if until is not None:
        prs = prs.where(F.col("merged_at") <= F.lit(until))
    return prs.where(F.size("tf_files") > 0)


def pr_files(prs: DataFrame) -> DataFrame:
    """One row per file of a scanned pull request, in listing order."""
    return prs.select("pr_number", F.posexplode("tf_files").alias("file_seq", "f")).select(
        "pr_number", "file_seq", "f.filename", "f.status", "f.patch"
    )
