"""Publishing behind the quality gate: tables are written aside, judged, and become visible together.

A release is a folder of its own with all its tables. The file ``_CURRENT`` names the visible release; replacing it by a
renamed file is the only step that readers notice. A failing check leaves the old release visible.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spendweave.plans.quality import QualityError, verdicts
from spendweave.sources.sinks import write_table

POINTER = "_CURRENT"


def publish(spark: SparkSession, tables: dict[str, tuple[DataFrame, str | None]], checks: DataFrame, root: str) -> DataFrame:
    """Publishes the tables (each with its period column, if it has one) unless a check fails; returns a verdict per check."""
    release = f"release-{uuid.uuid4().hex}"
    for name, (df, period) in tables.items():
        write_table(df, f"{root}/{release}/{name}", [period] if period else None)
    judged = verdicts(checks).collect()  # a row per check
    failed = [r for r in judged if r["verdict"] == "fail"]
    if failed:
        raise QualityError("; ".join(f"{r['check']}: {r['failed']} period(s)" for r in failed))
    _point(spark, root, release)
    return spark.createDataFrame(judged)


def _paths(spark: SparkSession, root: str, name: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/{name}")
    return hadoop, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, root: str, release: str) -> None:
    """Names the visible release. The rename replaces the old name at once, so readers see one or the other."""
    hadoop, new, files = _paths(spark, root, f"_{release}.tmp")
    out = files.create(new, True)
    out.write(bytearray(release.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, hadoop.Path(f"{root}/{POINTER}"), overwrite)


def visible(spark: SparkSession, root: str) -> str | None:
    """Folder of the visible release; None before the first one."""
    _, path, files = _paths(spark, root, POINTER)
    if not files.exists(path):
        return None
    reader = files.open(path)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
    finally:
        reader.close()
    return f"{root}/{name}"


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{visible(spark, root)}/{name}")
