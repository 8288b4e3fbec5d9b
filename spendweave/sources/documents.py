"""Markdown documents: whole files, or records of container files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_docs(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Every file of the pattern below a folder: source (path below the folder), text, and whether it is blank."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.col("_metadata.file_path")
    folder = root.rstrip("/") + "/"
    return files.select(
        F.substring_index(path, folder, -1).alias("source"), F.col("value").alias("text"),
        (~F.col("value").rlike(r"(?U)\S")).alias("blank"),
    )


def scan_doc_records(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON-lines files (``source``, ``text``), many to a file: source, text, and whether it is blank.

    So the number of files to list does not grow with that of documents. A record without a name is called by its file
    and place: the byte where its file split starts and its number in there.
    """
    records = spark.read.schema("source string, text string").json(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    unnamed = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string"), place.cast("string"))
    text = F.coalesce("text", F.lit(""))
    return records.select(F.coalesce("source", unnamed).alias("source"), text.alias("text"), (~text.rlike(r"(?U)\S")).alias("blank"))
