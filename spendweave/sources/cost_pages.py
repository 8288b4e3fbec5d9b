"""Landed pages of cost APIs flattened to charge lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.functions.rules import blank_to_null

AWS_PAGE = (
    "ResultsByTime array<struct<TimePeriod struct<Start string, End string>, "
    "Groups array<struct<Keys array<string>, Metrics struct<UnblendedCost struct<Amount string>>>>>>"
)
AZURE_PAGE = (
    "period_start string, period_end string, "
    "properties struct<columns array<struct<name string>>, rows array<array<string>>, nextLink string>"
)


def read_pages(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _last_part(text: Column) -> Column:
    part = F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1)).when(
        F.contains(text, F.lit(":")), F.substring_index(text, ":", -1)
    )
    return F.coalesce(blank_to_null(F.coalesce(part, text)), text)


def _cost(text: Column) -> Column:
    return text.try_cast("double")


def _money(cost: Column) -> Column:
    return cost.cast("decimal(18,6)")


def flatten_aws_cost_pages(pages: DataFrame, region: str = "us-east-1") -> DataFrame:
    """One line per service, resource and month with a non-zero cost."""
    groups = pages.select(F.explode("ResultsByTime").alias("t")).select(
        F.col("t.TimePeriod").alias("p"), F.explode("t.Groups").alias("g")
    )
    service = F.coalesce(F.get("g.Keys", F.lit(0)), F.lit(""))
    fallback = F.concat(F.replace(F.lower(service), F.lit(" "), F.lit("-")), F.lit("-aggregate"))
    rows = groups.select(
        F.col("p.Start").alias("start"), F.col("p.End").alias("end"), service.alias("service_name"),
        F.coalesce(blank_to_null(F.get("g.Keys", F.lit(1))), fallback).alias("resource_id"),
        _cost(F.col("g.Metrics.UnblendedCost.Amount")).alias("cost"),
    ).where("cost <> 0")
    return rows.select(
        F.concat(F.lit("AWS-"), F.substring("start", 1, 7)).alias("invoice_id"),
        F.to_date("start").alias("billing_period_start"), F.to_date("end").alias("billing_period_end"),
        "service_name", "resource_id", _last_part(F.col("resource_id")).alias("resource_name"),
        F.lit(region).alias("region"), F.lit("Usage").alias("charge_type"), _money(F.col("cost")).alias("billed_cost"),
    )


def flatten_azure_cost_pages(pages: DataFrame) -> DataFrame:
    """Header array and row arrays to lines. Rows whose cost is zero or unreadable are dropped.

    Pages after the first may repeat the header; a page without one is not readable on its own, so
    the landing job stores the header with every page.
    """
    rows = pages.select(
        "period_start", "period_end", F.col("properties.columns.name").alias("names"),
        F.explode("properties.rows").alias("cells"),
    )
    # A short row leaves its last columns NULL; cells beyond the header have no name.
    padded = F.transform("names", lambda _, i: F.get(F.col("cells"), i))
    named = rows.withColumn("r", F.map_from_arrays("names", padded))
    filled = lambda key: blank_to_null(F.col("r")[key])
    # A zero cost falls through to the pre-tax cost.
    first = filled("Cost")
    cost_text = F.when(first.isNull() | (_cost(first) == 0), filled("PreTaxCost")).otherwise(first)
    kind = F.coalesce(filled("ResourceType"), F.lit(""))
    dashed = F.coalesce(blank_to_null(F.replace(F.lower(kind), F.lit("/"), F.lit("-"))), F.lit("subscription"))
    fallback = F.concat(F.lit("azure-"), dashed, F.lit("-aggregate"))
    last = F.element_at(F.split(kind, "/"), -1)
    friendly = F.when(
        F.contains(kind, F.lit("/")), F.initcap(F.regexp_replace(last, "([a-z])([A-Z])", "$1 $2"))
    ).otherwise(kind)
    flat = named.select(
        "period_start", "period_end", F.coalesce(filled("ResourceId"), fallback).alias("resource_id"),
        friendly.alias("service_name"), _cost(cost_text).alias("cost"),
    ).where("cost <> 0")
    return flat.select(
        F.concat(F.lit("AZ-"), F.substring("period_start", 1, 7)).alias("invoice_id"),
        F.to_date("period_start").alias("billing_period_start"), F.to_date("period_end").alias("billing_period_end"),
        "service_name", "resource_id",
        F.when(F.contains("resource_id", F.lit("/")), F.substring_index("resource_id", "/", -1))
        .otherwise(F.col("resource_id")).alias("resource_name"),
        F.lit("Usage").alias("charge_type"), _money(F.col("cost")).alias("billed_cost"),
    )
