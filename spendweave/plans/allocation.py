"""Attribution of charge lines to teams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.functions.numbers import places
from spendweave.functions.rules import allocation_confidence, allocation_method
from spendweave.schemas import RESOURCE_KEY


def allocate_lines(lines: DataFrame, resources: DataFrame) -> DataFrame:
    """One allocation per charge line, from its resource of the same period.

    Lines without a resource id stay out of the join, so they do not pile up on the NULL key. A hot
    resource sits on the streamed side, whose partitions adaptive execution splits.
    """
    owner = resources.select(
        *RESOURCE_KEY, F.lit(True).alias("_found"), "team", "cost_center", "in_terraform_state", "service_name"
    )
    own = lines.select("line_id", "invoice_id", *RESOURCE_KEY, "billed_cost")
    named = own.where("resource_id <> ''").join(owner, RESOURCE_KEY, "left")
    unnamed = own.where("resource_id is null or resource_id = ''")
    joined = named.unionByName(unnamed, allowMissingColumns=True)
    found = F.coalesce("_found", F.lit(False))
    managed = F.coalesce("in_terraform_state", F.lit(False))
    method = allocation_method(found, managed, F.col("team"), F.col("service_name"))
    owned = F.col("attribution_method").isin("terraform_state", "tag")
    return (
        joined.withColumn("attribution_method", method)
        .select(
            F.col("line_id").alias("billing_line_id"), "invoice_id", *RESOURCE_KEY,
            F.when(owned, F.col("team")).alias("team"),
            F.when(owned, F.col("cost_center")).alias("cost_center"),
            places(F.col("billed_cost"), 2).cast("decimal(18,2)").alias("allocated_cost"),
            "attribution_method",
            allocation_confidence(F.col("attribution_method")).alias("confidence_score"),
        )
    )


def allocation_summary(allocations: DataFrame) -> DataFrame:
    """Allocated cost, mean confidence and count per resource and period."""
    return allocations.groupBy(*RESOURCE_KEY).agg(
        F.sum("allocated_cost").alias("total_allocated_cost"),
        F.avg("confidence_score").alias("avg_allocation_confidence"),
        F.count(F.lit(1)).alias("allocation_count"),
    )


def allocation_coverage(allocations: DataFrame) -> DataFrame:
    """Share of the lines of each period that have a team."""
    counts = allocations.groupBy("billing_period_start").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count("team").alias("attributed_lines")
    )
    return counts.withColumn(
        "attribution_coverage_pct",
        places(F.col("attributed_lines").cast("double") * 100 / F.col("total_lines"), 2).cast("decimal(18,2)"),
    )


def with_coverage(invoices: DataFrame, allocations: DataFrame) -> DataFrame:
    """Invoices with the share of their period's lines that have a team; invoices of periods without allocations keep theirs."""
    share = allocation_coverage(allocations).select("billing_period_start", F.col("attribution_coverage_pct").alias("_share"))
    joined = invoices.join(share, "billing_period_start", "left")
    return joined.withColumn("attribution_coverage_pct", F.coalesce("_share", "attribution_coverage_pct")).select(*invoices.columns)
