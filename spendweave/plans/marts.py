"""Staging, intermediate and mart models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions import codes, rules
from spendweave.functions.numbers import percent, percent_or_zero, places
from spendweave.operators.pairs import by_month
from spendweave.operators.ranking import ranked
from spendweave.plans.allocation import allocation_summary
from spendweave.schemas import PAIR, RESOURCE_KEY
from spendweave.sources.sinks import write_table

PERIOD = "billing_period_start"
CURRENT = PAIR[1]


def stg_billing_lines(lines: DataFrame) -> DataFrame:
    """Charge lines without credits. A line without a charge type is dropped too, as in SQL."""
    return lines.where(F.col("charge_type") != "Credit").select(
        "*", (F.col("charge_type") == "Credit").alias("is_credit"), (F.col("charge_type") == "Usage").alias("is_usage")
    )


def stg_resources(resources: DataFrame) -> DataFrame:
    """Resources with defaults; the management status looks at the team before its default."""
    status = rules.management_status(F.col("in_terraform_state"), F.col("team"))
    provider = F.col("provider") if "provider" in resources.columns else F.lit(None).cast("string")
    return resources.where("resource_id is not null").select(
        "resource_id", PERIOD,
        F.coalesce("resource_name", "resource_id").alias("resource_name"),
        "service_name",
        F.coalesce("service_category", F.lit("Uncategorized")).alias("service_category"),
        F.coalesce("region", F.lit("unknown")).alias("region"),
        F.coalesce(provider, F.lit("AWS")).alias("provider"),
        F.coalesce("team", F.lit("Unattributed")).alias("team"),
        F.coalesce("cost_center", F.lit("UNALLOCATED")).alias("cost_center"),
        "in_terraform_state", "terraform_module", "total_cost",
        status.alias("management_status"),
    )


def line_totals_by_invoice(staged: DataFrame) -> DataFrame:
    cost = F.col("billed_cost")
    return staged.groupBy("invoice_id", PERIOD).agg(
        F.sum(cost).alias("line_total"),
        F.count(F.lit(1)).alias("line_count"),
        F.sum(F.when(F.col("is_credit"), cost).otherwise(0)).alias("total_credits"),
        F.sum(F.when(F.col("is_usage"), cost).otherwise(0)).alias("total_usage"),
    )


def int_invoice_totals(staged: DataFrame, allocations: DataFrame, invoices: DataFrame | None = None) -> DataFrame:
    """Invoice totals with the cost attributed to a team.

    Allocations carry the invoice of their line, so attribution is summed before the join. The line total is reconciled with that
    of the invoice; without invoices there is nothing to differ from.
    """
    attributed = allocations.groupBy("invoice_id").agg(F.sum("allocated_cost").alias("attributed_cost"))
    joined = line_totals_by_invoice(staged).join(attributed, "invoice_id", "left")
    if invoices is None:
        joined = joined.withColumn("_billed", F.col("line_total"))
    else:
        joined = joined.join(invoices.select("invoice_id", F.col("total_billed_cost").alias("_billed")), "invoice_id", "left")
    total, share = F.col("line_total"), F.coalesce("attributed_cost", F.lit(0))
    apart = F.abs(total - F.coalesce("_billed", F.lit(0)))
    return joined.select(
        "invoice_id", PERIOD, total.alias("total_billed_cost"), F.col("line_count").alias("total_line_items"),
        "total_credits", "total_usage", share.alias("attributed_cost"),
        (total - share).alias("unattributed_cost"),
        F.coalesce(places(percent_or_zero(share, total), 2), F.lit(0)).alias("attribution_coverage_pct"),
        apart.alias("reconciliation_variance"),
        F.when(apart <= 0.01, "reconciled")
        .otherwise("variance_detected").alias("reconciliation_status"),
    )


def _months() -> Window:
    # One row per month: a resource's window is bounded by the calendar.
    return Window.partitionBy("resource_id").orderBy(PERIOD)


def prior_month_cost(staged: DataFrame) -> DataFrame:
    return staged.withColumn("prior_month_cost", F.lag("total_cost").over(_months()))


def next_month_cost(staged: DataFrame) -> DataFrame:
    return staged.withColumn("next_month_cost", F.lead("total_cost").over(_months()))


def rolling_3m_avg(staged: DataFrame) -> DataFrame:
    return staged.withColumn("rolling_3m_avg_cost", F.avg("total_cost").over(_months().rowsBetween(-2, 0)))


def mom_delta(spend: DataFrame) -> DataFrame:
    """Change against the previous observed month; expects ``prior_month_cost``."""
    prior = F.col("prior_month_cost")
    change = F.col("total_cost") - prior
    return spend.select(
        "*",
        (F.col("total_cost") - F.coalesce(prior, F.lit(0))).alias("mom_delta_dollars"),
        F.when(prior > 0, places(percent(change, prior), 2)).alias("mom_delta_pct"),
        F.trunc(PERIOD, "MM").alias("billing_month"),
    )


def cost_rank_in_service(staged: DataFrame) -> DataFrame:
    """Rank by cost within service and month, without gathering a service in one task."""
    return ranked(staged, ["service_name", PERIOD], {"total_cost": True, "resource_id": False}, "cost_rank_in_service")


def int_monthly_resource_spend(staged: DataFrame) -> DataFrame:
    """Monthly spend of every resource with its neighbours in time and its rank in the service."""
    return mom_delta(rolling_3m_avg(next_month_cost(prior_month_cost(cost_rank_in_service(staged)))))


def latest_resource(staged: DataFrame) -> DataFrame:
    """Newest row of each resource."""
    rest = [c for c in staged.columns if c not in ("resource_id", PERIOD)]
    return staged.groupBy("resource_id").agg(F.max_by(F.struct(PERIOD, *rest), F.col(PERIOD)).alias("_r")).select(
        "resource_id", "_r.*"
    )


def drift_summary_lifetime(staged: DataFrame) -> DataFrame:
    cost = F.col("total_cost")
    return staged.groupBy("resource_id").agg(
        F.sum(F.when(~F.col("in_terraform_state"), cost).otherwise(0)).alias("total_drift_spend"),
        F.sum(F.when(F.col("in_terraform_state"), cost).otherwise(0)).alias("total_managed_spend"),
        # (resource, period) is the key, so counting rows would do; the key is not assumed here.
        F.countDistinct(PERIOD).alias("periods_observed"),
    )


def dim_resources(staged: DataFrame) -> DataFrame:
    latest = latest_resource(staged).withColumnsRenamed(
        {"total_cost": "latest_period_cost", PERIOD: "latest_billing_period"}
    )
    return latest.join(drift_summary_lifetime(staged), "resource_id", "left")


def delta_bucket(pct: Column) -> Column:
    return F.when(F.abs(pct) > 20, "large").when(F.abs(pct) > 5, "medium").otherwise("small")


def reason_description(reason: Column) -> Column:
    return F.coalesce(rules.lookup(codes.REASON_TEXT, reason), F.lit("Unknown"))


def high_priority_drift(reason: Column, cost: Column) -> Column:
    """Drift above 1000. The whole set of drift codes counts, not the one code nothing emits."""
    return rules.is_drift(reason) & (cost > 1000)


def reason_code_totals(variance: DataFrame) -> DataFrame:
    """Change per period by the six dashboard codes, and in total."""
    delta = F.col("delta_dollars")

    def of(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, delta).otherwise(0)).alias(name)

    reason = F.col("reason_code")
    return variance.groupBy("current_period_start").agg(
        of(rules.is_drift(reason), "total_drift_delta"),
        of(reason == "planned", "total_planned_delta"),
        of(reason == "new_resource", "total_new_delta"),
        of(reason == "removed_resource", "total_removed_delta"),
        of(reason == "usage_growth", "total_usage_growth_delta"),
        of(reason == "price_change", "total_price_change_delta"),
        F.sum(delta).alias("period_total_delta"),
    )


def pct_of_total_variance(variance: DataFrame) -> DataFrame:
    """Share of each row in its period's net change; periods are summed first, not windowed."""
    totals = variance.groupBy("current_period_start").agg(F.sum("delta_dollars").alias("period_total_delta"))
    share = places(percent(F.col("delta_dollars"), F.col("period_total_delta")), 2)
    return variance.join(F.broadcast(totals), "current_period_start", "left").withColumn(
        "pct_of_total_variance", F.coalesce(share, F.lit(0))
    )


def variance_id() -> Column:
    """Stable row id of the natural key."""
    key = F.concat_ws("|", F.col("resource_id"), *[F.col(c).cast("string") for c in PAIR])
    return F.substring(F.sha2(key, 256), 1, 16)


def fct_variance_report(variance: DataFrame, resources: DataFrame, allocations: DataFrame, tasks: int | None = None) -> DataFrame:
    """Variance rows with resource attributes, allocation summary and their share of the period.

    ``tasks`` is the number of buckets of a resource id that ``variance`` and ``resources`` lie in, if they do; then just the summary is moved.
    """
    attributes, shares = ["service_category", "region", "terraform_module"], ["total_allocated_cost", "avg_allocation_confidence", "allocation_count"]
    summary = allocation_summary(allocations.where("resource_id <> ''"))
    summary = summary.repartition(tasks, "resource_id") if tasks else summary
    joined = pct_of_total_variance(variance)
    for rows, columns in ((resources, attributes), (summary, shares)):
        months = by_month(rows, PERIOD, F.struct(*columns), "_months")
        joined = joined.join(months, "resource_id", "left").withColumn("_row", F.col("_months")[F.col(CURRENT)]).drop("_months")
        joined = joined.withColumns({c: F.col(f"_row.{c}") for c in columns}).drop("_row")
    return joined.select(
        variance_id().alias("id"), "resource_id", "resource_name", "service_name", "team", "cost_center", *PAIR,
        "prior_cost", "current_cost", "delta_dollars", "delta_pct", "reason_code", "confidence_score", "evidence",
        "pr_number", "pr_author", "in_terraform_state", "reviewed",
        "service_category", "region", "terraform_module",
        F.coalesce("total_allocated_cost", F.lit(0)).alias("allocated_cost"),
        "avg_allocation_confidence", "allocation_count",
        delta_bucket(F.col("delta_pct")).alias("delta_bucket"),
        reason_description(F.col("reason_code")).alias("reason_description"),
        high_priority_drift(F.col("reason_code"), F.col("current_cost")).alias("high_priority_drift"),
        "period_total_delta", "pct_of_total_variance",
    )


def cost_reconciliation(
    a: DataFrame, b: DataFrame, key: str, cost_a: str, cost_b: str, tolerance: float = 0.01
) -> DataFrame:
    """Keys whose total cost differs between two tables by more than the tolerance."""
    left = a.groupBy(key).agg(F.sum(cost_a).alias("total_a"))
    right = b.groupBy(key).agg(F.sum(cost_b).alias("total_b"))
    zero = F.lit(0)
    return (
        left.join(right, key, "full_outer")
        .select(key, F.coalesce("total_a", zero).alias("total_a"), F.coalesce("total_b", zero).alias("total_b"))
        .withColumn("difference", F.abs(F.col("total_a") - F.col("total_b")))
        .where(F.col("difference") > tolerance)
    )


def invoice_line_mismatch(invoice_totals: DataFrame, staged: DataFrame, tolerance: float = 0.01) -> DataFrame:
    sums = staged.groupBy("invoice_id").agg(F.sum("billed_cost").alias("line_total"))
    return (
        invoice_totals.select("invoice_id", "total_billed_cost")
        .join(sums, "invoice_id")
        .withColumn("difference", F.abs(F.col("total_billed_cost") - F.col("line_total")))
        .where(F.col("difference") > tolerance)
    )


def tf_status_flips(staged: DataFrame, variance: DataFrame) -> DataFrame:
    """Managed flags that differ between two periods of a resource without a new or removed row.

    A resource's periods, which the calendar bounds, meet each other in one list; only resources seen with both flags are spread
    again. Rows dealt by resource are not moved.
    """
    flag = "in_terraform_state"
    months = staged.where("resource_id is not null").groupBy("resource_id").agg(
        F.collect_list(F.struct(F.col(PERIOD).alias("at"), F.col(flag).alias("tf"))).alias("_all"), F.min(flag).alias("lo"), F.max(flag).alias("hi")
    ).where("lo <> hi")
    explained = variance.where(F.col("reason_code").isin("new_resource", "removed_resource")).groupBy("resource_id").agg(
        F.collect_set(PAIR[1]).alias("_explained"))
    later = F.filter("_all", lambda m: (m["at"] > F.col("_one.at")) & (m["tf"] != F.col("_one.tf")) & ~F.array_contains("_explained", m["at"]))
    return (
        months.join(explained, "resource_id", "left")
        .withColumn("_explained", F.coalesce("_explained", F.array().cast("array<date>")))
        .withColumn("_one", F.explode("_all")).withColumn("_two", F.explode(later))
        .select(
            "resource_id", F.col("_two.at").alias("period_2"), F.col("_one.at").alias("period_1"), F.col("_one.tf").alias("tf_period_1"),
            F.col("_two.tf").alias("tf_period_2"),
        )
    )


def variance_missing_resources(staged: DataFrame, variance: DataFrame) -> DataFrame:
    """Resources after the first period without a variance row."""
    have = variance.select("resource_id", F.col(PAIR[1]).alias(PERIOD))
    first = staged.agg(F.min(PERIOD)).scalar()
    return (
        staged.select(*RESOURCE_KEY)
        .where(F.col(PERIOD) != first)
        .distinct()
        .join(have, RESOURCE_KEY, "left_anti")
    )


def no_negative_costs(staged: DataFrame) -> DataFrame:
    return staged.where("total_cost < 0").select(*RESOURCE_KEY, "total_cost")


def publish(
    lines: DataFrame, resources: DataFrame, variance: DataFrame, allocations: DataFrame, root: str
) -> dict[str, str]:
    """Materializes the models: staging as views, intermediate models and marts as tables below ``root``.

    Run it after the variance report, which the marts read. Returns the path of each table.
    """
    staged_lines, staged = stg_billing_lines(lines), stg_resources(resources)
    staged_lines.createOrReplaceTempView("stg_billing_lines")
    staged.createOrReplaceTempView("stg_resources")
    models = {
        "int_invoice_totals": (int_invoice_totals(staged_lines, allocations), PERIOD),
        "int_monthly_resource_spend": (int_monthly_resource_spend(staged), PERIOD),
        "dim_resources": (dim_resources(staged), None),
        "fct_variance_report": (fct_variance_report(variance, resources, allocations), CURRENT),
    }
    paths = {}
    for name, (model, period) in models.items():
        paths[name] = f"{root}/{name}"
        write_table(model, paths[name], [period] if period else None)
    return paths
