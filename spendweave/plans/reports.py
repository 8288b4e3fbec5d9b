"""Reports over the silver and gold tables.

Each report covers every period (or period pair) of its input at once; filter the input to get one
month, and the filter reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendweave.functions import codes, rules
from spendweave.functions.numbers import percent, percent_or_zero, period_label, places, rounded
from spendweave.operators.ranking import ranked, top_per_group
from spendweave.schemas import PAIR
from spendweave.session import stored

PERIOD = "billing_period_start"
CURRENT = PAIR[1]


def _delta() -> Column:
    return F.col("delta_dollars")


def _abs_delta() -> Column:
    return F.abs(F.col("delta_dollars"))


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _named(column: str, default: str) -> Column:
    return F.coalesce(rules.blank_to_null(F.col(column)), F.lit(default))


def _sum_if(condition: Column, value: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).alias(name)


def _with_share(rows: DataFrame, group: list[str], value: str, name: str, digits: int = 1) -> DataFrame:
    """Adds the share of ``value`` in its group, from group totals joined back (never a global window)."""
    totals = rows.groupBy(*group).agg(F.sum(value).alias("_total"))
    return (
        rows.join(totals, group)
        .withColumn(name, rounded(percent_or_zero(F.col(value), F.col("_total")), digits))
        .drop("_total")
    )


# -- periods and filters ----------------------------------------------------------------------------


def period_filter(df: DataFrame, period, column: str = PERIOD) -> DataFrame:
    return df.where(F.col(column) == F.lit(period))


def tenant_scope(df: DataFrame, user_id: int) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def periods(lines: DataFrame) -> DataFrame:
    """Distinct billing months, newest first."""
    months = lines.select(PERIOD).where(F.col(PERIOD).isNotNull()).distinct()
    return months.orderBy(F.col(PERIOD).desc()).select(period_label(F.col(PERIOD)).alias("period"))


def detected_providers(lines: DataFrame) -> DataFrame:
    return lines.select("provider").where("provider <> ''").distinct()


def direction_filter(variance: DataFrame, direction: str = "both") -> DataFrame:
    if direction == "increases":
        return variance.where(_delta() > 0)
    if direction == "decreases":
        return variance.where(_delta() < 0)
    return variance


def resources_by_filter(
    variance: DataFrame,
    service: str | None = None,
    team: str | None = None,
    reason_code: str | None = None,
    min_cost: float | None = None,
    in_terraform: bool | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Rows that meet all given conditions, largest change first."""
    rows = variance
    if service:
        rows = rows.where(F.col("service_name").ilike(f"%{service}%"))
    if team:
        rows = rows.where(F.col("team") == team)
    if reason_code:
        rows = rows.where(F.col("reason_code") == reason_code)
    if min_cost is not None:
        rows = rows.where(F.col("current_cost") >= min_cost)
    if in_terraform is not None:
        rows = rows.where(F.col("in_terraform_state") == in_terraform)
    return top_variance(rows, limit)


def top_variance(variance: DataFrame, limit: int | None = 20, direction: str = "both") -> DataFrame:
    """Largest absolute changes. Spark keeps only ``limit`` rows per task."""
    rows = direction_filter(variance, direction)
    rows = rows.orderBy(_abs_delta().desc(), "resource_id", CURRENT)
    return rows if limit is None else rows.limit(limit)


def drift_rows(variance: DataFrame) -> DataFrame:
    return variance.where(rules.is_drift(F.col("reason_code")))


def redact_secrets(df: DataFrame, column: str) -> DataFrame:
    """Access keys and long base64-like runs replaced in a text column."""
    text = F.col(column)
    for pattern in codes.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, codes.REDACTED)
    return df.withColumn(column, text)


# -- variance rollups -------------------------------------------------------------------------------


def variance_by_service(variance: DataFrame) -> DataFrame:
    return variance.groupBy(*PAIR, F.coalesce("service_name", F.lit("Unknown")).alias("service")).agg(
        F.sum(_delta()).alias("delta"), F.sum(_abs_delta()).alias("abs_delta"), _count("resources"),
        F.sum("prior_cost").alias("prior_cost"), F.sum("current_cost").alias("current_cost"),
    )


def variance_by_reason(variance: DataFrame) -> DataFrame:
    return variance.groupBy(*PAIR, "reason_code").agg(
        F.sum(_delta()).alias("delta"), F.sum(_abs_delta()).alias("abs_delta"), _count("resources")
    )


def variance_totals(variance: DataFrame) -> DataFrame:
    return variance.groupBy(*PAIR).agg(
        _sum_if(_delta() > 0, _delta(), "total_increases"), _sum_if(_delta() < 0, _delta(), "total_decreases"),
        F.sum(_delta()).alias("net_change"), F.sum(_abs_delta()).alias("total_variance"),
    )


def variance_summary(variance: DataFrame) -> DataFrame:
    """Per reason: rows and change; per pair: total change and share of well-attributed rows."""
    sure = F.col("confidence_score") >= F.lit(codes.ATTRIBUTED_FROM).cast("decimal(3,2)")
    by_reason = variance.groupBy(*PAIR, "reason_code").agg(
        _count("rows"), F.sum(_delta()).alias("dollars"), F.count_if(sure).alias("_sure")
    )
    total = by_reason.groupBy(*PAIR).agg(
        F.sum("dollars").alias("total_delta"),
        rounded(F.sum("_sure").cast("double") * 100 / F.sum("rows")).alias("attribution_coverage_pct"),
    )
    return by_reason.drop("_sure").join(total, PAIR)


def root_causes(variance: DataFrame) -> DataFrame:
    """Four buckets of every pair, empty ones included."""
    bucket = rules.reason_bucket(F.coalesce("reason_code", F.lit("other")))
    hit = F.col("bucket") == F.col("_name")
    sums = variance.withColumn("bucket", bucket).groupBy(*PAIR, "bucket").agg(
        F.sum(_abs_delta()).alias("amount"), F.sum(_delta()).alias("delta"), _count("rows")
    )
    names = F.array(*[F.lit(b) for b in ("planned", "drift", "usage", "edge_cases")])
    return (
        sums.withColumn("_name", F.explode(names))
        .groupBy(*PAIR, F.col("_name").alias("bucket"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0)).alias("amount"),
            F.coalesce(F.sum(F.when(hit, F.col("delta"))), F.lit(0)).alias("delta"),
            F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("rows"),
        )
    )


def root_cause_summary(variance: DataFrame) -> DataFrame:
    """Planned, drift and usage; other codes are left out."""
    bucket = rules.reason_bucket(F.col("reason_code"), edge_bucket=False)
    return (
        variance.withColumn("bucket", bucket)
        .where("bucket is not null")
        .groupBy(*PAIR, "bucket")
        .agg(F.sum(_delta()).alias("delta"), _count("rows"))
    )


def top_per_reason(variance: DataFrame, n: int = 3) -> DataFrame:
    return top_per_group(
        variance.select(*PAIR, "reason_code", "resource_id", _name(), "service_name", "delta_dollars"),
        [*PAIR, "reason_code"], [_abs_delta().desc(), F.col("resource_id")], n,
    )


def top_per_bucket(variance: DataFrame, n: int = 5) -> DataFrame:
    bucket = rules.reason_bucket(F.coalesce("reason_code", F.lit("other")))
    return top_per_group(
        variance.select(*PAIR, bucket.alias("bucket"), "resource_id", _name(), "service_name", "delta_dollars"),
        [*PAIR, "bucket"], [_abs_delta().desc(), F.col("resource_id")], n,
    )


def top_per_drift_reason(variance: DataFrame, n: int = 5) -> DataFrame:
    return top_per_group(
        drift_rows(variance).select(*PAIR, "reason_code", "resource_id", _name(), "current_cost", "delta_dollars"),
        [*PAIR, "reason_code"], [_abs_delta().desc(), F.col("resource_id")], n,
    )


def _name() -> Column:
    return F.coalesce(rules.blank_to_null(F.col("resource_name")), F.col("resource_id")).alias("resource_name")


def close_packet(variance: DataFrame, invoices: DataFrame) -> DataFrame:
    """Month-end totals of every pair. Managed cost is the absolute change of managed rows."""
    managed = F.col("in_terraform_state")
    sums = variance.groupBy(*PAIR).agg(
        F.sum(_delta()).alias("net_variance"), F.sum(_abs_delta()).alias("total_variance"),
        _count("resource_count"), F.count_if(managed).alias("managed_count"),
        _sum_if(managed, _abs_delta(), "managed_cost"),
    )
    billed = invoices.groupBy(PERIOD).agg(F.sum("total_billed_cost").alias("billed"))
    prior = billed.select(F.col(PERIOD).alias(PAIR[0]), F.col("billed").alias("prior_cost"))
    current = billed.select(F.col(PERIOD).alias(CURRENT), F.col("billed").alias("total_cost"))
    zero = {"prior_cost": 0, "total_cost": 0}
    return (
        sums.join(F.broadcast(prior), PAIR[0], "left").join(F.broadcast(current), CURRENT, "left").na.fill(zero)
    )


def action_items(variance: DataFrame, n: int = 5) -> DataFrame:
    action = F.when(F.col("reason_code").isin(codes.IMPORT_CODES), "Import to Terraform").otherwise("Investigate drift")
    rows = drift_rows(variance).select(
        *PAIR, "resource_id", _name(), _named("service_name", "Unknown").alias("service"), "delta_dollars",
        "reason_code", action.alias("action"),
    )
    return top_per_group(rows, PAIR, [_abs_delta().desc(), F.col("resource_id")], n)


def gl_export(variance: DataFrame) -> DataFrame:
    """General-ledger journal lines."""
    text = lambda condition: (
        F.when(condition, _abs_delta()).otherwise(0).cast("decimal(18,2)").cast("string")
    )
    reason = F.coalesce("reason_code", F.lit(""))
    service = _named("service_name", "CLD")
    return variance.select(
        F.date_format(CURRENT, "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("6"), F.upper(F.substring(service, 1, 3)), F.lit("00")).alias("Account"),
        F.concat(_name(), F.lit(" — "), F.replace(reason, F.lit("_"), F.lit(" "))).alias("Description"),
        text(_delta() > 0).alias("Debit"), text(_delta() < 0).alias("Credit"),
        reason.alias("Reason"), F.coalesce("service_name", F.lit("")).alias("Service"),
    )


def engineering_view(variance: DataFrame) -> DataFrame:
    managed = F.coalesce("in_terraform_state", F.lit(False))
    cost = F.col("current_cost")
    planned, drift = F.col("reason_code") == "planned", rules.is_drift(F.col("reason_code"))
    return variance.groupBy(*PAIR).agg(
        F.count_if(managed).alias("managed_count"), F.count_if(~managed).alias("unmanaged_count"),
        _sum_if(managed, cost, "managed_cost"), _sum_if(~managed, cost, "unmanaged_cost"),
        F.sum(cost).alias("total_cost"),
        F.count_if(planned).alias("planned_count"), _sum_if(planned, _abs_delta(), "planned_total"),
        F.count_if(drift).alias("drift_count"), _sum_if(drift, _abs_delta(), "drift_total"),
        _count("total_resources"),
    )


def iac_sources(variance: DataFrame) -> DataFrame:
    sums = variance.groupBy(*PAIR, _named("iac_source", "none").alias("source")).agg(
        _count("resources"), F.sum("current_cost").alias("cost")
    )
    return _with_share(sums, PAIR, "resources", "share_pct")


def team_rollup(variance: DataFrame) -> DataFrame:
    return variance.groupBy(*PAIR, _named("team", "Untagged").alias("team")).agg(
        _count("resources"), F.sum("current_cost").alias("cost"), F.sum(_delta()).alias("delta"),
        F.count_if(F.col("in_terraform_state")).alias("managed"),
    )


def drift_report(variance: DataFrame) -> DataFrame:
    """Drift totals. Rows outside drift and rows found in IaC are counted apart: new and edge rows differ."""
    drift, managed = rules.is_drift(F.col("reason_code")), F.col("in_terraform_state")
    cost = F.col("current_cost")
    return variance.groupBy(*PAIR).agg(
        _count("total_resources"), F.count_if(drift).alias("drift_count"), F.count_if(~drift).alias("non_drift_count"),
        F.count_if(managed).alias("in_iac_count"), _sum_if(drift, cost, "drift_cost"),
        _sum_if(managed, cost, "in_iac_cost"),
        rounded(F.count_if(~drift).cast("double") * 100 / F.count(F.lit(1)), 0).alias("coverage_pct"),
    )


def packet_reasons(variance: DataFrame) -> DataFrame:
    """Absolute change by reason with its share and packet text."""
    sums = variance.groupBy(*PAIR, "reason_code").agg(F.sum(_abs_delta()).alias("amount"), _count("rows"))
    text = F.coalesce(rules.lookup(codes.PACKET_REASON_TEXT, F.col("reason_code")), F.lit(""))
    return _with_share(sums, PAIR, "amount", "share_pct", 0).withColumn("description", text)


def packet_services(variance: DataFrame, n: int = 6) -> DataFrame:
    sums = variance.groupBy(*PAIR, "service_name").agg(F.sum(_abs_delta()).alias("amount"))
    return top_per_group(sums, PAIR, [F.col("amount").desc(), F.col("service_name")], n)


def packet_journal(variance: DataFrame) -> DataFrame:
    reason = F.col("reason_code")
    return variance.groupBy(*PAIR).agg(
        _sum_if(reason == "planned", _abs_delta(), "planned_total"),
        _sum_if(rules.is_drift(reason), _abs_delta(), "drift_total"),
        _sum_if(reason.isin(codes.USAGE_CODES), _abs_delta(), "usage_total"),
        F.count_if(rules.is_drift(reason)).alias("drift_count"),
    )


def recent_events(events: DataFrame, n: int = 5) -> DataFrame:
    """Latest change events; of equal dates the latest recorded."""
    title = F.coalesce(
        *[rules.blank_to_null(F.col(c)) for c in ("pr_title", "description", "event_type")], F.lit("")
    )
    return events.orderBy(F.col("event_date").desc_nulls_last(), F.col("event_seq").desc(), F.col("resource_id")).limit(
        n
    ).select("event_date", title.alias("title"), "pr_number", "pr_author", "resource_id")


# -- anomalies -----------------------------------------------------------------------------------------


def anomalies(variance: DataFrame, min_delta_pct: float = 50, min_delta_dollars: float = 500) -> DataFrame:
    """Large changes, large in percent too unless the resource is new or removed, with a severity."""
    pct = F.abs(F.coalesce("delta_pct", F.lit(0)))
    moved = F.col("reason_code").isin("new_resource", "removed_resource")
    size = _abs_delta()
    return variance.where((size > min_delta_dollars) & ((pct > min_delta_pct) | moved)).select(
        *PAIR, "resource_id", _name(), _named("service_name", "Unknown").alias("service"), "prior_cost",
        "current_cost", "delta_dollars", "delta_pct", _named("reason_code", "unknown").alias("reason_code"), "team",
        "evidence", (size.cast("double") * (F.lit(1.0) + pct.cast("double") / 100)).alias("severity"),
    )


def top_anomalies(variance: DataFrame, n: int = 20, **limits: float) -> DataFrame:
    """Most severe anomalies of each pair."""
    found = anomalies(variance, **limits)
    return top_per_group(found, PAIR, [F.col("severity").desc(), F.col("resource_id")], n)


def anomalies_all_periods(
    variance: DataFrame, min_delta_pct: float = 50, min_delta_dollars: float = 500, n: int = 20
) -> DataFrame:
    """Changes large in dollars and in percent, over all periods; new resources have no percentage."""
    rows = variance.where((F.abs("delta_pct") > min_delta_pct) & (_abs_delta() > min_delta_dollars))
    return rows.orderBy(_abs_delta().desc(), "resource_id", CURRENT).limit(n)


def anomaly_summary(found: DataFrame) -> DataFrame:
    """Count, impact, and the service and team with the largest impact (first by name on a tie)."""
    base = found.groupBy(*PAIR).agg(_count("anomalies"), F.sum(_abs_delta()).alias("total_impact"))

    def leader(label: Column, name: str) -> DataFrame:
        sums = found.groupBy(*PAIR, label.alias(name)).agg(F.sum(_abs_delta()).alias("_impact"))
        return top_per_group(sums, PAIR, [F.col("_impact").desc(), F.col(name)], 1).select(*PAIR, name)

    service = leader(F.col("service"), "top_service")
    team = leader(_named("team", "Untagged"), "top_team")
    return base.join(service, PAIR, "left").join(team, PAIR, "left")


# -- bills, ingestion and coverage --------------------------------------------------------------------


def bill_overview(invoices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Billed totals of both periods of each pair; an invoice is read once."""
    billed = invoices.groupBy(PERIOD).agg(F.sum("total_billed_cost").alias("billed"))
    prior = billed.select(F.col(PERIOD).alias(PAIR[0]), F.col("billed").alias("_p"))
    current = billed.select(F.col(PERIOD).alias(CURRENT), F.col("billed").alias("_c"))
    zero = F.lit(0)
    joined = pairs.join(F.broadcast(prior), PAIR[0], "left").join(F.broadcast(current), CURRENT, "left")
    sums = joined.select(*PAIR, F.coalesce("_p", zero).alias("prior_total"), F.coalesce("_c", zero).alias("current_total"))
    change = F.col("current_total") - F.col("prior_total")
    return sums.withColumn("delta", change).withColumn(
        "change_pct", rounded(percent_or_zero(F.col("delta"), F.col("prior_total")), 1)
    )


def period_breakdown(lines: DataFrame) -> DataFrame:
    """Lines, cost and distinct resources per period.

    The exact distinct count first groups by (period, resource), so no task holds a period's ids.
    """
    per_resource = lines.groupBy(PERIOD, "resource_id").agg(_count("rows"), F.sum("billed_cost").alias("cost"))
    return per_resource.groupBy(PERIOD).agg(
        F.sum("rows").alias("rows"), F.sum("cost").alias("cost"), F.count("resource_id").alias("unique_resources")
    )


def ingestion_kpis(resources: DataFrame) -> DataFrame:
    """IaC match and tag coverage of the resources of each period."""
    managed, tagged = F.col("in_terraform_state"), rules.blank_to_null(F.col("team")).isNotNull()
    cost = F.col("total_cost")
    sums = resources.groupBy(PERIOD).agg(
        _count("resource_count"), F.count_if(managed).alias("matched_count"),
        F.count_if(~managed).alias("unmatched_count"), _sum_if(managed, cost, "matched_cost"),
        _sum_if(~managed, cost, "unmatched_cost"), F.count_if(tagged).alias("tagged_count"),
        _sum_if(tagged, cost, "tagged_cost"), F.sum(cost).alias("total_cost"),
    )
    share = lambda part, whole: rounded(percent_or_zero(F.col(part), F.col(whole)))
    return sums.select(
        "*", share("matched_count", "resource_count").alias("matched_pct"),
        share("matched_cost", "total_cost").alias("matched_cost_pct"),
        share("tagged_count", "resource_count").alias("tagged_pct"),
        share("tagged_cost", "total_cost").alias("tagged_cost_pct"),
    )


def service_rows_with_iac(lines: DataFrame, resources: DataFrame) -> DataFrame:
    """Lines, cost and resources of each service, with its count of managed resources."""
    per_resource = lines.groupBy(PERIOD, "service_name", "resource_id").agg(
        _count("rows"), F.sum("billed_cost").alias("cost")
    )
    services = per_resource.groupBy(PERIOD, "service_name").agg(
        F.sum("rows").alias("rows"), F.sum("cost").alias("cost"), F.count("resource_id").alias("resources")
    )
    managed = resources.where("in_terraform_state and service_name is not null").groupBy(PERIOD, "service_name").agg(
        _count("terraform_matched")
    )
    return services.join(managed, [PERIOD, "service_name"], "left").select(
        PERIOD, F.coalesce("service_name", F.lit("Unknown")).alias("service"), "rows", "cost", "resources",
        F.coalesce("terraform_matched", F.lit(0)).alias("terraform_matched"),
    )


def top_unmatched(resources: DataFrame, n: int = 5) -> DataFrame:
    """Costliest resources of each period outside any IaC state."""
    rows = resources.where(~F.col("in_terraform_state")).select(
        PERIOD, "resource_id", "resource_name", "service_name", "total_cost"
    )
    return top_per_group(rows, [PERIOD], [F.col("total_cost").desc(), F.col("resource_id")], n)


def iac_coverage(resources: DataFrame) -> DataFrame:
    managed, cost = F.col("in_terraform_state"), F.col("total_cost")
    sums = resources.groupBy(PERIOD).agg(
        _count("total_resources"), F.count_if(managed).alias("managed_resources"),
        _sum_if(managed, cost, "managed_cost"), F.sum(cost).alias("total_cost"),
    )
    return sums.select(
        "*", rounded(percent_or_zero(F.col("managed_resources"), F.col("total_resources")), 1).alias("coverage_pct"),
        rounded(percent_or_zero(F.col("managed_cost"), F.col("total_cost")), 1).alias("cost_coverage_pct"),
    )


def available_periods(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Billing months with their billed total, all invoices of a month summed."""
    billed = invoices.groupBy(PERIOD).agg(F.sum("total_billed_cost").alias("billed"))
    months = lines.select(PERIOD).where(F.col(PERIOD).isNotNull()).distinct()
    return months.join(billed, PERIOD, "left").select(
        period_label(F.col(PERIOD)).alias("period"), F.coalesce("billed", F.lit(0)).alias("total_cost")
    )


# -- trends ---------------------------------------------------------------------------------------------


def trends_by_service(resources: DataFrame) -> DataFrame:
    return resources.groupBy(F.coalesce("service_name", F.lit("Unknown")).alias("service"), PERIOD).agg(
        F.sum("total_cost").alias("cost"), _count("resources")
    )


def trends_variances(variance: DataFrame) -> DataFrame:
    """Change by reason of every pair, with the pair's net and total change."""
    by_reason = variance_by_reason(variance).withColumn("reason_code", F.coalesce("reason_code", F.lit("other")))
    totals = by_reason.groupBy(*PAIR).agg(
        F.sum("delta").alias("net_change"), F.sum("abs_delta").alias("total_variance")
    )
    return by_reason.join(totals, PAIR)


def top_services(resources: DataFrame, n: int = 8) -> DataFrame:
    """Services by cost over all periods."""
    sums = resources.groupBy(F.coalesce("service_name", F.lit("Unknown")).alias("service")).agg(
        F.sum("total_cost").alias("cost")
    )
    return sums.orderBy(F.col("cost").desc(), "service").limit(n)


def service_period_matrix(resources: DataFrame, n: int = 5) -> DataFrame:
    """Cost per period of the top services, one column pair per rank; a missing month counts zero.

    Columns are ranks rather than service names, so the schema does not depend on the data.
    """
    best = top_per_group(top_services(resources, n).withColumn("_all", F.lit(1)), ["_all"],
                         [F.col("cost").desc(), F.col("service")], n)
    # At most n rows, so broadcasting them is bounded.
    ranks = F.broadcast(best.select("service", "rank"))
    cost = trends_by_service(resources).join(ranks, "service", "left")
    cells = [
        F.coalesce(F.sum(F.when(F.col("rank") == i, F.col("cost"))), F.lit(0)).alias(f"service_{i}")
        for i in range(1, n + 1)
    ]
    return cost.groupBy(PERIOD).agg(*cells)


def spend_by_service(resources: DataFrame) -> DataFrame:
    sums = resources.groupBy(PERIOD, F.coalesce("service_name", F.lit("Unknown")).alias("service")).agg(
        F.sum("total_cost").alias("cost"), _count("resources")
    )
    return _with_share(sums, [PERIOD], "cost", "share_pct")


def cost_trend_mom(resources: DataFrame, service: str | None = None) -> DataFrame:
    """Cost per month with its change against the month before; the window holds one row per month."""
    rows = resources if service is None else resources.where(F.col("service_name").ilike(f"%{service}%"))
    return with_mom(rows.groupBy(PERIOD).agg(F.sum("total_cost").alias("cost")))


def with_mom(monthly: DataFrame) -> DataFrame:
    """Change against the previous row of a frame with one row per month (bounded by the calendar)."""
    before = F.lag("cost").over(Window.partitionBy(F.lit(1)).orderBy(PERIOD))
    return monthly.withColumn("_before", before).select(
        PERIOD, "cost",
        F.when(F.col("_before") > 0, rounded(percent(F.col("cost") - F.col("_before"), F.col("_before")), 1)).alias(
            "mom_pct"
        ),
    )


# -- exploration ----------------------------------------------------------------------------------------


def cost_describe(lines: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of line costs per month.

    Exact quartiles need the order of a month's costs. Costs are counted by value first, so the
    percentile works on (value, count) pairs.
    """
    cost = F.col("billed_cost").cast("double")
    # Four aggregates read the counted values, so they are written once.
    values = stored(lines.where("billed_cost is not null").groupBy(PERIOD, cost.alias("v")).agg(_count("n")), "cost-values")
    n, v = F.col("n"), F.col("v")
    stats = values.groupBy(PERIOD).agg(
        F.sum("n").alias("lines"),
        (F.sum(v * n) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    spread = values.join(F.broadcast(stats.select(PERIOD, F.col("mean").alias("_m"))), PERIOD).groupBy(PERIOD).agg(
        F.sqrt(F.try_divide(F.sum(n * (v - F.col("_m")) * (v - F.col("_m"))), F.sum("n") - 1)).alias("std")
    )
    return stats.join(spread, PERIOD).join(exact_quantiles(values, PERIOD), PERIOD)


def exact_quantiles(values: DataFrame, group: str) -> DataFrame:
    """Quartiles with linear interpolation of weighted values (columns group, v, n), exact at any size.

    Positions come from range-partitioned running counts, so no task sorts a whole group.
    """
    # Imported here to keep the reports free of writes unless they need one.
    from spendweave.operators.ranking import running_count

    counted = running_count(values, group, "v", "n")
    totals = values.groupBy(group).agg(F.sum("n").alias("_total"))
    placed = counted.join(F.broadcast(totals), group)

    def at(q: float, up: bool) -> Column:
        position = (F.col("_total") - 1) * F.lit(q)
        index = F.ceil(position) if up else F.floor(position)
        # The row whose 0-based positions [_before, _before + n) hold the index.
        hit = (F.col("_before") <= index) & (index < F.col("_before") + F.col("n"))
        return F.max(F.when(hit, F.col("v")))

    def quantile(q: float, name: str) -> Column:
        position = (F.max("_total") - 1) * F.lit(q)
        low, high = at(q, False), at(q, True)
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return placed.groupBy(group).agg(quantile(0.25, "p25"), quantile(0.5, "p50"), quantile(0.75, "p75"))


def team_spend(lines: DataFrame) -> DataFrame:
    return lines.groupBy(PERIOD, F.coalesce(F.col("tags")["team"], F.lit("Unattributed")).alias("team")).agg(
        F.sum("billed_cost").alias("cost")
    )


def drift_by_service(resources: DataFrame) -> DataFrame:
    """Unmanaged resources per service: count, total and mean cost. Resources without a service are left out."""
    return resources.where(~F.col("in_terraform_state") & F.col("service_name").isNotNull()).groupBy(PERIOD, "service_name").agg(
        _count("resources"), F.sum("total_cost").alias("total_cost"),
        (F.sum("total_cost").cast("double") / F.count("total_cost")).alias("avg_cost"),
    )


def _side(resources: DataFrame, pairs: DataFrame, role: str) -> DataFrame:
    """Rows of one side of every pair; pairs are months, so the broadcast is bounded."""
    return resources.join(F.broadcast(pairs), F.col(PERIOD) == F.col(role))


def service_compare(resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cost of each named service in both periods; a service absent before counts as 100 percent."""
    named = resources.where("service_name is not null")

    def total(role: str, name: str) -> DataFrame:
        return _side(named, pairs, role).groupBy(*PAIR, "service_name").agg(F.sum("total_cost").alias(name))

    joined = total(PAIR[0], "prior_cost").join(
        total(CURRENT, "current_cost"), [*PAIR, "service_name"], "full_outer"
    ).na.fill({"prior_cost": 0, "current_cost": 0})
    change = F.col("current_cost") - F.col("prior_cost")
    pct = F.when(F.col("prior_cost") > 0, rounded(percent(F.col("delta"), F.col("prior_cost")))).otherwise(F.lit(100.0))
    return joined.withColumn("delta", change).withColumn("pct_change", pct)


def months_stacked(resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals of named services in both periods stacked, with the month as a column."""
    named = resources.where("service_name is not null")

    def rows(role: str) -> DataFrame:
        sums = _side(named, pairs, role).groupBy(*PAIR, "service_name").agg(F.sum("total_cost").alias("cost"))
        return sums.withColumn("month", period_label(F.col(role)))

    return rows(PAIR[0]).unionByName(rows(CURRENT))


def id_sets(resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of shared, new and removed resources of each pair, from one grouping."""
    both = _side(resources, pairs, PAIR[0]).select(*PAIR, "resource_id", F.lit(1).alias("p"), F.lit(0).alias("c"))
    both = both.unionByName(
        _side(resources, pairs, CURRENT).select(*PAIR, "resource_id", F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    seen = both.groupBy(*PAIR, "resource_id").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return seen.groupBy(*PAIR).agg(
        F.sum(F.col("p") * F.col("c")).alias("shared"),
        F.sum((1 - F.col("p")) * F.col("c")).alias("new"),
        F.sum(F.col("p") * (1 - F.col("c"))).alias("removed"),
    )


def top_movers(resources: DataFrame, pairs: DataFrame, n: int = 10) -> DataFrame:
    """Largest changes between both periods over all resources of either."""
    def costs(role: str, name: str) -> DataFrame:
        rows = _side(resources, pairs, role)
        return rows.select(
            *PAIR, "resource_id", F.struct("resource_name", "service_name", F.col("total_cost").alias("cost")).alias(name)
        )

    joined = costs(PAIR[0], "p").join(costs(CURRENT, "c"), [*PAIR, "resource_id"], "full_outer")
    fallback = F.right("resource_id", F.lit(20))
    moved = joined.select(
        *PAIR, "resource_id",
        F.coalesce("c.resource_name", "p.resource_name", fallback).alias("resource_name"),
        F.coalesce("c.service_name", "p.service_name", F.lit("Unknown")).alias("service"),
        F.coalesce("p.cost", F.lit(0)).alias("prior_cost"), F.coalesce("c.cost", F.lit(0)).alias("current_cost"),
    ).withColumn("delta", F.col("current_cost") - F.col("prior_cost"))
    return top_per_group(moved, PAIR, [F.abs("delta").desc(), F.col("resource_id")], n)


def drift_growth(resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Unmanaged resources of the current period with prior cost, growth and risk score."""
    current = _side(resources.where(~F.col("in_terraform_state")), pairs, CURRENT).select(
        *PAIR, "resource_id", "resource_name", "service_name", _named("team", "Unknown").alias("team"),
        F.col("total_cost").alias("current_cost"),
    )
    prior = resources.select("resource_id", F.col(PERIOD).alias(PAIR[0]), F.col("total_cost").alias("prior_cost"))
    joined = current.join(prior, ["resource_id", PAIR[0]], "left").na.fill({"prior_cost": 0})
    change = F.col("current_cost") - F.col("prior_cost")
    pct = F.when(F.col("prior_cost") > 0, percent(F.col("delta"), F.col("prior_cost"))).otherwise(F.lit(100.0))
    return joined.withColumn("delta", change).withColumn("pct_change", pct).withColumn(
        "risk_score", rounded(rules.risk_score(F.col("current_cost"), F.col("pct_change")), 1)
    )


def import_priority(growth: DataFrame) -> DataFrame:
    """Unmanaged resources ranked by cost within each pair, with the command that would import them."""
    placed = ranked(growth, PAIR, {"current_cost": True, "resource_id": False}, "priority")
    kind = rules.lookup(codes.IMPORT_TYPES, F.col("service_name"))
    command = F.concat(
        F.lit("terraform import "), F.coalesce(kind, F.lit("nan")), F.lit("."), F.col("resource_name"), F.lit(" "),
        F.col("resource_id"),
    )
    return placed.withColumn("tf_type", kind).withColumn("import_cmd", command)
