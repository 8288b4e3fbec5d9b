"""Data-quality checks as rows of check, status and detail, per billing period."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions import codes
from spendweave.functions.numbers import fixed_text
from spendweave.functions.rules import blank_to_null
from spendweave.schemas import LINE_KEY
from spendweave.session import cut_lineage
from spendweave.sources.sinks import write_table

PERIOD = "billing_period_start"


class QualityError(RuntimeError):
    """A check failed, so the pipeline must stop."""


def _dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value.cast("decimal(38,2)"), 2))


def _row(check: str, status: Column, detail: Column) -> list[Column]:
    return [F.col(PERIOD), F.lit(check).alias("check"), status.alias("status"), detail.alias("detail")]


def _invoice_totals(invoices: DataFrame) -> DataFrame:
    """All invoices of a period summed; one row per month."""
    return invoices.groupBy(PERIOD).agg(
        F.sum("total_billed_cost").alias("invoice_total"),
        F.sum("attributed_cost").alias("attributed"),
    )


def dq_reconciliation(lines: DataFrame, invoices: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Lines against every invoice of a period; the period passes when each invoice is within the tolerance."""
    invoice = F.coalesce("invoice_id", F.lit("")).alias("invoice_id")
    sums = lines.groupBy(PERIOD, invoice).agg(F.coalesce(F.sum("billed_cost"), F.lit(0)).alias("line_sum"))
    billed = invoices.select(PERIOD, invoice, F.col("total_billed_cost").alias("billed"))
    each = sums.join(billed, [PERIOD, "invoice_id"], "left")
    month = each.groupBy(PERIOD).agg(
        F.sum("line_sum").alias("line_sum"), F.sum("billed").alias("invoice_total"),
        F.max(F.abs(F.col("line_sum") - F.coalesce("billed", F.lit(0)))).alias("diff"),
    )
    total, diff = F.col("invoice_total"), F.col("diff")
    status = F.when(total.isNull(), "warn").when(diff < tolerance, "pass").otherwise("fail")
    detail = F.when(total.isNull(), "No invoice found for this period").otherwise(
        F.concat(
            F.lit("Line sum: "), _dollars(F.round("line_sum", 2)), F.lit(", Invoice: "), _dollars(total),
            F.lit(", Diff: $"), fixed_text(diff, 2),
        )
    )
    return month.select(_row(codes.CHECK_RECONCILIATION, status, detail))


def dq_duplicates(lines: DataFrame) -> DataFrame:
    groups = lines.groupBy(PERIOD, *LINE_KEY).agg(F.count(F.lit(1)).alias("n"))
    counts = groups.groupBy(PERIOD).agg(F.count_if(F.col("n") > 1).alias("n"))
    n = F.col("n")
    status = F.when(n == 0, "pass").otherwise("warn")
    detail = F.when(n == 0, "No duplicates").otherwise(
        F.concat(n.cast("string"), F.lit(" duplicate groups found"))
    )
    return counts.select(_row(codes.CHECK_DUPLICATES, status, detail))


def dq_missing_ids(lines: DataFrame) -> DataFrame:
    missing = blank_to_null(F.col("resource_id")).isNull()
    counts = lines.groupBy(PERIOD).agg(F.count_if(missing).alias("bad"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("bad") == 0, "pass").otherwise("warn")
    detail = F.concat(
        F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" lines missing resource_id")
    )
    return counts.select(_row(codes.CHECK_MISSING_IDS, status, detail))


def dq_negative(lines: DataFrame) -> DataFrame:
    """Lines without a charge type are not counted, as in SQL."""
    kind = F.col("charge_type")
    bad = (F.col("billed_cost") < 0) & (kind != "Credit") & (kind != "Refund")
    counts = lines.groupBy(PERIOD).agg(F.count_if(bad).alias("bad"))
    status = F.when(F.col("bad") == 0, "pass").otherwise("warn")
    detail = F.concat(F.col("bad").cast("string"), F.lit(" non-credit negative cost lines"))
    return counts.select(_row(codes.CHECK_NEGATIVE, status, detail))


def dq_coverage(lines: DataFrame, invoices: DataFrame, minimum: float = 80) -> DataFrame:
    months = lines.select(PERIOD).where(F.col(PERIOD).isNotNull()).distinct()
    joined = months.join(F.broadcast(_invoice_totals(invoices)), PERIOD, "left")
    total = F.col("invoice_total")
    pct = F.when(total > 0, F.col("attributed").cast("double") * 100 / total.cast("double")).otherwise(F.lit(0.0))
    status = F.when(total.isNull(), "warn").when(pct >= minimum, "pass").otherwise("fail")
    detail = F.when(total.isNull(), "No invoice data to check attribution").otherwise(
        F.concat(F.lit("Attribution coverage: "), fixed_text(pct, 1), F.lit("%"))
    )
    return joined.select(_row(codes.CHECK_COVERAGE, status, detail))


def run_quality_checks(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """All five checks of every period."""
    checks = [
        dq_reconciliation(lines, invoices), dq_duplicates(lines), dq_missing_ids(lines), dq_negative(lines),
        dq_coverage(lines, invoices),
    ]
    out = checks[0]
    for rows in checks[1:]:
        out = out.unionByName(rows)
    return out


def dq_line_counters(lines: DataFrame) -> DataFrame:
    cost = F.col("billed_cost")
    return lines.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank_to_null(F.col("resource_id")).isNull()).alias("missing_resource_id"),
        F.count_if(blank_to_null(F.col("service_name")).isNull()).alias("missing_service"),
        F.count_if((cost == 0) | cost.isNull()).alias("zero_cost_lines"),
        F.count_if(cost < 0).alias("negative_cost_lines"),
    )


@dataclass(frozen=True)
class Expectations:
    """Column tests of one table."""

    not_null: list[str] = field(default_factory=list)
    unique: list[str] = field(default_factory=list)
    accepted: dict[str, list[str]] = field(default_factory=dict)


def dq_generic(tables: dict[str, tuple[DataFrame, Expectations]]) -> DataFrame:
    """Failing rows of every declared column test: table, check, column, failures.

    All not_null and accepted_values tests of a table share one aggregate; a unique test groups by
    its column.
    """
    parts: list[DataFrame] = []
    for table, (df, want) in tables.items():
        tests: list[tuple[str, str, Callable[[], Column]]] = []
        for column in want.not_null:
            tests.append(("not_null", column, F.count_if(F.col(column).isNull())))
        for column, values in want.accepted.items():
            tests.append(("accepted_values", column, F.count_if(~F.col(column).isin(values))))
        if tests:
            one = df.agg(*[expr.alias(f"t{i}") for i, (_, _, expr) in enumerate(tests)])
            cells = F.array(
                *[
                    F.struct(F.lit(kind).alias("check"), F.lit(column).alias("column"), F.col(f"t{i}").alias("failures"))
                    for i, (kind, column, _) in enumerate(tests)
                ]
            )
            parts.append(one.select(F.explode(cells).alias("r")).select(F.lit(table).alias("table"), "r.*"))
        for column in want.unique:
            repeated = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                repeated.agg(F.count_if(F.col("n") > 1).alias("failures")).select(
                    F.lit(table).alias("table"), F.lit("unique").alias("check"), F.lit(column).alias("column"), "failures"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verdicts(checks: DataFrame) -> DataFrame:
    """One row per check: the worst status of its periods, how many there are and how many failed or warned."""
    failed, warned = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    return checks.groupBy("check").agg(
        F.when(failed > 0, "fail").when(warned > 0, "warn").otherwise("pass").alias("verdict"),
        F.count(F.lit(1)).alias("periods"), failed.alias("failed"), warned.alias("warned"),
    )


def dq_gate(checks: DataFrame, log_path: str | None = None) -> DataFrame:
    """Writes the checks to the quality log, then raises when any of them failed; warnings pass.

    Only the checks given count; the log may hold failures of other months.
    """
    if log_path is not None:
        checks = cut_lineage(checks)
        write_table(checks, log_path, [PERIOD])
    # One row per kind of check.
    rows = verdicts(checks).where("verdict = 'fail'").orderBy("check").collect()
    if rows:
        raise QualityError("; ".join(f"{r['check']}: {r['failed']} period(s)" for r in rows))
    return checks
