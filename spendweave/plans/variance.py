"""Variance report: every resource of every period pair with amounts, reason, confidence and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions import rules
from spendweave.functions.numbers import days_in_month, percent, places
from spendweave.operators.dealing import tasks_for
from spendweave.operators.events import change_event_match
from spendweave.operators.pairs import (
    SIDE_KEY,
    SIGNALS,
    consecutive_pairs,
    grouped_pairs,
    grouped_rolling,
    last_year_pairs,
    rolling_baseline,
    side,
    variance_pairs,
    with_events,
)
from spendweave.operators.silver import billing_periods, line_partials, resource_signals, resources
from spendweave.schemas import PAIR
from spendweave.session import stored

REPORT = [
    *PAIR, "resource_id", "resource_name", "service_name", "team", "cost_center", "prior_cost", "current_cost",
    "delta_dollars", "delta_pct", "reason_code", "confidence_score", "evidence", "pr_number", "pr_author",
    "iac_source", "in_terraform_state", "reviewed", "excluded",
]

BASELINES = ("prior_month", "rolling_3m", "same_month_last_year")


def variance_amounts(paired: DataFrame) -> DataFrame:
    """Costs, raw change and change per equal month length of full-outer pairs (structs ``p`` and ``c``).

    Comparing at equal length multiplies out the day counts, so a boundary such as exactly five
    percent is not lost to rounding.
    """
    prior = F.coalesce(F.col("p.total_cost"), F.lit(0)).cast("decimal(22,6)")
    current = F.coalesce(F.col("c.total_cost"), F.lit(0)).cast("decimal(18,2)")
    sums = paired.select(
        "*", prior.alias("prior_raw"), current.alias("current_cost"),
        days_in_month(F.col(PAIR[0])).alias("prior_days"), days_in_month(F.col(PAIR[1])).alias("current_days"),
    )
    raw = F.col("current_cost") - F.col("prior_raw")
    base = F.col("prior_raw") * F.col("current_days")
    change = F.col("current_cost") * F.col("prior_days") - base
    return sums.withColumn("delta_raw", raw).withColumn("pct_raw", percent(F.col("delta_raw"), F.col("prior_raw"))).withColumn(
        "norm_pct", F.when(F.col("prior_raw") > 0, percent(change, base)).otherwise(F.col("pct_raw"))
    )


def _ref(name: str) -> Column:
    """Attribute of the current row where there is one, else of the prior row."""
    return F.when(F.col("c").isNotNull(), F.col(f"c.{name}")).otherwise(F.col(f"p.{name}"))


def classify_pairs(paired: DataFrame) -> DataFrame:
    """Adds reason, confidence and evidence inputs to full-outer pairs whose sides carry their context."""
    joined = variance_amounts(paired).select(
        "*", "c.charge_types", "c.description", "c.other_tool", F.coalesce("c.event", "p.event").alias("event")
    )
    staged = joined.select(
        "*",
        F.coalesce(_ref("in_terraform_state"), F.lit(False)).alias("managed"),
        *[
            _ref(n).alias(n)
            for n in ("resource_name", "service_name", "team", "cost_center", "terraform_module")
        ],
        F.col("c").isNotNull().alias("in_current"),
        F.col("p").isNotNull().alias("in_prior"),
        rules.edge_reason(
            F.coalesce("charge_types", F.array().cast("array<string>")), F.col("description")
        ).alias("edge"),
    )
    staged = staged.withColumn(
        "iac_source",
        F.coalesce(
            rules.blank_to_null(_ref("iac_source")), F.when(F.col("managed"), "terraform").otherwise("none")
        ),
    ).withColumn("excluded", F.col("edge").isNotNull())
    has_team = rules.blank_to_null(F.col("team")).isNotNull()
    reason = rules.classify(
        in_prior=F.col("in_prior"), in_current=F.col("in_current"), managed=F.col("managed"),
        has_event=F.col("event").isNotNull(), has_team=has_team, other_tool=F.col("other_tool"),
        prior_cost=F.col("prior_raw"), current_cost=F.col("current_cost"),
        abs_norm_pct=F.abs(F.coalesce("norm_pct", F.lit(0.0))), edge=F.col("edge"),
    )
    return staged.withColumn("reason_code", reason).withColumn(
        "confidence_score", rules.confidence(F.col("reason_code"), F.col("excluded"), F.col("managed"), has_team)
    )


def _rule_inputs() -> dict[str, Column]:
    return {
        "reason": F.col("reason_code"), "excluded": F.col("excluded"), "charge_types": F.col("charge_types"),
        "event": F.col("event"), "norm_pct": F.col("norm_pct"), "prior_days": F.col("prior_days"),
        "current_days": F.col("current_days"), "service": F.col("service_name"), "team": F.col("team"),
        "current_cost": F.col("current_cost"), "managed": F.col("managed"), "in_current": F.col("in_current"),
        "iac_source": F.col("iac_source"), "module": F.col("terraform_module"), "delta_pct": F.col("pct_raw"),
    }


def evidence_chain(classified: DataFrame) -> DataFrame:
    """Audit trail of every row as a struct: reason, ordered steps and the inputs they used."""
    return classified.select(
        *PAIR, "resource_id",
        F.struct(
            F.col("reason_code"),
            rules.evidence_steps(_rule_inputs()).alias("classification_steps"),
            F.struct(
                F.col("resource_id"),
                F.col("prior_raw").cast("double").alias("prior_cost"),
                F.col("current_cost").cast("double").alias("current_cost"),
                F.col("pct_raw").alias("delta_pct"),
                F.col("managed").alias("in_iac"),
                F.col("iac_source"),
                F.col("terraform_module").alias("iac_module"),
                F.coalesce("charge_types", F.array().cast("array<string>")).alias("charge_types"),
            ).alias("inputs"),
        ).alias("evidence_chain"),
    )


def report(classified: DataFrame) -> DataFrame:
    """The stored columns of the variance report."""
    return classified.select(
        *PAIR, "resource_id", "resource_name", "service_name", "team", "cost_center",
        places(F.col("prior_raw"), 2).cast("decimal(18,2)").alias("prior_cost"),
        "current_cost",
        places(F.col("delta_raw"), 2).cast("decimal(18,2)").alias("delta_dollars"),
        F.coalesce(places(F.col("pct_raw"), 2), F.lit(0)).cast("decimal(18,2)").alias("delta_pct"),
        "reason_code", "confidence_score",
        rules.evidence_text(_rule_inputs()).alias("evidence"),
        F.col("event.pr_number").alias("pr_number"), F.col("event.pr_author").alias("pr_author"),
        "iac_source", F.col("managed").alias("in_terraform_state"),
        F.lit(False).alias("reviewed"), "excluded",
    )


def paired_sides(
    silver: DataFrame,
    pairs: DataFrame,
    baseline: str = "prior_month",
    signals: DataFrame | None = None,
    events: DataFrame | None = None,
    by_resource: bool = False,
) -> DataFrame:
    """Full-outer pairs of the chosen baseline.

    ``signals`` (by resource and period; not needed if ``silver`` has their columns) and ``events`` (by resource and current
    period) join the sides before they meet, on the key the sides meet on, so the wide pairs are never shuffled. If ``silver``, which
    then has its signals, and ``events`` are dealt ``by_resource`` over the same tasks, sides are grouped where they lie instead.
    """
    if baseline not in BASELINES:
        raise ValueError(f"baseline must be one of {BASELINES}, not {baseline!r}")
    if baseline == "same_month_last_year":
        pairs = last_year_pairs(pairs)
    if by_resource and signals is None:
        paired = (grouped_rolling if baseline == "rolling_3m" else grouped_pairs)(silver, pairs)
        return paired if events is None else with_events(paired, events)
    current = side(silver, pairs, PAIR[1])
    silver = silver.drop(*SIGNALS)  # those of the prior month explain nothing
    prior = rolling_baseline(silver, pairs) if baseline == "rolling_3m" else side(silver, pairs, PAIR[0])
    if signals is not None:
        current = current.join(signals.withColumnRenamed("billing_period_start", PAIR[1]), SIDE_KEY, "left")
    if events is not None:
        current, prior = current.join(events, SIDE_KEY, "left"), prior.join(events, SIDE_KEY, "left")
    return variance_pairs(prior, current, pairs)


def classified_variance(
    lines: DataFrame, silver: DataFrame, events: DataFrame, pairs: DataFrame, baseline: str = "prior_month", tasks: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    signals = None if "charge_types" in silver.columns else resource_signals(lines)
    matched = change_event_match(events, tasks=tasks, ids=ids)
    return classify_pairs(paired_sides(silver, pairs, baseline, signals, matched, by_resource=tasks is not None))


def compute_variance(
    lines: DataFrame,
    silver: DataFrame,
    events: DataFrame,
    pairs: DataFrame | None = None,
    baseline: str = "prior_month",
    tasks: int | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Variance report of the given pairs, or of all consecutive months, in one job. ``lines`` may be their partials, and
    ``silver`` may have their signals. ``tasks`` is the number that ``silver`` is dealt or bucketed by resource over.
    ``ids`` are stored rows with all its ids, by which events of other ids are dropped early.
    """
    if pairs is None:
        pairs = consecutive_pairs(billing_periods(lines))
    return report(classified_variance(lines, silver, events, pairs, baseline, tasks, ids))


def run_pipeline(lines: DataFrame, iac_index: DataFrame, events: DataFrame) -> DataFrame:
    """Charge lines to variance report over all consecutive months.

    The lines are scanned once: costs, ids, signals and months come from their partials, which are written once.
    """
    partials = stored(line_partials(lines), "line-partials")
    tasks = tasks_for(lines.sparkSession, partials.count())
    return compute_variance(partials, resources(partials, iac_index, signals=True, tasks=tasks), events, tasks=tasks, ids=partials)
