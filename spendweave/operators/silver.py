"""Silver tables from charge lines: invoices, resources and classification signals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.numbers import places
from spendweave.functions.rules import blank_to_null, environment, environment_tag, other_iac_tool
from spendweave.operators.dealing import dealt, tasks_for
from spendweave.operators.iac import iac_match
from spendweave.operators.pairs import SIGNALS
from spendweave.schemas import RESOURCE_KEY
from spendweave.session import stored
from spendweave.sources.sinks import replace_periods

ATTRIBUTES = ["resource_name", "service_name", "service_category", "region"]
OWNER = ["team", "cost_center", "env_tag"]
_TEXTS = [*ATTRIBUTES, *OWNER, "charge_type", "description", "other_tool", "tagged", "provider"]


def invoices(lines: DataFrame) -> DataFrame:
    """One row per invoice with totals and the share of cost that carries a team tag."""
    tagged = blank_to_null(F.col("tags")["team"]).isNotNull()
    sums = lines.groupBy("invoice_id").agg(
        F.min("billing_period_start").alias("billing_period_start"),
        F.max("billing_period_end").alias("billing_period_end"),
        F.sum("billed_cost").alias("_total"),
        F.count(F.lit(1)).alias("total_line_items"),
        F.sum(F.when(tagged, F.col("billed_cost"))).alias("_attributed"),
    ).where("billing_period_start is not null")
    total, attributed = F.coalesce("_total", F.lit(0)), F.coalesce("_attributed", F.lit(0))
    return sums.select(
        "invoice_id", "billing_period_start", "billing_period_end",
        places(total, 2).cast("decimal(18,2)").alias("total_billed_cost"),
        "total_line_items",
        places(attributed, 2).cast("decimal(18,2)").alias("attributed_cost"),
        places(total - attributed, 2).cast("decimal(18,2)").alias("unattributed_cost"),
        F.when(
            total > 0, places(attributed.cast("double") * 100 / total.cast("double"), 2)
        ).otherwise(0).cast("decimal(18,2)").alias("attribution_coverage_pct"),
        F.lit("provisional").alias("status"),
    )


def resource_tags(lines: DataFrame) -> DataFrame:
    """Last tags of each (resource, period) in line order."""
    seen = (
        lines.where("tags is not null and resource_id <> ''")
        .groupBy(*RESOURCE_KEY, "tags")
        .agg(F.max("line_seq").alias("_seq"))
    )
    last = F.struct("_seq", F.to_json("tags"))
    return seen.groupBy(*RESOURCE_KEY).agg(F.max_by("tags", last).alias("tags"))


def line_partials(lines: DataFrame) -> DataFrame:
    """The lines reduced to what resources, signals and periods need: one row per combination of their texts, with sums.

    Costs and lines add up, sequences are first and last ones, so partials of several loads may be reduced again. Lines without a
    resource are one row per period. All aggregate buffers are numbers, so Spark hashes and reduces before the shuffle.
    """
    return _merged(_unit_partials(lines))


def _unit_partials(lines: DataFrame) -> DataFrame:
    """A partial of each line."""
    tags, own = F.col("tags"), F.col("resource_id") != ""
    texts = [
        *[F.col(c) for c in ATTRIBUTES], tags["team"].alias("team"), tags["cost_center"].alias("cost_center"), environment_tag(tags).alias("env_tag"),
        blank_to_null(F.col("charge_type")).alias("charge_type"), blank_to_null(F.col("description")).alias("description"),
        F.when(F.size(tags) > 0, other_iac_tool(tags)).alias("other_tool"), tags.isNotNull().alias("tagged"),
        blank_to_null(F.col("provider")).alias("provider"),
    ]
    rows = lines.select("resource_id", "billing_period_start", *texts, "billed_cost", "line_seq")
    return rows.select(
        F.when(own, F.col("resource_id")).alias("resource_id"), "billing_period_start", *[F.when(own, F.col(c)).alias(c) for c in _TEXTS],
        F.col("billed_cost").alias("cost"), F.lit(1).cast("bigint").alias("lines"), F.col("line_seq").alias("first_seq"), F.col("line_seq").alias("last_seq"))


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*RESOURCE_KEY, *_TEXTS).agg(
        F.sum("cost").alias("cost"), F.sum("lines").alias("lines"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def update_partials(lines: DataFrame, path: str, periods: list[date]) -> None:
    """Replaces the partials of the given billing months in the table at ``path``; other months are neither read nor written."""
    replace_periods(line_partials(lines.where(F.col("billing_period_start").isin(periods))), path, periods)


def _by_resource(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """Partials of resources, dealt by resource, which every aggregate below and the match with state then share.

    Lines travel once: only those of hot resources are merged before. ``lines`` may be partials, which are merged already.
    """
    if "first_seq" in lines.columns:
        return lines.where("resource_id is not null").repartition(tasks or tasks_for(lines.sparkSession, lines.count()), "resource_id")
    return dealt(_unit_partials(lines).where("resource_id is not null"), "resource_id", _merged, tasks)


def resource_costs(lines: DataFrame) -> DataFrame:
    """Cost of each (resource, period), described by its costliest group of attributes.

    Owner and environment come from the last tags, the provider from the last line that names one. ``lines`` may be partials.
    """
    return _costs(_by_resource(lines))


def _costs(partials: DataFrame, signals: bool = False) -> DataFrame:
    """Costs of dealt partials, with the columns of :func:`resource_signals` if asked for: all from one pass."""
    first = _first_signals() if signals else []
    cells = [] if not signals else [
        F.array_compact(F.collect_list(F.when(F.col("charge_type").isNotNull(), F.struct("_seq", "charge_type")))).alias("_typed"), F.min("_d").alias("_d"), F.min("_t").alias("_t")]
    groups = [*RESOURCE_KEY, *ATTRIBUTES]
    by_attributes = partials.groupBy(*groups, *(["charge_type"] if signals else [])).agg(
        F.sum("cost").alias("_cost"), F.max(F.when(F.col("tagged"), F.struct("last_seq", *OWNER))).alias("_last"),
        F.max(F.when(F.col("provider").isNotNull(), F.struct("last_seq", "provider"))).alias("_provider"), *first,
    )
    if signals:
        by_attributes = by_attributes.groupBy(*groups).agg(F.sum("_cost").alias("_cost"), F.max("_last").alias("_last"), F.max("_provider").alias("_provider"), *cells)
    found = by_attributes.groupBy(*RESOURCE_KEY).agg(
        F.sum("_cost").alias("_total"),
        F.max_by(F.struct(*ATTRIBUTES), F.struct("_cost", *ATTRIBUTES)).alias("_a"),
        F.max("_last").alias("_last"),
        F.max("_provider").alias("_provider"),
        *([F.flatten(F.collect_list("_typed")).alias("_typed"), F.min("_d").alias("_d"), F.min("_t").alias("_t")] if signals else []),
    )
    # A charge type of several attribute groups counts where it is seen first.
    types = F.array_distinct(F.transform(F.array_sort("_typed"), lambda s: s["charge_type"])).alias("charge_types")
    return found.select(
        *RESOURCE_KEY, "_a.*", *[F.col(f"_last.{c}").alias(c) for c in OWNER], F.col("_provider.provider").alias("provider"),
        places(F.coalesce("_total", F.lit(0)), 2).cast("decimal(18,2)").alias("total_cost"),
        *([types, F.col("_d.description").alias("description"), F.col("_t.other_tool").alias("other_tool")] if signals else []),
    )


def _first_signals() -> list[Column]:
    return [
        F.min("first_seq").alias("_seq"),
        F.min(F.when(F.col("description").isNotNull(), F.struct("first_seq", "description"))).alias("_d"),
        F.min(F.when(F.col("other_tool").isNotNull(), F.struct("first_seq", "other_tool"))).alias("_t"),
    ]


def resources(
    lines: DataFrame, iac_index: DataFrame | None = None, iac_id: Column | None = None, signals: bool = False, tasks: int | None = None,
) -> DataFrame:
    """One row per resource and billing period, with owner, provider, IaC source and environment. ``lines`` may be partials.

    ``iac_id`` is the id by which state knows a resource, if not its own. With ``signals`` the columns of :func:`resource_signals`
    come along, from the same pass. Rows are dealt by resource, over ``tasks`` if given.
    """
    costs = _costs(_by_resource(lines, tasks), signals)
    if iac_index is None:
        found = costs.withColumn("terraform_module", F.lit(None).cast("string")).withColumn(
            "_source", F.lit(None).cast("string")
        )
    else:
        # The ids are read apart, which is one column of the lines, so the costs are joined where they are summed.
        ids = stored(lines.select("resource_id").where("resource_id <> ''").distinct(), "resource-ids")
        own = ids.select("resource_id", (F.col("resource_id") if iac_id is None else iac_id).alias("_iac_id"))
        match = iac_match(own.select(F.col("_iac_id").alias("resource_id")), iac_index)
        known = match.select(F.col("resource_id").alias("_iac_id"), F.col("module").alias("terraform_module"), F.col("iac_source").alias("_source"))
        found = costs.join(own.join(known, "_iac_id").drop("_iac_id"), "resource_id", "left")
    return found.select(
        *RESOURCE_KEY, *ATTRIBUTES,
        "team", "cost_center",
        F.col("_source").isNotNull().alias("in_terraform_state"),
        "terraform_module",
        F.coalesce("_source", F.lit("none")).alias("iac_source"),
        environment(F.col("resource_name"), F.col("env_tag"), F.col("terraform_module")).alias("environment"),
        "total_cost", "provider", *(SIGNALS if signals else []),
    )


def resource_signals(lines: DataFrame) -> DataFrame:
    """Charge types in first-seen order, first description, and whether the first tags name another IaC tool.

    Keyed by (resource, period). The collected list holds distinct charge types only, a billing
    vocabulary of a few dozen words. ``lines`` may be partials.
    """
    by_type = _by_resource(lines).groupBy(*RESOURCE_KEY, "charge_type").agg(*_first_signals())
    typed = F.when(F.col("charge_type").isNotNull(), F.struct("_seq", "charge_type"))
    return by_type.groupBy(*RESOURCE_KEY).agg(
        F.transform(F.array_sort(F.collect_list(typed)), lambda s: s["charge_type"]).alias("charge_types"),
        F.min("_d")["description"].alias("description"),
        F.min("_t")["other_tool"].alias("other_tool"),
    )


def billing_periods(lines: DataFrame) -> DataFrame:
    """Distinct billing months; a list bounded by the calendar."""
    return lines.select("billing_period_start").where("billing_period_start is not null").distinct()
