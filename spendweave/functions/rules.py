"""Business rules as column expressions; none needs Python at run time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendweave.functions import codes
from spendweave.functions.numbers import fixed_text


def lookup(table: dict[str, str], key: Column) -> Column:
    """Literal lookup table; NULL for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def has_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


# -- classification ---------------------------------------------------------------------------


def edge_reason(charge_types: Column, description: Column) -> Column:
    """Reason of a pricing edge case, or NULL.

    A listed charge type decides first, in the order the types were seen; then the words of the
    description, then a charge type that mentions spot, then data-transfer words.
    """
    listed = list(codes.CHARGE_TYPE_REASONS)
    by_type = lookup(
        codes.CHARGE_TYPE_REASONS,
        F.get(F.filter(charge_types, lambda t: t.isin(listed)), F.lit(0)),
    )
    words = F.lower(F.coalesce(description, F.lit("")))
    spot_type = F.coalesce(F.exists(charge_types, lambda t: F.contains(F.lower(t), F.lit("spot"))), F.lit(False))
    return (
        F.when(by_type.isNotNull(), by_type)
        .when(has_any(words, codes.MARKETPLACE_WORDS), "marketplace_subscription")
        .when(has_any(words, codes.SPOT_WORDS) | spot_type, "spot_price_volatility")
        .when(has_any(words, codes.TRANSFER_WORDS), "cross_service_transfer")
    )


def other_iac_tool(tags: Column) -> Column:
    """Whether the tags show an IaC tool whose state was not loaded."""
    hit = F.coalesce(F.map_contains_key(tags, F.lit(codes.STACK_TAG)), F.lit(False))
    for key in codes.IAC_TOOL_TAGS:
        hit = hit | F.coalesce(F.lower(tags[key]).isin(codes.IAC_TOOLS), F.lit(False))
    return hit


def classify(
    *,
    in_prior: Column,
    in_current: Column,
    managed: Column,
    has_event: Column,
    has_team: Column,
    other_tool: Column,
    prior_cost: Column,
    current_cost: Column,
    abs_norm_pct: Column,
    edge: Column,
) -> Column:
    """Reason code of one resource between two periods."""
    managed = F.coalesce(managed, F.lit(False))
    unmanaged = (
        F.when(other_tool, "non_terraform_iac")
        .when(has_team, "orphan_sdk_created")
        .when((prior_cost > 0) & (current_cost < codes.LEGACY_COST), "legacy_untracked")
        .otherwise("orphan_unknown")
    )
    return (
        F.when(edge.isNotNull(), edge)
        .when(~in_prior, "new_resource")
        .when(~in_current, "removed_resource")
        .when(managed & has_event, "planned")
        .when(~managed, unmanaged)
        .when(abs_norm_pct > codes.STEADY_PCT, "usage_growth")
        .when(abs_norm_pct <= codes.STEADY_PCT, "steady_state")
        .otherwise("price_change")
    )


def confidence(reason: Column, excluded: Column, managed: Column, has_team: Column) -> Column:
    rule = F.when(excluded, codes.CONFIDENCE_EDGE)
    for code, score in codes.CONFIDENCE_BY_CODE.items():
        rule = rule.when(reason == code, score)
    rule = rule.when(managed, codes.CONFIDENCE_MANAGED).when(has_team, codes.CONFIDENCE_TEAM)
    return rule.otherwise(codes.CONFIDENCE_NONE).cast("decimal(3,2)")


def reason_bucket(reason: Column, edge_bucket: bool = True) -> Column:
    """Planned, drift, usage or edge cases; an unknown code counts as drift."""
    rule = F.when(reason.isin(codes.PLANNED_CODES), "planned").when(reason.isin(codes.USAGE_CODES), "usage")
    if edge_bucket:
        rule = rule.when(reason.isin(codes.EDGE_CODES), "edge_cases").otherwise("drift")
    else:
        rule = rule.when(reason.isin(codes.DRIFT_CODES), "drift")
    return rule


def is_drift(reason: Column) -> Column:
    return F.coalesce(reason.isin(codes.DRIFT_CODES), F.lit(False))


# -- resources ----------------------------------------------------------------------------------


def environment_tag(tags: Column) -> Column:
    """First non-empty of the tags that may name the deployment stage."""
    return F.coalesce(*[blank_to_null(tags[key]) for key in codes.ENVIRONMENT_TAGS])


def environment(name: Column, tag: Column, module: Column) -> Column:
    """Deployment stage: the environment tag decides, then the module path, then the name."""
    rule = None
    for text in (tag, module, name):
        words = F.lower(F.coalesce(text, F.lit("")))
        for stage, hints in codes.ENVIRONMENT_WORDS.items():
            hit = has_any(words, hints)
            rule = F.when(hit, stage) if rule is None else rule.when(hit, stage)
    return rule.otherwise("other")


def azure_service(resource_id: Column) -> Column:
    """Service name from the part of an ARM id behind its last ``/providers/``."""
    path = F.split(F.regexp_extract(resource_id, r"(?is)^.*/providers/(.*)$", 1), "/")
    namespace, kind, child = F.get(path, F.lit(0)), F.get(path, F.lit(1)), F.get(path, F.lit(3))
    three = F.lower(F.concat_ws("/", namespace, kind, child))
    two = F.lower(F.concat_ws("/", namespace, kind))
    raw = F.replace(
        F.replace(kind, F.lit("virtualMachines"), F.lit("Virtual Machines")),
        F.lit("storageAccounts"),
        F.lit("Storage"),
    )
    known = F.coalesce(
        F.when(F.size(path) >= 4, lookup(codes.AZURE_SERVICES, three)),
        lookup(codes.AZURE_SERVICES, two),
        raw,
    )
    return F.when(F.contains(F.lower(resource_id), F.lit("/providers/")) & (F.size(path) >= 2), known)


def billed_service(service: Column, resource_id: Column) -> Column:
    """Given service name, replaced from the ARM id when it is empty or a raw provider type."""
    service = blank_to_null(service)
    raw_type = F.contains(F.lower(service), F.lit("microsoft."))
    return F.when(service.isNull() | raw_type, F.coalesce(azure_service(resource_id), service)).otherwise(service)


def management_status(managed: Column, team: Column) -> Column:
    return (
        F.when(managed, "managed")
        .when(blank_to_null(team).isNotNull(), "tagged_only")
        .otherwise("unmanaged")
    )


def allocation_method(found: Column, managed: Column, team: Column, service: Column) -> Column:
    has_team = blank_to_null(team).isNotNull()
    return (
        F.when(found & managed & has_team, "terraform_state")
        .when(found & has_team, "tag")
        .when(found & blank_to_null(service).isNotNull(), "service_default")
        .otherwise("unattributed")
    )


def allocation_confidence(method: Column) -> Column:
    return lookup(codes.ALLOCATION_CONFIDENCE, method).cast("decimal(3,2)")


def risk_score(cost: Column, pct: Column) -> Column:
    """0 to 100: cost weight up to 40, growth weight up to 30, and 30 for being unmanaged."""
    by_cost = F.least(F.greatest(cost.cast("double") / 100, F.lit(0.0)), F.lit(40.0))
    by_growth = F.least(F.abs(pct) / 5, F.lit(30.0))
    return F.least(F.greatest(by_cost + by_growth + 30, F.lit(0.0)), F.lit(100.0))


# -- evidence -----------------------------------------------------------------------------------


def _true_false(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def evidence_text(row: dict[str, Column]) -> Column:
    """Readable reasons in a fixed order, joined by ``"; "``; NULL when there are none.

    ``row`` names the columns: reason, excluded, charge_types, event, norm_pct, prior_days,
    current_days, service, team, current_cost, managed, in_current, iac_source, module.
    """
    reason, event = row["reason"], row["event"]
    norm = fixed_text(F.coalesce(row["norm_pct"], F.lit(0.0)), 1)
    pull_request = F.when(
        F.coalesce(event["pr_number"], F.lit("")) != "",
        F.concat(F.lit("PR #"), event["pr_number"], F.lit(": "), F.coalesce(event["pr_title"], F.lit("None"))),
    ).otherwise(F.coalesce(blank_to_null(event["description"]), F.lit("terraform apply")))
    team = F.when(
        blank_to_null(row["team"]).isNotNull(), F.concat(F.lit(" (team: "), row["team"], F.lit(")"))
    ).otherwise("")
    parts = [
        F.when(
            row["excluded"],
            F.concat(
                F.lit("Edge case: "), reason, F.lit(" (charge_types: "),
                F.array_join(F.coalesce(row["charge_types"], F.array().cast("array<string>")), ", "), F.lit(")"),
            ),
        ),
        F.when(reason == "planned", pull_request),
        F.when(
            reason == "steady_state",
            F.concat(
                F.lit("Day-adjusted delta is "), norm, F.lit("% (within normal range for "),
                row["prior_days"].cast("string"), F.lit("→"), row["current_days"].cast("string"),
                F.lit(" day month)"),
            ),
        ),
        F.when(
            reason == "usage_growth",
            F.concat(F.lit("Day-adjusted growth of "), norm, F.lit("% exceeds normal variation")),
        ),
        F.when(
            reason == "new_resource",
            F.concat(
                F.lit("New "), F.coalesce(row["service"], F.lit("None")), F.lit(" resource"), team,
                F.lit(" costing "), F.format_number(F.round(row["current_cost"], 0), 0), F.lit("/mo"),
            ),
        ),
        F.when(
            row["managed"],
            F.concat(
                F.lit("Managed by "), row["iac_source"], F.lit(" ("),
                F.coalesce(row["module"], F.lit("None")), F.lit(")"),
            ),
        ),
        F.when(
            ~row["managed"] & row["in_current"] & ~row["excluded"],
            F.lit("Not in any IaC state — possible drift"),
        ),
    ]
    return blank_to_null(F.concat_ws("; ", *parts))


def evidence_steps(row: dict[str, Column]) -> Column:
    """Ordered classification steps as an array of (step, result, detail)."""
    reason, managed, event, pct = row["reason"], row["managed"], row["event"], row["delta_pct"]

    def step(name: str, result: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("step"), result.alias("result"), detail.alias("detail"))

    def quoted(values: Column) -> Column:
        listed = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
        return F.concat(F.lit("["), F.coalesce(F.array_join(listed, ", "), F.lit("")), F.lit("]"))

    edge = step(
        "edge_case_detection", reason,
        F.concat(F.lit("Charge types "), quoted(row["charge_types"]), F.lit(" matched edge case pattern")),
    )
    presence = step(
        "period_presence", reason,
        F.when(reason == "new_resource", "Resource not found in prior period").otherwise(
            "Resource not found in current period"
        ),
    )
    lookup_step = step(
        "iac_lookup",
        F.when(managed, "managed").otherwise("unmanaged"),
        F.when(
            managed,
            F.concat(F.lit("Source: "), row["iac_source"], F.lit(", module: "), F.coalesce(row["module"], F.lit("None"))),
        ).otherwise("Not found in any IaC state"),
    )
    event_step = step(
        "change_event_match",
        F.when(event.isNotNull(), "matched").otherwise("no_match"),
        F.when(
            event.isNotNull(),
            F.concat(
                F.lit("PR #"), F.coalesce(event["pr_number"], F.lit("None")), F.lit(": "),
                F.coalesce(event["pr_title"], F.lit("None")),
            ),
        ).otherwise("No change events found within window"),
    )
    delta = F.when(pct.isNotNull(), F.concat(fixed_text(pct, 1), F.lit("%"))).otherwise("N/A (new baseline)")
    final_step = step(
        "classification", reason,
        F.concat(
            F.lit("Delta "), delta, F.lit(", IaC="), _true_false(managed), F.lit(", change_event="),
            F.when(event.isNotNull(), "yes").otherwise("no"),
        ),
    )
    return (
        F.when(row["excluded"], F.array(edge))
        .when(reason.isin("new_resource", "removed_resource"), F.array(presence))
        .otherwise(F.array(lookup_step, event_step, final_step))
    )
