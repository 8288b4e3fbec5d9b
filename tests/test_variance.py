"""Variance report end to end on seeded resources."""

from datetime import date
from decimal import Decimal

from helpers import FEB, JAN, MAR, as_dict, events, line, lines, managed, resource, resources
from pyspark.sql import functions as F

from spendweave.functions import codes
from spendweave.operators import iac
from spendweave.operators.pairs import one_pair
from spendweave.operators.silver import line_partials, resource_signals
from spendweave.operators.events import change_event_match
from spendweave.plans import marts, reports
from spendweave.plans.variance import (
    classified_variance,
    compute_variance,
    evidence_chain,
    paired_sides,
    run_pipeline,
)
from spendweave.testbed import tables

MONTH = {JAN: 31, FEB: 28}


def seeded(spark):
    """One resource per branch of the classifier."""
    rows = [
        managed("new", 500, team="core"), managed("gone", 500, JAN), managed("planned", 100, JAN), managed("planned", 300),
        managed("steady", Decimal("32.26") * 31, JAN), managed("steady", Decimal("32.26") * 28),
        managed("growth", 100, JAN), managed("growth", 200), resource("cdk", 900, JAN), resource("cdk", 950),
        resource("sdk", 900, JAN, team="data"), resource("sdk", 950, team="data"), resource("legacy", 90, JAN), resource("legacy", 95),
        resource("unknown", 900, JAN), resource("unknown", 950), managed("spot", 10, JAN), managed("spot", 90),
        managed("credit", 10, JAN), managed("credit", 0),
    ]
    bill = [
        line(1, "cdk", 950, tags={"managed_by": "CDK"}), line(2, "spot", 90, description="Spot hours"),
        line(3, "credit", 0, charge_type="Refund"), line(4, "steady", 1), line(5, "steady", 1, JAN),
        line(6, "gone", 500, JAN, charge_type="Credit"),
    ]
    change = events(spark, [
        {"resource_id": "x/planned", "event_date": date(2025, 2, 5), "pr_number": "99", "pr_title": "Resize", "pr_author": "me"},
        {"resource_id": "growth", "event_date": date(2025, 2, 20), "pr_number": "1"}])
    return lines(spark, bill), resources(spark, rows), change


WANT = {
    "new": "new_resource", "gone": "removed_resource", "planned": "planned", "steady": "steady_state", "growth": "usage_growth",
    "cdk": "non_terraform_iac", "sdk": "orphan_sdk_created", "legacy": "legacy_untracked", "unknown": "orphan_unknown",
    "spot": "spot_price_volatility", "credit": "credit_applied",
}


def test_every_branch(spark):
    rows = {r.resource_id: r for r in compute_variance(*seeded(spark)).collect()}
    assert {k: r.reason_code for k, r in rows.items()} == WANT
    assert (rows["planned"].pr_number, rows["planned"].pr_author) == ("99", "me")
    assert rows["planned"].evidence == "PR #99: Resize; Managed by terraform (modules/app)"
    assert rows["new"].evidence == "New Amazon EC2 resource (team: core) costing 500/mo; Managed by terraform (modules/app)"
    assert rows["unknown"].evidence == "Not in any IaC state — possible drift"
    assert rows["credit"].evidence == "Edge case: credit_applied (charge_types: Refund); Managed by terraform (modules/app)"
    assert rows["steady"].evidence.startswith("Day-adjusted delta is 0.0% (within normal range for 31→28 day month); ")
    assert rows["growth"].evidence.startswith("Day-adjusted growth of 121.4% exceeds normal variation; ")
    assert rows["gone"].evidence == "Managed by terraform (modules/app)"
    assert (float(rows["new"].delta_pct), float(rows["gone"].delta_pct), float(rows["growth"].delta_pct)) == (0, -100, 100)
    assert rows["spot"].excluded and not rows["new"].excluded


def test_invariants(spark):
    bill, res, change = seeded(spark)
    v = compute_variance(bill, res, change)
    sums = as_dict(res.groupBy(F.col("billing_period_start").alias("m")).agg(F.sum("total_cost").alias("s")), "m", "s")
    assert v.agg(F.sum("delta_dollars")).first()[0] == sums[FEB] - sums[JAN]
    assert v.count() == v.select("resource_id").distinct().count() == res.select("resource_id").distinct().count()
    again = compute_variance(bill.repartition(7), res.repartition(5, "region"), change.repartition(3))
    assert sorted(v.collect()) == sorted(again.collect())


def test_empty_period(spark):
    bill, res, change = seeded(spark)
    assert compute_variance(bill, res, change, one_pair(spark, "2020-01", "2020-02")).count() == 0
    assert reports.variance_summary(compute_variance(bill, res.limit(0), change)).count() == 0


def test_five_percent_boundary(spark):
    rows = []
    for name, cost in (("at", "105"), ("over", "105.01"), ("under", "95"), ("below", "94.99")):
        rows += [managed(name, 100, date(2025, 7, 1)), managed(name, cost, date(2025, 8, 1))]
    v = compute_variance(lines(spark, []), resources(spark, rows), events(spark, []), one_pair(spark, "2025-07", "2025-08"))
    assert as_dict(v, "resource_id", "reason_code") == {
        "at": "steady_state", "over": "usage_growth", "under": "steady_state", "below": "usage_growth"}


def test_evidence_chain_steps(spark):
    bill, res, change = seeded(spark)
    rows = {r.resource_id: r.evidence_chain for r in evidence_chain(
        classified_variance(bill, res, change, one_pair(spark, "2025-01", "2025-02"))).collect()}
    steps = lambda rid: [(s.step, s.result) for s in rows[rid].classification_steps]
    assert steps("credit") == [("edge_case_detection", "credit_applied")]
    assert rows["credit"].classification_steps[0].detail == "Charge types ['Refund'] matched edge case pattern"
    assert steps("new") == [("period_presence", "new_resource")]
    assert steps("gone") == [("period_presence", "removed_resource")]
    assert steps("planned") == [("iac_lookup", "managed"), ("change_event_match", "matched"), ("classification", "planned")]
    assert rows["planned"].classification_steps[1].detail == "PR #99: Resize"
    assert rows["planned"].classification_steps[2].detail == "Delta 200.0%, IaC=True, change_event=yes"
    assert steps("unknown")[0] == ("iac_lookup", "unmanaged") and steps("growth")[1] == ("change_event_match", "no_match")
    given = rows["planned"].inputs
    assert (given.resource_id, given.prior_cost, given.current_cost, given.in_iac, given.iac_source) == ("planned", 100.0, 300.0, True, "terraform")


def test_summary_and_confidence(spark):
    v = compute_variance(*seeded(spark))
    rows = reports.variance_summary(v).collect()
    sure = sum(1 for r in v.collect() if r.confidence_score >= Decimal("0.70"))
    assert {r.attribution_coverage_pct for r in rows} == {round(sure / 11 * 100, 2)}
    assert sum(r.rows for r in rows) == 11 and len({r.total_delta for r in rows}) == 1


def test_baselines(spark):
    months = [date(2024, 2, 1), date(2024, 12, 1), JAN, FEB]
    rows = [managed("a", c, m) for c, m in zip((50, 100, 200, 300), months)] + [managed("b", 40, date(2024, 12, 1))]
    args = lines(spark, []), resources(spark, rows), events(spark, []), one_pair(spark, "2025-01", "2025-02")
    got = {mode: {r.resource_id: r for r in compute_variance(*args, mode).collect()}
           for mode in ("prior_month", "rolling_3m", "same_month_last_year")}
    assert float(got["prior_month"]["a"].prior_cost) == 200 and "b" not in got["prior_month"]
    assert float(got["rolling_3m"]["a"].prior_cost) == 150 and got["rolling_3m"]["b"].reason_code == "removed_resource"
    assert got["rolling_3m"]["a"].prior_period_start == JAN
    assert float(got["same_month_last_year"]["a"].prior_cost) == 50
    assert got["same_month_last_year"]["a"].prior_period_start == date(2024, 2, 1)


def test_all_pairs_match_single_pairs(spark):
    bill, res, change = seeded(spark)
    more = res.unionByName(res.where(F.col("billing_period_start") == F.lit(FEB)).withColumn("billing_period_start", F.lit(MAR)))
    bill = bill.unionByName(lines(spark, [line(9, "steady", 1, MAR)]))
    both = compute_variance(bill, more, change)
    single = compute_variance(bill, more, change, one_pair(spark, "2025-01", "2025-02")).unionByName(
        compute_variance(bill, more, change, one_pair(spark, "2025-02", "2025-03")))
    assert sorted(both.collect(), key=str) == sorted(single.collect(), key=str)


def test_no_cross_join_in_the_plan(spark):
    plan = compute_variance(*seeded(spark))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "FullOuter" in plan


def test_drift_flag_and_descriptions(spark):
    v = compute_variance(*seeded(spark))
    flags = v.select("resource_id", marts.high_priority_drift(F.col("reason_code"), F.lit(1001)).alias("f"),
                     marts.reason_description(F.col("reason_code")).alias("d"), marts.delta_bucket(F.col("delta_pct")).alias("b"))
    rows = {r.resource_id: r for r in flags.collect()}
    assert {k for k, r in rows.items() if r.f} == {"cdk", "sdk", "legacy", "unknown"}
    assert rows["planned"].d == codes.REASON_TEXT["planned"] and rows["steady"].d == "Unknown"
    assert rows["cdk"].b == "medium" and rows["growth"].b == "large" and rows["new"].b == "small"


def test_signals_and_events_are_only_joined_for_current_rows(spark):
    bill, res, change = seeded(spark)
    paired = paired_sides(res, one_pair(spark, "2025-01", "2025-02"))
    assert paired.where("c is null").count() == 1
    assert resource_signals(bill).where(F.col("billing_period_start") == F.lit(JAN)).count() == 2
    assert change_event_match(change).count() >= 2


def test_every_order_is_a_pull_request_and_every_line_a_change_event(spark):
    sf = "/root/testdata/sf0.001"
    orders, lines = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    prs, files = tables._mapped(spark, sf, tables.mapping.PULL_REQUESTS), tables._mapped(spark, sf, tables.mapping.PR_FILES)
    known = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(spark.read.parquet(f"{sf}/part.parquet"), lines.l_partkey == F.col("p_partkey")).count()
    assert prs.count() == orders.count() and files.count() == known
    events = tables.mapped_events(spark, sf)
    assert events.count() == known
    for df in (prs, events):
        assert df.select("priority").distinct().count() == orders.select("o_orderpriority").distinct().count()


def test_pipeline_reads_the_lines_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    bill, _, change = seeded(spark)
    bill.write.partitionBy("billing_period_start").parquet(path)
    stored_lines = spark.read.parquet(path)
    assert line_partials(stored_lines)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    index = iac.iac_union({"terraform": spark.createDataFrame([(1, "a", "m", "T", "n")], "ordinal long, identifier string, module string, resource_type string, resource_name string")})
    out = run_pipeline(stored_lines, index, change)
    assert out.count() > 0
    assert not [f for f in out.inputFiles() if path in f]  # all that follows comes from what the one scan wrote


def test_stored_resources_share_one_order(spark, monkeypatch):
    plans = []
    write = tables.write_bucketed
    key = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(key)

    def kept(rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, *args)

    monkeypatch.setattr(tables, "write_bucketed", kept)
    monkeypatch.setattr(tables, "_tables", {})
    sf = "/root/testdata/sf0.001"
    got = tables.gold_resources(spark, sf)
    want = tables.silver(spark, sf).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0]
    assert spark.conf.get(key) == before
