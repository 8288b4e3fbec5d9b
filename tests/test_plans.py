"""Allocation, marts, quality, reports, forecast, star schema."""

from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from helpers import FEB, JAN, MAR, as_dict, events, line, lines, managed, resource, resources
from pyspark.sql import functions as F

from spendweave.operators import dealing, iac, silver
from spendweave.operators.pairs import consecutive_pairs, one_pair
from spendweave.operators.silver import invoices
from spendweave.plans import allocation, forecast, marts, publish, quality, reports, star, tenants
from spendweave.plans.variance import compute_variance


def test_allocation(spark):
    bill = lines(spark, [line(1, "tf", 10), line(2, "tag", 20), line(3, "svc", 30), line(4, "none", 5), line(5, None, 5), line(6, "tf", 5, JAN)])
    res = resources(spark, [managed("tf", 10, team="a", cost_center="C1"), resource("tag", 20, team="b"), resource("svc", 30)])
    got = {r.billing_line_id: (r.attribution_method, str(r.confidence_score), r.team, r.cost_center)
           for r in allocation.allocate_lines(bill, res).collect()}
    assert got == {
        "l1": ("terraform_state", "0.95", "a", "C1"), "l2": ("tag", "0.80", "b", None), "l3": ("service_default", "0.50", None, None),
        "l4": ("unattributed", "0.30", None, None), "l5": ("unattributed", "0.30", None, None), "l6": ("unattributed", "0.30", None, None)}
    cover = as_dict(allocation.allocation_coverage(allocation.allocate_lines(bill, res)), "billing_period_start", "attribution_coverage_pct")
    assert cover == {FEB: Decimal("40.00"), JAN: Decimal("0.00")}


def test_staging(spark):
    bill = lines(spark, [line(1, "a", 1), line(2, "a", -1, charge_type="Credit"), line(3, "a", 2, charge_type="Tax"), line(4, "a", 3, charge_type=None)])
    got = {r.line_id: (r.is_credit, r.is_usage) for r in marts.stg_billing_lines(bill).collect()}
    assert got == {"l1": (False, True), "l3": (False, False)}
    res = resources(spark, [resource("a", 1, resource_name=None, team=""), managed("b", 1), resource("c", 1, team="x", region="eu")])
    rows = {r.resource_id: r for r in marts.stg_resources(res).collect()}
    assert (rows["a"].resource_name, rows["a"].team, rows["a"].management_status, rows["a"].region) == ("a", "", "unmanaged", "unknown")
    assert (rows["b"].team, rows["b"].management_status, rows["b"].cost_center, rows["b"].provider) == ("Unattributed", "managed", "UNALLOCATED", "AWS")
    assert rows["c"].management_status == "tagged_only"


def test_monthly_spend(spark):
    months = [JAN, FEB, MAR, date(2025, 6, 1)]
    res = resources(spark, [resource("a", c, m) for c, m in zip((100, 0, 50, 75), months)] + [resource("b", 60, MAR)])
    rows = {(r.resource_id, r.billing_period_start): r for r in marts.int_monthly_resource_spend(marts.stg_resources(res)).collect()}
    june = rows["a", months[3]]
    assert (float(june.prior_month_cost), float(june.mom_delta_pct), june.next_month_cost) == (50, 50, None)
    assert rows["a", MAR].mom_delta_pct is None and float(rows["a", MAR].mom_delta_dollars) == 50
    assert float(rows["a", JAN].mom_delta_dollars) == 100 and rows["a", JAN].prior_month_cost is None
    assert abs(float(june.rolling_3m_avg_cost) - 125 / 3) < 1e-4
    assert (rows["b", MAR].cost_rank_in_service, rows["a", MAR].cost_rank_in_service) == (1, 2)


def test_dim_resources(spark):
    res = resources(spark, [resource("a", 10, JAN), managed("a", 20, FEB, team="x"), resource("b", 5, JAN)])
    rows = {r.resource_id: r for r in marts.dim_resources(marts.stg_resources(res)).collect()}
    assert (float(rows["a"].latest_period_cost), rows["a"].latest_billing_period, rows["a"].team) == (20, FEB, "x")
    assert (float(rows["a"].total_drift_spend), float(rows["a"].total_managed_spend), rows["a"].periods_observed) == (10, 20, 2)


def test_invoice_totals_and_mismatch(spark):
    bill = lines(spark, [line(1, "a", 60), line(2, "b", 40), line(3, "a", -10, charge_type="Credit")])
    res = resources(spark, [resource("a", 60, team="x"), resource("b", 40)])
    staged = marts.stg_billing_lines(bill)
    row = marts.int_invoice_totals(staged, allocation.allocate_lines(bill, res)).first()
    assert (float(row.total_billed_cost), float(row.total_credits), float(row.total_usage), row.total_line_items) == (100, 0, 100, 2)
    assert row.reconciliation_status == "reconciled" and float(row.attributed_cost) == 90
    assert marts.invoice_line_mismatch(marts.int_invoice_totals(staged, allocation.allocate_lines(bill, res)), staged).count() == 0
    assert marts.invoice_line_mismatch(invoices(bill), staged).count() == 1


def test_reconciliation_macro(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k1", 2.0), ("k2", 5.0), ("k4", 1.0)], "k string, x double")
    b = spark.createDataFrame([("k1", 3.005), ("k3", 7.0), ("k4", 1.02)], "k string, y double")
    got = {r.k for r in marts.cost_reconciliation(a, b, "k", "x", "y").collect()}
    assert got == {"k2", "k3", "k4"}


def test_flips_missing_and_negative(spark):
    res = resources(spark, [resource("a", 1, JAN), managed("a", 1, FEB), managed("a", -1, MAR), managed("b", 1, JAN), managed("b", 1, FEB)])
    staged = marts.stg_resources(res)
    v = compute_variance(lines(spark, []), res, events(spark, []), consecutive_pairs(res))
    flips = {(r.resource_id, r.period_1, r.period_2) for r in marts.tf_status_flips(staged, v).collect()}
    assert flips == {("a", JAN, FEB), ("a", JAN, MAR)}
    assert marts.variance_missing_resources(staged, v).count() == 0
    missing = marts.variance_missing_resources(staged, v.where("resource_id <> 'a'"))
    assert {tuple(r) for r in missing.collect()} == {("a", FEB), ("a", MAR)}
    assert [r.resource_id for r in marts.no_negative_costs(staged).collect()] == ["a"]


# -- quality


def checks(spark, bill, inv=None):
    rows = quality.run_quality_checks(bill, invoices(bill) if inv is None else inv).collect()
    return {r.check: (r.status, r.detail) for r in rows}


def test_quality_pass(spark):
    bill = lines(spark, [line(1, "a", "900.25", tags={"team": "x"}), line(2, "b", "100", tags={"team": "x"})])
    assert checks(spark, bill) == {
        "Invoice reconciliation": ("pass", "Line sum: $1,000.25, Invoice: $1,000.25, Diff: $0.00"),
        "No duplicate billing lines": ("pass", "No duplicates"), "Resource ID coverage": ("pass", "0 of 2 lines missing resource_id"),
        "No negative costs (non-credit)": ("pass", "0 non-credit negative cost lines"),
        "Attribution coverage >= 80%": ("pass", "Attribution coverage: 100.0%")}


def test_quality_fail_and_warn(spark):
    twin = dict(charge_period_start=None)
    bill = lines(spark, [
        line(1, "a", 10, **twin), line(2, "a", 10, **twin), line(3, None, 5, tags={"team": "x"}), line(4, "", 5), line(5, "b", -3),
        line(6, "c", -3, charge_type="Credit"), line(7, "d", -3, charge_type="Refund"), line(8, "e", -3, charge_type=None)])
    wrong = invoices(bill).withColumn("total_billed_cost", F.lit(99).cast("decimal(18,2)"))
    got = checks(spark, bill, wrong)
    assert {k: s for k, (s, _) in got.items()} == {
        "Invoice reconciliation": "fail", "No duplicate billing lines": "warn", "Resource ID coverage": "warn",
        "No negative costs (non-credit)": "warn", "Attribution coverage >= 80%": "fail"}
    assert got["No duplicate billing lines"][1] == "1 duplicate groups found"
    assert got["Resource ID coverage"][1] == "2 of 8 lines missing resource_id"
    assert got["No negative costs (non-credit)"][1] == "1 non-credit negative cost lines"
    none = checks(spark, bill, invoices(bill).limit(0))
    assert none["Invoice reconciliation"] == ("warn", "No invoice found for this period")
    assert none["Attribution coverage >= 80%"] == ("warn", "No invoice data to check attribution")


def test_several_invoices_in_a_month_reconcile(spark):
    bill = lines(spark, [line(i, f"r{i}", "10.004", invoice_id=f"I{i}", tags={"team": "x"}) for i in range(5)])
    assert checks(spark, bill)["Invoice reconciliation"][0] == "pass"


def test_gate(spark, tmp_path):
    bill = lines(spark, [line(1, "a", 10), line(2, None, 5)])
    log = str(tmp_path / "log")
    with pytest.raises(quality.QualityError, match="Attribution coverage"):
        quality.dq_gate(quality.run_quality_checks(bill, invoices(bill)), log)
    assert spark.read.parquet(log).count() == 5
    assert quality.dq_gate(quality.dq_missing_ids(bill)).first().status == "warn"
    later = quality.dq_missing_ids(bill).withColumn(quality.PERIOD, F.add_months(quality.PERIOD, 1))
    assert quality.dq_gate(later, log).count() == 1  # the earlier month's failure in the log doesn't count
    assert spark.read.parquet(log).count() == 6


def test_generic_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "z")], "k string, v string")
    want = quality.Expectations(not_null=["k", "v"], unique=["k"], accepted={"v": ["x"]})
    got = {(r.check, r.column): r.failures for r in quality.dq_generic({"t": (df, want)}).collect()}
    assert got == {("not_null", "k"): 1, ("not_null", "v"): 1, ("accepted_values", "v"): 1, ("unique", "k"): 1}


def test_line_counters(spark):
    bill = lines(spark, [line(1, None, 0), line(2, "", None, service_name=""), line(3, "a", -1, service_name=None), line(4, "a", 1)])
    row = quality.dq_line_counters(bill).first()
    assert (row.rows, row.missing_resource_id, row.missing_service, row.zero_cost_lines, row.negative_cost_lines) == (4, 2, 2, 2, 1)


# -- reports


def anomaly_seed(spark):
    rows = []
    for i in range(8):
        rows += [managed(f"s{i}", 1000 + 10 * i, JAN), managed(f"s{i}", 1050 + 10 * i)]
    rows += [managed("spike", 200, JAN, team="data"), managed("spike", 5000, team="data"), resource("fresh", 8000, service_name="Amazon RDS")]
    return compute_variance(lines(spark, []), resources(spark, rows), events(spark, []), one_pair(spark, "2025-01", "2025-02"))


def test_anomalies(spark):
    v = anomaly_seed(spark)
    rows = {r.resource_id: r for r in reports.anomalies(v).collect()}
    assert set(rows) == {"spike", "fresh"}
    assert rows["spike"].severity == 4800 * 25 and rows["fresh"].severity == 8000
    assert [r.resource_id for r in reports.top_anomalies(v, 1).collect()] == ["spike"]
    s = reports.anomaly_summary(reports.anomalies(v)).first()
    assert (s.anomalies, float(s.total_impact), s.top_service, s.top_team) == (2, 12800, "Amazon RDS", "Untagged")
    assert [r.resource_id for r in reports.anomalies_all_periods(v).collect()] == ["spike"]
    assert reports.anomaly_summary(reports.anomalies(v, 1e9, 1e9)).count() == 0


def test_root_causes_keep_empty_buckets(spark):
    rows = as_dict(reports.root_causes(anomaly_seed(spark)), "bucket", "rows")
    assert rows == {"planned": 0, "drift": 0, "usage": 10, "edge_cases": 0}


def test_filters_and_totals(spark):
    v = anomaly_seed(spark)
    assert [r.resource_id for r in reports.resources_by_filter(v, service="rds").collect()] == ["fresh"]
    assert reports.resources_by_filter(v, in_terraform=True, min_cost=1100).count() == 4
    assert [r.resource_id for r in reports.top_variance(v, 2).collect()] == ["fresh", "spike"]
    assert reports.direction_filter(v, "decreases").count() == 0
    t = reports.variance_totals(v).first()
    assert t.net_change == t.total_increases and t.total_decreases == 0 and t.total_variance == t.net_change


def test_gl_export(spark):
    res = resources(spark, [resource("a", 100, JAN), resource("a", 40), resource("b", "7.5", service_name=None, resource_name="")])
    v = compute_variance(lines(spark, []), res, events(spark, []), one_pair(spark, "2025-01", "2025-02"))
    rows = {(r.Account, r.Description, r.Debit, r.Credit, r.Reason, r.Service, r.Date) for r in reports.gl_export(v).collect()}
    assert rows == {
        ("6AMA00", "a — legacy untracked", "0.00", "60.00", "legacy_untracked", "Amazon EC2", "2025-02-01"),
        ("6CLD00", "b — new resource", "7.50", "0.00", "new_resource", "", "2025-02-01")}


def test_redaction(spark):
    text = "key AKIAABCDEFGHIJKL1 and " + "a1/+" * 11 + " stay " + "b" * 39
    df = spark.createDataFrame([(text,)], "t string")
    assert reports.redact_secrets(df, "t").first().t == "key [REDACTED] and [REDACTED] stay " + "b" * 39


def test_overview_and_coverage(spark):
    bill = lines(spark, [line(1, "a", 100, JAN), line(2, "a", 60, invoice_id="I1"), line(3, "b", 90, invoice_id="I2")])
    row = reports.bill_overview(invoices(bill), one_pair(spark, "2025-01", "2025-02")).first()
    assert (float(row.prior_total), float(row.current_total), float(row.delta), row.change_pct) == (100, 150, 50, 50.0)
    empty = reports.bill_overview(invoices(bill), one_pair(spark, "2024-01", "2025-02")).first()
    assert (float(empty.prior_total), empty.change_pct) == (0, 0.0)
    assert [r.period for r in reports.periods(bill).collect()] == ["2025-02", "2025-01"]
    cover = reports.iac_coverage(resources(spark, [managed("a", 30), resource("b", 10), resource("c", 20)])).first()
    assert (cover.coverage_pct, cover.cost_coverage_pct) == (33.3, 50.0)


def test_ids_movers_growth(spark):
    res = resources(spark, [resource("x", 10, JAN), resource("y", 10, JAN), resource("y", 30, team=""), resource("z", 500)])
    pair = one_pair(spark, "2025-01", "2025-02")
    s = reports.id_sets(res, pair).first()
    assert (s.shared, s.new, s.removed) == (1, 1, 1)
    assert [(r.resource_id, float(r.delta)) for r in reports.top_movers(res, pair, 2).orderBy("rank").collect()] == [("z", 500), ("y", 20)]
    g = {r.resource_id: r for r in reports.import_priority(reports.drift_growth(res, pair)).collect()}
    assert (g["z"].priority, g["z"].pct_change, g["z"].risk_score, g["y"].priority, g["y"].pct_change) == (1, 100.0, 55.0, 2, 200.0)
    assert g["z"].import_cmd == "terraform import aws_instance.z z" and g["y"].team == "Unknown"


# -- forecast


def test_forecast_total_matches_least_squares(spark):
    months = [date(2024, m, 1) for m in range(1, 8)]
    costs = [100, 130, 170, 180, 260, 250, 300]
    bill = lines(spark, [line(i, "a", c, m) for i, (m, c) in enumerate(zip(months, costs))])
    row = forecast.forecast_total(invoices(bill), 2).first()
    slope, start = np.polyfit(range(7), costs, 1)
    assert row.forecast == round(slope * 8 + start, 2) and row.confidence == "high" and row.periods_used == 7
    assert row.trend_pct == round(slope / np.mean(costs) * 100, 1)


@pytest.mark.parametrize("costs,want", [([5], "insufficient_data"), ([5, 9], "low"), ([5, 5, 5, 5, 5, 5, 5], "low"), ([1, 2, 3], "medium")])
def test_forecast_confidence(spark, costs, want):
    bill = lines(spark, [line(i, "a", c, date(2024, i + 1, 1)) for i, c in enumerate(costs)])
    row = forecast.forecast_total(invoices(bill)).first()
    assert row.confidence == want and (row.forecast is None) == (want == "insufficient_data")
    if len(set(costs)) == 1 and len(costs) > 1:
        assert row.r_squared == 0.0 and row.forecast == 5.0


def test_forecast_by_service_never_negative(spark):
    rows = [resource("a", c, date(2024, m, 1), service_name="down") for m, c in ((1, 100), (3, 10))]
    rows += [resource("b", 7, JAN, service_name="single")]
    got = forecast.forecast_by_service(resources(spark, rows)).collect()
    assert [(r.service, r.forecast, float(r.current), r.periods_used) for r in got] == [("down", 0.0, 10, 2)]


# -- star schema


def test_dimensions_only_grow(spark):
    old = resources(spark, [resource("a", 1, JAN, service_category="X", team="t", cost_center="1")])
    new = resources(spark, [resource("a", 1, service_category="Y", team="t", cost_center="2"), resource("b", 1, service_name="S3", team=None),
                            resource("c", 1, service_name="S3", service_category="Z")])
    first = star.dim_services(old)
    merged = star.dim_services(new, first)
    assert {(r.service_name, r.service_category) for r in merged.collect()} == {("Amazon EC2", "X"), ("S3", None)}
    assert sorted(star.dim_services(new, merged).collect()) == sorted(merged.collect())
    assert [(r.team, r.cost_center) for r in star.dim_teams(new, star.dim_teams(old)).collect()] == [("t", "1")]
    p = star.dim_periods(resources(spark, [resource("a", 1, date(2024, 2, 1))])).first()
    assert (p.period_year, p.period_month, p.period_label, p.days_in_month) == (2024, 2, "2024-02", 29)


def test_fact_does_not_fan_out(spark):
    v = anomaly_seed(spark)
    res = resources(spark, [resource("q", 1, service_category=c) for c in "abc"] + [resource("d", 1, team="data")])
    fact = star.fact_variance(v, star.dim_services(res), star.dim_teams(res), star.dim_periods(res))
    assert fact.count() == v.count()
    assert fact.where("team_key is not null").count() == 1
    assert fact.where("prior_period_key is null and current_period_key is not null").count() == v.count()


def test_publish(spark, tmp_path):
    bill = lines(spark, [line(1, "a", 10, JAN), line(2, "a", 20), line(3, "b", 5, charge_type="Credit")])
    res = resources(spark, [managed("a", 10, JAN, team="x"), managed("a", 20, team="x"), resource("b", 5)])
    v = compute_variance(bill, res, events(spark, []), consecutive_pairs(res))
    args = (bill, res, v, allocation.allocate_lines(bill, res), str(tmp_path))
    paths = marts.publish(*args)
    assert marts.publish(*args) == paths
    counts = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    assert counts == {"int_invoice_totals": 2, "int_monthly_resource_spend": 3, "dim_resources": 2, "fct_variance_report": 2}
    assert spark.table("stg_billing_lines").count() == 2 and spark.table("stg_resources").count() == 3


def test_publishing_behind_the_gate(spark, tmp_path):
    root = str(tmp_path / "published")
    bill = lines(spark, [line(1, "a", 10), line(2, None, 20)])
    res = resources(spark, [managed("a", 10, team="x")])
    assert publish.visible(spark, root) is None
    good = quality.dq_missing_ids(bill)
    verdict = publish.publish(spark, {"res": (res, "billing_period_start"), "lines": (bill, None)}, good, root).first()
    assert (verdict.check, verdict.verdict, verdict.warned) == ("Resource ID coverage", "warn", 1)
    first = publish.visible(spark, root)
    bad = good.unionByName(good.withColumn("status", F.lit("fail")).withColumn("check", F.lit("other")))
    with pytest.raises(quality.QualityError, match="other: 1"):
        publish.publish(spark, {"res": (res.limit(0), None), "lines": (bill, None)}, bad, root)
    assert publish.visible(spark, root) == first and publish.read_published(spark, root, "res").count() == 1
    publish.publish(spark, {"res": (res.unionByName(res), None)}, good, root)
    assert publish.visible(spark, root) != first and publish.read_published(spark, root, "res").count() == 2
    assert {r.check: r.verdict for r in quality.verdicts(bad).collect()} == {"Resource ID coverage": "warn", "other": "fail"}


def test_coverage_is_written_back_and_invoices_reconciled(spark):
    bill = lines(spark, [line(1, "a", 10), line(2, "b", 20), line(3, "a", -4, charge_type="Credit"), line(4, "a", 1, JAN)])
    res = resources(spark, [managed("a", 10, team="x"), resource("b", 5)])
    allocated = allocation.allocate_lines(bill, res)
    got = as_dict(allocation.with_coverage(invoices(bill), allocated.where(F.col("billing_period_start") == F.lit(FEB))), "invoice_id", "attribution_coverage_pct")
    assert got == {"INV-2025-02": Decimal("66.67"), "INV-2025-01": Decimal("0.00")}
    totals = {r.invoice_id: r for r in marts.int_invoice_totals(marts.stg_billing_lines(bill), allocated, invoices(bill)).collect()}
    assert {i: (r.reconciliation_variance, r.reconciliation_status) for i, r in totals.items()} == {
        "INV-2025-02": (Decimal("4"), "variance_detected"), "INV-2025-01": (Decimal("0"), "reconciled")}


def test_a_late_batch_recomputes_its_periods_only(spark, tmp_path):
    path = str(tmp_path / "partials")
    early = [line(1, "a", 1, JAN, tags={"team": "t"}), line(2, "a", 2, FEB), line(3, "b", 3, FEB, charge_type="Tax"), line(4, None, 9, MAR)]
    late = [line(5, "a", 4, FEB, tags={"team": "u"}, description="spot"), line(6, "c", 5, FEB, provider="Azure")]
    index = iac.iac_union({"terraform": spark.createDataFrame([(1, "a", "m", "T", "n")], "ordinal long, identifier string, module string, resource_type string, resource_name string")})
    silver.update_partials(lines(spark, early), path, [JAN, FEB, MAR])
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "partials").rglob("billing_period_start=2025-01-01/*.parquet")}
    silver.update_partials(lines(spark, early + late), path, [FEB])
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "partials").rglob("billing_period_start=2025-01-01/*.parquet")}
    partials, every = spark.read.parquet(path), lines(spark, early + late)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(silver.resources(partials, index)) == rows(silver.resources(every, index))
    assert rows(silver.resource_signals(partials)) == rows(silver.resource_signals(every))
    assert silver.billing_periods(partials).count() == 3
    assert {r.resource_id: r.provider for r in silver.resources(every).collect()}["c"] == "Azure"


def test_tenants_with_the_same_resource_stay_apart(spark, tmp_path):
    mine = [line(1, "a", 10, JAN, user_id=1), line(2, "a", 30, FEB, user_id=1)]
    theirs = [line(3, "a", 100, JAN, user_id=2), line(4, "a", 20, FEB, user_id=2), line(5, "", 1, FEB, user_id=2), line(6, "b", 7, FEB, user_id=None)]
    index = iac.iac_union({"terraform": spark.createDataFrame([(1, "a", "m", "T", "n")], "ordinal long, identifier string, module string, resource_type string, resource_name string")})
    change = events(spark, [{"resource_id": "a", "event_date": date(2025, 2, 2), "pr_number": "7", "pr_title": "t"}]).withColumn("user_id", F.lit(2))
    out = tenants.tenant_variance(lines(spark, mine + theirs), index, change)
    got = {(r.user_id, r.resource_id): (int(r.prior_cost), int(r.current_cost), r.pr_number, r.in_terraform_state) for r in out.collect()}
    assert got == {(1, "a"): (10, 30, None, True), (2, "a"): (100, 20, "7", True), (None, "b"): (0, 7, None, False)}
    bills = {(r.user_id, r.invoice_id): int(r.total_billed_cost) for r in tenants.tenant_invoices(lines(spark, mine + theirs)).collect()}
    assert bills == {(1, "INV-2025-01"): 10, (1, "INV-2025-02"): 30, (2, "INV-2025-01"): 100, (2, "INV-2025-02"): 21, (None, "INV-2025-02"): 7}
    assert {(r.user_id, r.billing_line_id) for r in tenants.tenant_allocations(lines(spark, mine + theirs), index).collect()} == {
        (1, "l1"), (1, "l2"), (2, "l3"), (2, "l4"), (None, "l6")}
    path = str(tmp_path / "variance")
    tenants.store_by_tenant(out, path)
    scoped = reports.tenant_scope(spark.read.parquet(path), 2)
    plan = scoped._jdf.queryExecution().toString()
    assert scoped.count() == 1 and "PartitionFilters: [isnotnull(user_id" in plan
    tenants.store_by_tenant(out.limit(0), path, [(2, FEB)])
    assert {r.user_id for r in spark.read.parquet(path).collect()} == {1, None}


def test_sides_of_tenants_meet_where_their_resources_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 5)
    bill = [line(n, f"r{n % 7}", 4 + n, (JAN, FEB, MAR)[n % 3], user_id=n % 2 + 1) for n in range(70)]
    index = iac.iac_union({"terraform": spark.createDataFrame([(1, "r1", "m", "T", "n")], "ordinal long, identifier string, module string, resource_type string, resource_name string")})
    change = events(spark, [{"resource_id": f"x/r{n}", "event_date": FEB, "pr_number": str(n)} for n in range(15)]).withColumn("user_id", F.lit(2))
    out = tenants.tenant_variance(lines(spark, bill), index, change)
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.user_id, r.resource_id, str(r.current_period_start)): (int(r.prior_cost), int(r.current_cost), r.pr_number) for r in out.collect()}
    for tenant in (1, 2):  # as its own lines and events alone give them
        own = compute_variance(
            lines(spark, [x for x in bill if x["user_id"] == tenant]),
            silver.resources(lines(spark, [x for x in bill if x["user_id"] == tenant]), index), change if tenant == 2 else change.limit(0))
        assert {k[1:]: v for k, v in got.items() if k[0] == tenant} == {
            (r.resource_id, str(r.current_period_start)): (int(r.prior_cost), int(r.current_cost), r.pr_number) for r in own.collect()}


def test_marts_leave_bucketed_tables_where_they_lie(spark, tmp_path):
    from spendweave.sources.sinks import write_bucketed

    rows = [resource(f"r{k}", 10 + k + m, (JAN, FEB, MAR)[m], region=f"x{k}{m}", in_terraform_state=(k * m) % 3 == 1) for k in range(12) for m in range(3) if (k + m) % 5]
    bill = lines(spark, [line(n, f"r{n % 12}", 4, (JAN, FEB, MAR)[n % 3]) for n in range(40)] + [line(99, "r1", 1, billing_period_start=None)])
    res = resources(spark, rows)
    v = compute_variance(bill, res, events(spark, []))
    share = allocation.allocate_lines(bill, res)
    plain = [marts.tf_status_flips(marts.stg_resources(res), v), marts.fct_variance_report(v, res, share)]
    kept = write_bucketed(res.repartition(6, "resource_id"), str(tmp_path / "r"), "resource_id", 6)
    told = write_bucketed(v.repartition(6, "resource_id"), str(tmp_path / "v"), "resource_id", 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flips = marts.tf_status_flips(marts.stg_resources(kept), told)
        assert "Exchange hashpartitioning" not in flips._jdf.queryExecution().executedPlan().toString()
        fct = marts.fct_variance_report(told, kept, share, tasks=6)
        plan = fct._jdf.queryExecution().executedPlan().toString()
        # The lines, their owners and twice the summary; neither the variance nor the attributes.
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(resource_id" in x]
        assert len([x for x in moved if "billing_period_start" in x]) == 3 and len(moved) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [sorted(map(str, x.collect())) for x in (flips, fct)] == [sorted(map(str, x.collect())) for x in plain]
    seen = {(r["resource_id"], r["billing_period_start"]): r["in_terraform_state"] for r in rows}
    explained = {(r.resource_id, r.current_period_start) for r in v.collect() if r.reason_code in ("new_resource", "removed_resource")}
    assert {(r.resource_id, r.period_1, r.period_2) for r in flips.collect()} == {
        (a, p, q) for a, p in seen for b, q in seen if a == b and p < q and seen[a, p] != seen[b, q] and (a, q) not in explained} != set()
    regions = {(r["resource_id"], r["billing_period_start"]): r["region"] for r in rows}
    assert all(r.region == regions.get((r.resource_id, r.current_period_start)) for r in fct.collect())
    assert sum(r.allocation_count or 0 for r in fct.collect()) == bill.join(v, [bill.resource_id == v.resource_id, bill.billing_period_start == v.current_period_start]).count()


def test_stored_tables_are_joined_without_sorting_the_large_side(spark, tmp_path, monkeypatch):
    from spendweave.testbed import tables

    plans, write = [], tables.write_table

    def seen(rows, path):
        rows.collect()
        plans.append(rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        write(rows, path)

    monkeypatch.setattr(tables, "write_table", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kinds = spark.range(20).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
        build = lambda spark, folder: spark.range(1000).withColumn("k", F.col("id") % 25).join(kinds, "k")
        assert tables._stored(spark, str(tmp_path), "some", build).count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") in ("0", "0b")
