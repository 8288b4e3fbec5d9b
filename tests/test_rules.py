"""Rules as tables of cases: edge detection, classification, confidence, environment, services."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendweave.functions import codes, rules
from spendweave.functions.numbers import days_in_month, parse_period, percent, rounded

EDGE_CASES = [
    (["SavingsPlanCoveredUsage"], "", "savings_plan_allocation"),
    (["SavingsPlanNegation"], "", "savings_plan_allocation"),
    (["SavingsPlanRecurringFee"], "", "savings_plan_allocation"),
    (["RIFee"], "", "ri_coverage_shift"),
    (["DiscountedUsage"], "", "ri_coverage_shift"),
    (["Credit"], "", "credit_applied"),
    (["Refund"], "", "credit_applied"),
    (["BundledDiscount"], "", "credit_applied"),
    (["Usage"], "AWS Marketplace subscription", "marketplace_subscription"),
    (["Usage"], "SpotUsage for i-abc", "spot_price_volatility"),
    (["SpotUsage"], "some instance", "spot_price_volatility"),
    (["Usage"], "DataTransfer-Out-Bytes", "cross_service_transfer"),
    (["Usage"], "NAT Gateway processing", "cross_service_transfer"),
    (["Usage"], "CloudFront data transfer", "cross_service_transfer"),
    (["Usage"], "EC2 running hours", None),
    ([], "", None),
    ([], None, None),
    (["Credit"], "marketplace subscription", "credit_applied"),
    (["Usage", "RIFee", "Credit"], "", "ri_coverage_shift"),
    (["Usage"], "temp-x volume", "marketplace_subscription"),
    (["Usage"], "hotspot", "spot_price_volatility"),
]


def test_edge_reason(spark):
    df = spark.createDataFrame([(i, c, d) for i, (c, d, _) in enumerate(EDGE_CASES)], "i int, c array<string>, d string")
    got = {r.i: r.e for r in df.select("i", rules.edge_reason(F.col("c"), F.col("d")).alias("e")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(EDGE_CASES)}


BASE = dict(in_prior=True, in_current=True, managed=True, has_event=False, has_team=False, tags=None,
            prior_cost="100", current_cost="100", pct=0.0, edge=None)
CLASSES = [
    ({"edge": "credit_applied", "in_prior": False}, "credit_applied", "0.90"),
    ({"in_prior": False}, "new_resource", "0.95"),
    ({"in_prior": False, "managed": False, "has_team": True}, "new_resource", "0.70"),
    ({"in_prior": False, "managed": False}, "new_resource", "0.50"),
    ({"in_current": False}, "removed_resource", "0.95"),
    ({"has_event": True, "pct": 90.0}, "planned", "0.95"),
    ({"managed": False, "has_event": True, "current_cost": "500"}, "orphan_unknown", "0.50"),
    ({"managed": False, "tags": {"managed_by": "Pulumi"}}, "non_terraform_iac", "0.85"),
    ({"managed": False, "tags": {"managed-by": "cdk"}}, "non_terraform_iac", "0.85"),
    ({"managed": False, "tags": {"iac_tool": "serverless"}}, "non_terraform_iac", "0.85"),
    ({"managed": False, "tags": {"CreatedBy": "CloudFormation"}}, "non_terraform_iac", "0.85"),
    ({"managed": False, "tags": {"aws:cloudformation:stack-name": "s"}}, "non_terraform_iac", "0.85"),
    ({"managed": False, "tags": {"managed_by": "ops"}, "has_team": True}, "orphan_sdk_created", "0.70"),
    ({"managed": False, "current_cost": "199.99"}, "legacy_untracked", "0.60"),
    ({"managed": False, "current_cost": "200"}, "orphan_unknown", "0.50"),
    ({"managed": False, "prior_cost": "0", "current_cost": "50"}, "orphan_unknown", "0.50"),
    ({"managed": None, "current_cost": "50"}, "legacy_untracked", "0.60"),
    ({"pct": 5.0}, "steady_state", "0.95"),
    ({"pct": 5.01}, "usage_growth", "0.95"),
]


def test_classify_and_confidence(spark):
    rows = []
    for i, (change, _, _) in enumerate(CLASSES):
        r = BASE | change
        rows.append((i, r["in_prior"], r["in_current"], r["managed"], r["has_event"], r["has_team"], r["tags"],
                     Decimal(r["prior_cost"]), Decimal(r["current_cost"]), r["pct"], r["edge"]))
    df = spark.createDataFrame(
        rows, "i int, p boolean, c boolean, m boolean, e boolean, t boolean, tags map<string,string>, "
              "pc decimal(18,2), cc decimal(18,2), pct double, edge string")
    reason = rules.classify(
        in_prior=F.col("p"), in_current=F.col("c"), managed=F.col("m"), has_event=F.col("e"), has_team=F.col("t"),
        other_tool=rules.other_iac_tool(F.col("tags")), prior_cost=F.col("pc"), current_cost=F.col("cc"),
        abs_norm_pct=F.col("pct"), edge=F.col("edge"))
    out = df.withColumn("reason", reason).withColumn(
        "conf", rules.confidence(F.col("reason"), F.col("edge").isNotNull(), F.col("m"), F.col("t")))
    got = {r.i: (r.reason, str(r.conf)) for r in out.collect()}
    assert got == {i: (reason, conf) for i, (_, reason, conf) in enumerate(CLASSES)}


@pytest.mark.parametrize("name,tags,module,want", [
    ("web", {"environment": "Production"}, None, "production"),
    ("web-dev", {"env": "stg"}, "modules/prod", "staging"),
    ("web", {"environment": "", "Env": "sandbox"}, None, "dev"),
    ("web", {"environment": "blue"}, "modules/uat/db", "staging"),
    ("olive", None, None, "production"),
    ("x", {"env": "preprod"}, None, "production"),
    ("x-testing", None, None, "dev"),
    (None, None, None, "other"),
])
def test_environment(spark, name, tags, module, want):
    df = spark.createDataFrame([(name, tags, module)], "n string, t map<string,string>, m string")
    got = df.select(rules.environment(F.col("n"), rules.environment_tag(F.col("t")), F.col("m")).alias("e")).first().e
    assert got == want


AZURE = [
    ("/subscriptions/a/resourceGroups/b/providers/Microsoft.Compute/virtualMachines/vm1", "Virtual Machines"),
    ("/subscriptions/a/providers/Microsoft.Sql/servers/s1/databases/d1", "SQL Database"),
    ("/subscriptions/a/PROVIDERS/microsoft.storage/STORAGEACCOUNTS/x", "Storage"),
    ("/a/providers/X.Y/z/providers/Microsoft.Cache/redis/r", "Redis Cache"),
    ("/a/providers/Microsoft.New/fancyThings/t", "fancyThings"),
    ("/a/providers/Microsoft.New", None),
    ("arn:aws:ec2:i-1", None),
    ("", None),
]


def test_azure_service(spark):
    df = spark.createDataFrame([(a,) for a, _ in AZURE], "r string")
    got = {r.r: r.s for r in df.select("r", rules.azure_service(F.col("r")).alias("s")).collect()}
    assert got == dict(AZURE)
    one = spark.createDataFrame([("Microsoft.Compute", AZURE[0][0]), ("Custom", AZURE[0][0]), (None, "i-1")], "s string, r string")
    assert [r[0] for r in one.select(rules.billed_service(F.col("s"), F.col("r"))).collect()] == ["Virtual Machines", "Custom", None]


def test_management_and_allocation_rules(spark):
    df = spark.createDataFrame(
        [(True, True, "a", "s"), (True, False, "a", "s"), (True, True, "", "s"), (True, False, None, None), (False, False, None, None)],
        "f boolean, m boolean, t string, s string")
    out = df.select(
        rules.allocation_method(F.col("f"), F.col("m"), F.col("t"), F.col("s")).alias("a"),
        rules.management_status(F.col("m"), F.col("t")).alias("g")).withColumn("c", rules.allocation_confidence(F.col("a")))
    assert [(r.a, r.g, str(r.c)) for r in out.collect()] == [
        ("terraform_state", "managed", "0.95"), ("tag", "tagged_only", "0.80"), ("service_default", "managed", "0.50"),
        ("unattributed", "unmanaged", "0.30"), ("unattributed", "unmanaged", "0.30")]


def test_numbers(spark):
    df = spark.sql("select date'2024-02-01' d, cast(5 as decimal(18,2)) p, cast(0 as decimal(18,2)) z, 1.005d x")
    row = df.select(days_in_month(F.col("d")).alias("n"), percent(F.col("p"), F.col("z")).alias("nul"),
                    percent(F.col("z"), F.col("p")).alias("zero"), rounded(F.col("x")).alias("r")).first()
    assert (row.n, row.nul, row.zero, row.r) == (29, None, 0.0, 1.01)
    assert str(parse_period("2024-03")) == "2024-03-01"
    for bad in ("2024-13", "2024-3", "24-03", "2024-03-01", "x"):
        with pytest.raises(ValueError):
            parse_period(bad)


def test_risk_score(spark):
    df = spark.createDataFrame([(100.0, 50.0), (9999.0, 999.0), (-50.0, -10.0)], "c double, p double")
    assert [r[0] for r in df.select(rules.risk_score(F.col("c"), F.col("p"))).collect()] == [41.0, 100.0, 32.0]


def test_every_code_has_a_bucket(spark):
    df = spark.createDataFrame([(c,) for c in codes.EMITTED_CODES + ["other"]], "r string")
    got = {r.r: r.b for r in df.select("r", rules.reason_bucket(F.col("r")).alias("b")).collect()}
    assert got["planned"] == "planned" and got["other"] == "drift" and got["steady_state"] == "usage"
    assert all(got[c] == "edge_cases" for c in codes.EDGE_CODES)
    assert len(codes.EMITTED_CODES) == 16
