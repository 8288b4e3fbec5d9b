"""Operators against brute force on small frames."""

import random
from datetime import date

import numpy as np
import pytest
from helpers import FEB, JAN, MAR, events, line, lines, managed, resource, resources
from pyspark.sql import functions as F

from spendweave.operators import events as ev
from spendweave.operators import dealing, iac, logical, pairs, silver
from spendweave.operators.containment import containment_pairs
from spendweave.operators.ranking import ranked, top_per_group
from spendweave.plans import reports


def test_containment_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda lo, hi, abc="abc-/:": "".join(rng.choice(abc) for _ in range(rng.randint(lo, hi)))
    hay = [word(0, 14) for _ in range(150)] + ["prefix/shared/" + word(3, 12) for _ in range(80)]
    pins = [word(0, 5) for _ in range(60)] + [h[2:] for h in hay[:40]] + hay[150:170] + ["", "nowhere-at-all"]
    h = spark.createDataFrame([(x,) for x in hay] + [(None,)], "h string")
    p = spark.createDataFrame([(x,) for x in pins] + [(None,)], "p string")
    rows = [tuple(r) for r in containment_pairs(h, p, "h", "p").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b) for a in hay for b in pins if b and b in a}


def test_containment_within_groups(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    hay = [(g, text(rng.randint(1, 12))) for g in "ab" for _ in range(60)]
    pins = [(g, text(rng.randint(1, 9))) for g in "abc" for _ in range(25)]
    h, p = spark.createDataFrame(hay, "g string, h string"), spark.createDataFrame(pins, "g string, p string")
    want = {(g, a, b) for g, a in hay for k, b in pins if g == k and b in a}
    rows = [tuple(r) for r in containment_pairs(h, p, "h", "p", ["g"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_an_ngram_of_all_haystacks_is_dealt_out(spark, monkeypatch):
    from spendweave.operators import containment

    monkeypatch.setattr(containment, "SALT_ROWS", 20)
    monkeypatch.setattr(containment, "SALT_SHARE", 1000)
    monkeypatch.setattr(containment, "MOST_BROADCAST_GRAMS", 0)
    h = spark.createDataFrame([(f"shared-text-{k}",) for k in range(300)], "h string")
    p = spark.createDataFrame([("shared-text",), ("text-7",), ("none",), ("t",)], "p string")
    rows = [tuple(r) for r in containment_pairs(h, p, "h", "p").collect()]
    want = {(f"shared-text-{k}", x) for k in range(300) for x in ("shared-text", "text-7", "t") if x in f"shared-text-{k}"}
    assert len(rows) == len(set(rows)) and set(rows) == want
    pairs = containment_pairs(h.withColumn("n", F.length("h")), p.withColumn("m", F.length("p")), "h", "p", haystack_extra=["n"], needle_extra=["m"])
    assert {(r.h, r.p) for r in pairs.where("n = length(h) and m = length(p)").collect()} == want


def test_containment_plan_has_no_nested_loop(spark):
    h = spark.range(10).select(F.col("id").cast("string").alias("h"))
    p = spark.range(5).select(F.col("id").cast("string").alias("p"))
    plan = containment_pairs(h, p, "h", "p")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_foreign_ngrams_are_dropped_before_any_exchange(spark):
    from spendweave.operators.containment import haystack_grams

    hay = spark.range(100).select(F.concat(F.lit("text-"), "id").alias("_hay"))
    wanted = spark.range(5).select(F.xxhash64(F.col("id").cast("string")).alias("_gram"))
    plan = haystack_grams(hay, F.array(F.lit(1), F.lit(2)), F.broadcast(wanted))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_ranked_equals_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.randint(0, 40), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r.g, r.id): r["rank"] for r in ranked(df, ["g"], {"v": True, "id": False}, partitions=7).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[(g, r[2])] = n
    assert got == want


def test_exact_quantiles(spark):
    rng = random.Random(2)
    data = {m: [rng.choice([1.5, 2.25, rng.random() * 100]) for _ in range(n)] for m, n in ((JAN, 1), (FEB, 2), (MAR, 333))}
    rows = [line(i, "r", round(v, 6), m) for m, vs in data.items() for i, v in enumerate(vs)]
    got = {r.billing_period_start: r for r in reports.cost_describe(lines(spark, rows)).collect()}
    for m, vs in data.items():
        vs = [round(v, 6) for v in vs]
        for name, q in (("p25", 25), ("p50", 50), ("p75", 75)):
            assert abs(got[m][name] - np.percentile(vs, q)) < 1e-9
        assert abs(got[m]["mean"] - np.mean(vs)) < 1e-9 and got[m].lines == len(vs)
        assert got[m]["std"] is None if len(vs) == 1 else abs(got[m]["std"] - np.std(vs, ddof=1)) < 1e-9


def test_top_per_group_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_per_group(df, ["g"], [F.col("v").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert {(r.g, r.v) for r in top.collect()} == {(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)}


def source(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, identifier string, module string, resource_type string, resource_name string")


def test_iac_union_overrides_but_keeps_place(spark):
    tf = source(spark, [(0, "a", "m1", "t", "a"), (1, "b", "m2", "t", "b"), (2, "", "m", "t", "x")])
    pulumi = source(spark, [(0, "b", "pulumi", "t", "b2"), (1, "c", "pulumi", "t", "c")])
    rows = {r.identifier: (r.rank, r.ordinal, r.module, r.iac_source) for r in iac.iac_union({"terraform": tf, "pulumi": pulumi}).collect()}
    assert rows == {"a": (0, 0, "m1", "terraform"), "b": (0, 1, "pulumi", "pulumi"), "c": (3, 1, "pulumi", "pulumi")}


def test_iac_match_prefers_exact_then_earliest(spark):
    index = iac.iac_union({"terraform": source(spark, [
        (0, "i-1", "first", "t", "x"), (1, "arn:i-12", "exact", "t", "x"), (2, "long/arn:i-3/end", "around", "t", "x")])})
    ids = spark.createDataFrame([("arn:i-12",), ("arn:i-1",), ("arn:i-3",), ("arn:i-9",), ("i-1",)], "resource_id string")
    got = {r.resource_id: r.module for r in iac.iac_match(ids, index).collect()}
    assert got == {"arn:i-12": "exact", "arn:i-1": "first", "arn:i-3": "around", "i-1": "first"}


def test_invoices(spark):
    df = lines(spark, [
        line(1, "a", "10.005", tags={"team": "x"}), line(2, "b", "30", tags={"team": ""}), line(3, "c", None),
        line(4, "d", "-5", JAN, tags={"team": "x"}), line(5, "e", "1", invoice_id="none", billing_period_start=None)])
    got = {r.invoice_id: r for r in silver.invoices(df).collect()}
    feb = got["INV-2025-02"]
    assert (str(feb.total_billed_cost), feb.total_line_items, str(feb.attributed_cost)) == ("40.01", 3, "10.01")
    assert str(feb.attribution_coverage_pct) == "25.01" and feb.status == "provisional"
    assert float(got["INV-2025-01"].attribution_coverage_pct) == 0 and "none" not in got


def test_resources_sum_groups_and_take_the_costliest(spark):
    df = lines(spark, [
        line(1, "a", 5, region="eu", tags={"team": "old"}), line(2, "a", 9, region="us"),
        line(3, "a", 5, region="eu", tags={"team": "new", "cost_center": "C"}), line(4, "a", 1, region="us", tags=None),
        line(5, "", 3), line(6, None, 3), line(7, "b", None)])
    got = {r.resource_id: r for r in silver.resources(df).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    # Both regions cost 10; the tie goes to the greater attributes.
    assert (float(a.total_cost), a.region, a.team, a.cost_center, a.in_terraform_state, a.iac_source) == (20, "us", "new", "C", False, "none")
    assert float(got["b"].total_cost) == 0


def test_costliest_group_wins(spark):
    df = lines(spark, [line(1, "a", 5, region="eu"), line(2, "a", 6, region="eu"), line(3, "a", 10, region="us")])
    row = silver.resources(df).first()
    assert (row.region, float(row.total_cost)) == ("eu", 21)


def test_lines_travel_to_their_resources_once(spark, monkeypatch):
    df = lines(spark, [
        line(n, "hot" if n % 3 else f"r{n % 4}", n % 5, (JAN, FEB)[n % 2], region=("eu", "us")[n % 2 - n % 4 // 2], charge_type=("Usage", "Tax", None)[n % 3 - n % 2],
             description=("", "a", "b")[n % 3], tags={"team": f"t{n % 4}", "managed_by": ("cdk", "ops")[n % 2]}) for n in range(1, 40)])
    plan = silver.resource_costs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    index = iac.iac_union({"terraform": spark.createDataFrame([(1, "r1", "m", "T", "n")], "ordinal long, identifier string, module string, resource_type string, resource_name string")})
    one = silver.resources(df, index, signals=True)
    matched = one._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in matched.split("\n") if "Exchange hashpartitioning(resource_id" in p and "billing_period_start" in p]
    apart = silver.resources(silver.line_partials(df), index).join(silver.resource_signals(silver.line_partials(df)), ["resource_id", "billing_period_start"]).select(one.columns)
    want = sorted(map(str, apart.collect()))
    assert len(want) > 4 and sorted(map(str, one.collect())) == want
    monkeypatch.setattr(dealing, "HOT_ROWS", 3)
    assert sorted(map(str, silver.resources(df, index, signals=True).collect())) == want


def test_hot_event_ids_keep_their_last_event(spark, monkeypatch):
    e = events(spark, [{"resource_id": "a", "event_date": date(2025, 2, 1 + n % 5), "pr_number": str(n)} for n in range(20)] + [
        {"resource_id": "x:b", "event_date": FEB, "pr_number": "7"}])
    want = sorted(map(str, ev.change_event_match(e).collect()))
    monkeypatch.setattr(dealing, "HOT_ROWS", 3)
    assert len(want) == 3 and sorted(map(str, ev.change_event_match(e).collect())) == want


def test_events_of_ids_that_are_not_billed_are_dropped_before_they_are_dealt(spark, monkeypatch):
    from spendweave.operators import containment

    e = events(spark, [{"resource_id": f"apply/arn:x:{n}", "event_date": FEB, "pr_number": str(n)} for n in range(300)])
    billed = spark.createDataFrame([("arn:x:7",), ("arn:x:7",), ("9",), ("none",), (None,)], "resource_id string")
    dealt_rows = []
    kept = lambda rows, *args: dealt_rows.append(rows.count()) or dealing.dealt(rows, *args)
    monkeypatch.setattr(ev, "dealt", kept)
    want = sorted(map(str, ev.change_event_match(e).join(billed.distinct(), "resource_id").collect()))
    for most in (1_000_000, 0):  # compared by hash, and by slot
        monkeypatch.setattr(containment, "MOST_BROADCAST_GRAMS", most)
        found = ev.change_event_match(e, tasks=3, ids=billed)
        assert found.columns == ev.change_event_match(e).columns
        assert sorted(map(str, found.join(billed.distinct(), "resource_id").collect())) == want and len(want) == 1
    assert [dealt_rows[i] for i in (1, 3)] == [1, 1] and dealt_rows[0] == 600


def test_signals_keep_first_seen_order(spark):
    df = lines(spark, [
        line(3, "a", 1, charge_type="Credit", description="third"), line(1, "a", 1, charge_type="Usage", description=""),
        line(2, "a", 1, charge_type="Tax", description="second"), line(4, "a", 1, charge_type="Usage", tags={"managed_by": "cdk"}),
        line(5, "a", 1, charge_type=None, tags={"managed_by": "ops"}), line(6, "b", 1, charge_type="", tags={})])
    got = {r.resource_id: r for r in silver.resource_signals(df).collect()}
    assert got["a"].charge_types == ["Usage", "Tax", "Credit"]
    assert got["a"].description == "second" and got["a"].other_tool is True
    assert got["b"].charge_types == [] and got["b"].other_tool is None


def test_pairs_and_baselines(spark):
    months = [date(2024, 2, 1), date(2024, 11, 1), date(2025, 1, 1), date(2025, 2, 1)]
    df = resources(spark, [resource("a", 10 * i, m) for i, m in enumerate(months, 1)] + [resource("b", 7, months[2], team="x")])
    pr = pairs.consecutive_pairs(df)
    assert sorted(tuple(r) for r in pr.collect()) == list(zip(months, months[1:]))
    assert pairs.consecutive_pairs(df.where("billing_period_start = '2024-02-01'")).count() == 0
    one = pairs.one_pair(spark, "2025-01", "2025-02")
    rolled = {r.resource_id: r for r in pairs.rolling_baseline(df, one).collect()}
    # November and January are present, December is not.
    assert float(rolled["a"].total_cost) == 25 and float(rolled["b"].total_cost) == 7 and rolled["b"].team == "x"
    assert [tuple(r) for r in pairs.last_year_pairs(one).collect()] == [(date(2024, 2, 1), FEB)]


def test_events_window_short_ids_and_last_one(spark):
    e = events(spark, [
        {"resource_id": "a", "event_date": date(2025, 1, 25), "pr_number": "1"},
        {"resource_id": "repo/a", "event_date": date(2025, 2, 8), "pr_number": "2"},
        {"resource_id": "x:b", "event_date": date(2025, 1, 24), "pr_number": "3"},
        {"resource_id": "x:c", "event_date": date(2025, 2, 1), "pr_number": "4"},
        {"resource_id": "x:c", "event_date": date(2025, 2, 1), "pr_number": "5"},
        {"resource_id": "d:e/f", "event_date": date(2025, 2, 9), "pr_number": "6"},
        {"resource_id": None, "event_date": date(2025, 2, 1)}])
    rows = ev.change_event_match(e).where(F.col("current_period_start") == F.lit(FEB)).collect()
    assert {r.resource_id: r.event.pr_number for r in rows} == {"a": "2", "repo/a": "2", "x:c": "5", "c": "5"}


FILES = [
    ("1", 0, "modules/eks/main.tf", "modified", '+resource "aws_eks_cluster" "main" {\n-resource   "aws_lb" "front" {'),
    ("1", 1, "net.tf", "added", 'module "vpc" {\n}'),
    ("1", 2, "modules/eks/vars.tf", "removed", None),
    ("1", 3, "README.md", "modified", 'resource "a" "b"'),
    ("2", 0, "legacy/db/x.tf", "modified", '+resource "aws_rds_cluster" "nothing-like-it" {'),
    ("3", 0, "q/a.tf", "added", "1"), ("3", 1, "q/b.tf", "added", "1"), ("3", 2, "q/c.tf", "added", "1"), ("3", 3, "q/d.tf", "added", "1"),
]


def changes(spark):
    return ev.tf_diff_changes(spark.createDataFrame(FILES, "pr_number string, file_seq long, filename string, status string, patch string"))


def test_diff_changes(spark):
    rows = {(r.terraform_module, r.action, r.resource_type, r.resource_name) for r in changes(spark).where("pr_number = '1'").collect()}
    assert rows == {
        ("modules/eks", "modified", "aws_eks_cluster", "main"), ("modules/eks", "modified", "aws_lb", "front"),
        ("root", "added", "module", "vpc"), ("modules/eks", "removed", "terraform_file", "modules/eks/vars.tf")}


def test_pr_events(spark):
    prs = spark.createDataFrame(
        [(n, f"t{n}", "me", date(2025, 2, 3), "sha") for n in ("1", "2", "3")],
        "pr_number string, title string, author string, merged_at date, commit_sha string")
    res = resources(spark, [
        resource("r-module", 1, terraform_module="live/modules/eks/prod"), resource("r-name", 1, resource_name="The-FRONT-door"),
        resource("r-type", 1, service_name="Amazon RDS", terraform_module="modules/db"),
        resource("r-type-no", 1, service_name="Amazon S3", terraform_module="modules/db"),
        resource("r-other-month", 1, date(2024, 6, 1), terraform_module="modules/eks")])
    near = ev.pr_periods(prs, res)
    # The window reaches from 30 days before to 31 days after the first of a known month.
    assert {(r.pr_number, r.billing_period_start) for r in near.collect()} == {(n, FEB) for n in "123"}
    out = ev.pr_change_events(near, changes(spark), res).collect()
    got = {(r.pr_number, r.resource_id, r.description) for r in out}
    assert got == {
        ("1", "r-module", "PR #1: t1"), ("1", "r-name", "PR #1: t1"), ("2", "r-type", "PR #2: t2"),
        ("3", "tf:q/q/a.tf", "PR #3: t3 (added terraform_file.q/a.tf)"), ("3", "tf:q/q/b.tf", "PR #3: t3 (added terraform_file.q/b.tf)"),
        ("3", "tf:q/q/c.tf", "PR #3: t3 (added terraform_file.q/c.tf)")}
    assert {r.terraform_module for r in out if r.pr_number == "1"} == {"modules/eks"}


def test_pr_events_are_found_once_and_read_by_small_plans(spark):
    prs = spark.createDataFrame([("1", "t1", "me", FEB, "sha")], "pr_number string, title string, author string, merged_at date, commit_sha string")
    res = resources(spark, [resource("r-module", 1, terraform_module="live/modules/eks/prod")])
    out = ev.pr_change_events(ev.pr_periods(prs, res), changes(spark), res)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Diffs are parsed and texts matched before: the last plan reads their rows.
    assert "regexp_extract_all" not in plan and "sequence" not in plan and plan.count("Join") == 4
    assert [(r.pr_number, r.resource_id) for r in out.collect()] == [("1", "r-module")]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_lines_that_may_be_repeats_are_moved(spark, tmp_path, monkeypatch, most):
    from spendweave.operators import containment
    from spendweave.operators.dedup import dedup_in_place, dedup_new_lines, doubtful_keys

    monkeypatch.setattr(containment, "MOST_BROADCAST_GRAMS", most)
    monkeypatch.setattr(containment, "SLOTS", 128)
    key = ["a", "b"]
    schema = "a string, b string, line_seq long, line_id string"
    df = spark.createDataFrame([(None if n % 9 == 0 else f"k{n % 50}", None if n % 7 == 0 else "x", n, str(n)) for n in range(90)], schema)
    old = spark.createDataFrame([(f"k{n}", "x", n, str(n)) for n in (3, 5, 48, 77)] + [(None, "x", 1, "1"), (None, None, 2, "2")], schema)
    for store in (None, old):
        hashes = doubtful_keys(df, store, key)
        got = dedup_in_place(df, hashes, store, key)
        assert sorted(got.collect(), key=lambda r: r.line_seq) == sorted(dedup_new_lines(df, store, key).collect(), key=lambda r: r.line_seq)
        repeated = {r[0] for r in hashes.collect()}
        assert 0 < len(repeated) < df.select(*key).distinct().count()
        assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # new lines beside those that are compared


def test_logical_resources(spark):
    res = resources(spark, [
        managed("c1", 1, service_name="Amazon EKS", resource_name="Main"), managed("d1", 1, service_name="Amazon Aurora", resource_name="orders"),
        resource("n1", 1, resource_name="main-node"), resource("v1", 1, service_name="Storage", resource_name="main-vol"),
        resource("l1", 1, service_name="Elastic Load", resource_name="main-lb"), resource("g1", 1, service_name="Network", resource_name="nat-main"),
        resource("o1", 1, service_name="S3", resource_name="xmainx"), resource("q1", 1, service_name="RDS", resource_name="orders-replica"),
        resource("q2", 1, service_name="RDS", resource_name="orders-storage"), resource("q3", 1, service_name="EC2", resource_name="orders-app"),
        resource("u1", 1, service_name="Amazon EKS", resource_name="node"), resource("old", 1, JAN, resource_name="main-node")])
    rows = {(r.logical_resource_id, r.child_resource_id): (r.resource_type, r.relationship) for r in logical.logical_resources(res).collect()}
    assert rows == {
        ("c1", "c1"): ("eks_cluster", "cluster"), ("d1", "d1"): ("rds_cluster", "primary"), ("c1", "n1"): ("eks_cluster", "node"),
        ("c1", "v1"): ("eks_cluster", "volume"), ("c1", "l1"): ("eks_cluster", "load_balancer"), ("c1", "g1"): ("eks_cluster", "nat_gateway"),
        ("c1", "o1"): ("eks_cluster", "associated"), ("d1", "q1"): ("rds_cluster", "replica"), ("d1", "q2"): ("rds_cluster", "storage")}


def test_rows_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 10)
    rows = spark.range(300).select((F.col("id") % 50).alias("k"), "id")
    many = dealing.dealt(rows, "k", lambda r: r)
    assert many.rdd.getNumPartitions() == 30 and many.count() == 300
    df = lines(spark, [line(n, f"r{n % 40}", n) for n in range(200)])
    assert silver.resource_costs(df).rdd.getNumPartitions() == 20


def test_slots_of_ngrams_stand_in_for_very_many(spark, monkeypatch):
    from spendweave.operators import containment

    monkeypatch.setattr(containment, "MOST_BROADCAST_GRAMS", 0)
    monkeypatch.setattr(containment, "SLOTS", 128)
    h = spark.createDataFrame([(f"arn:aws:thing/{k:012d}",) for k in range(200)], "h string")
    p = spark.createDataFrame([(f"{k:012d}",) for k in range(0, 400, 3)], "p string")
    found = containment_pairs(h, p, "h", "p")
    assert "hashpartitioning(_gram" not in containment.haystack_grams(
        h.withColumnRenamed("h", "_hay"), F.array(F.lit(8)), p.select(F.xxhash64("p").alias("_gram")))._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert {tuple(r) for r in found.collect()} == {(f"arn:aws:thing/{k:012d}", f"{k:012d}") for k in range(0, 200, 3)}


def test_pairs_of_bucketed_resources_meet_where_they_lie(spark, tmp_path):
    from spendweave.plans.variance import paired_sides
    from spendweave.sources.sinks import write_bucketed

    df = resources(spark, [resource(f"r{k}", k + m, (JAN, FEB, MAR)[m]) for k in range(30) for m in range(3) if (k + m) % 4])
    e = events(spark, [{"resource_id": f"r{k}", "event_date": FEB, "pr_number": str(k)} for k in range(0, 30, 2)])
    months = pairs.consecutive_pairs(silver.billing_periods(df))
    want = pairs.variance_pairs(pairs.side(df, months, "prior_period_start"), pairs.side(df, months, "current_period_start"), months)
    matched = ev.change_event_match(e, tasks=6)
    want = want.join(matched, pairs.SIDE_KEY, "left").select("resource_id", "prior_period_start", "current_period_start", "p", "c", "event")
    table = write_bucketed(df.repartition(6, "resource_id"), str(tmp_path / "t"), "resource_id", 6)
    got = paired_sides(table, months, events=matched, by_resource=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(resource_id") == 1  # the events
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = got.select("resource_id", "prior_period_start", "current_period_start", F.col("p").dropFields("event").alias("p"),
                     F.col("c").dropFields("event").alias("c"), F.coalesce("p.event", "c.event").alias("event"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 40


def test_rolling_baselines_of_bucketed_resources_meet_where_they_lie(spark, tmp_path):
    from spendweave.plans.variance import paired_sides
    from spendweave.sources.sinks import write_bucketed

    rows = [resource(f"r{k}", k + 7 * m, date(2025, m, 1), team=f"t{m}") for k in range(30) for m in range(1, 7) if (k + m) % 4 and (k * m) % 3]
    df = resources(spark, rows)
    months = pairs.consecutive_pairs(silver.billing_periods(df))
    table = write_bucketed(df.repartition(6, "resource_id"), str(tmp_path / "t"), "resource_id", 6)
    got, want = paired_sides(table, months, "rolling_3m", by_resource=True), paired_sides(df, months, "rolling_3m")
    assert "Exchange hashpartitioning(resource_id" not in got._jdf.queryExecution().executedPlan().toString()
    cells = ["resource_id", *pairs.PAIR, "p", "c"]
    assert got.select("p", "c").dtypes == want.select("p", "c").dtypes
    assert sorted(map(str, got.select(cells).collect())) == sorted(map(str, want.select(cells).collect())) and got.count() > 50
