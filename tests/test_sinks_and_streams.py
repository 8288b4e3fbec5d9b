"""Sinks that replace partitions, and the incremental ingest."""

import gzip
from datetime import date

import pytest
from helpers import FEB, JAN, MAR, line, lines, managed, resource, resources
from pyspark.sql import functions as F

from spendweave import session
from spendweave.sources import sinks
from spendweave.streaming.ingest import incremental_ingest, ledger, load_batch, quarantine_of, rejects_of, stored_keys, touched_periods

HEADER = "InvoiceId,ResourceId,BillingPeriodStart,ChargePeriodStart,BilledCost"
HEADERS = {"InvoiceId": "invoice_id", "ResourceId": "resource_id", "BillingPeriodStart": "billing_period_start",
           "ChargePeriodStart": "charge_period_start", "BilledCost": "billed_cost"}


def test_export_keeps_other_periods_and_false(spark, tmp_path):
    root = str(tmp_path)
    rows = resources(spark, [resource("a", 0, JAN), managed("b", 2, JAN), resource("c", 3, FEB)])
    sinks.export_period_tables({"resources": (rows, "billing_period_start")}, root)
    sinks.export_period_tables({"resources": (rows.withColumn("team", F.lit("new")), "billing_period_start")}, root, FEB)
    got = {r.resource_id: (r.in_terraform_state, float(r.total_cost), r.team) for r in sinks.read_table(spark, f"{root}/resources").collect()}
    assert got == {"a": (False, 0.0, None), "b": (True, 2.0, None), "c": (False, 3.0, "new")}


def test_tenant_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    bill = lines(spark, [line(1, "a", 1), line(2, "b", 2)]).select("line_id", "billed_cost")
    sinks.replace_tenant(bill, path, 1)
    sinks.replace_tenant(bill, path, 2)
    sinks.replace_tenant(bill.where("line_id = 'l1'"), path, 1)
    sinks.replace_tenant(bill.where("line_id = 'l1'"), path, 1)
    got = {r.user_id: r["count"] for r in sinks.read_table(spark, path).groupBy("user_id").count().collect()}
    assert got == {1: 1, 2: 2}


def test_replacing_by_nothing_empties(spark, tmp_path):
    path, rows = str(tmp_path / "r"), resources(spark, [resource("a", 1, JAN), resource("b", 2, FEB), resource("c", 3, MAR)])
    sinks.replace_periods(rows, path)
    sinks.replace_periods(rows.where("resource_id = 'b'").withColumn("team", F.lit("new")), path, [FEB, MAR, date(2020, 1, 1)])
    for _ in range(2):
        assert {(r.resource_id, r.team) for r in sinks.read_table(spark, path).collect()} == {("a", None), ("b", "new")}
        sinks.replace_periods(rows.limit(0), path, [MAR])
    bill = lines(spark, [line(n, "a", n, user_id=n % 3 + 1) for n in range(9)]).select("user_id", "line_id")
    sinks.replace_tenants(bill, str(tmp_path / "t"), [1, 2, 3])
    sinks.replace_tenants(bill.where("line_id in ('l0', 'l1')"), str(tmp_path / "t"), [1, 3])
    got = sorted((r.user_id, r.line_id) for r in sinks.read_table(spark, str(tmp_path / "t")).collect())
    assert got == [(1, "l0"), (2, "l1"), (2, "l4"), (2, "l7")]
    pairs = spark.createDataFrame([(JAN, FEB, "a"), (FEB, MAR, "b"), (None, MAR, "c")], "prior_period_start date, current_period_start date, resource_id string")
    sinks.replace_period_pair(pairs, str(tmp_path / "p"))
    sinks.replace_period_pair(pairs.limit(0), str(tmp_path / "p"), [(JAN, FEB), (None, MAR)])
    assert [r.resource_id for r in sinks.read_table(spark, str(tmp_path / "p")).collect()] == ["b"]
    sinks.replace_pr_events(rows.limit(0), path, [JAN, FEB])
    assert not [f for f in (tmp_path / "r").rglob("*.parquet")] and not list((tmp_path / "r").glob("_staged*"))
    with pytest.raises(TypeError):
        sinks.replace_partitions(rows, path, ["resource_id"], [("a",)])


def test_stored_rows_are_replaced_where_they_lie(spark, tmp_path):
    """No row is moved, few tasks write, and the table is the same as when rows move."""
    expr = F.expr
    ids = spark.range(0, 4000, 1, 8).select(
        expr("concat('r', id)").alias("resource_id"), expr("if(id % 50 = 0, null, add_months(date'2025-01-01', int(id % 30)))").alias("current_period_start"),
        expr("date'2024-12-01'").alias("prior_period_start"), expr("id % 3 = 0").alias("in_terraform_state"))
    ids.write.parquet(str(tmp_path / "given"))
    rows = spark.read.parquet(str(tmp_path / "given"))
    moved, lying = str(tmp_path / "moved"), str(tmp_path / "lying")
    sinks.replace_period_pair(rows, moved)
    files, count, scanned = [], rows.count(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    for most in (count, count // 2):
        sinks.WRITE_ROWS, before = most, sinks.WRITE_ROWS
        try:
            sinks.replace_partitions(rows, lying, sinks.PAIR, [], in_place=True)
        finally:
            sinks.WRITE_ROWS = before
        files.append(len(list((tmp_path / "lying").rglob("*.parquet"))))
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == scanned
        got, want = (sorted(map(str, sinks.read_table(spark, p).collect())) for p in (lying, moved))
        assert got == want and len(got) == 4000
    assert files == [31, 62]  # 30 months and the rows without one, by one task and by two
    # Rows of a single period, or of none any more, replace that period alone.
    sinks.export_period_tables({"pairs": (rows, "current_period_start")}, str(tmp_path), in_place=True)
    sinks.export_period_tables({"pairs": (rows.limit(0), "current_period_start")}, str(tmp_path), date(2025, 2, 1), in_place=True)
    left = sinks.read_table(spark, str(tmp_path / "pairs"))
    assert left.count() == rows.where("current_period_start is null or current_period_start <> date'2025-02-01'").count()


def put(folder, name, *rows):
    (folder / name).write_text("\n".join((HEADER,) + rows) + "\n")


def test_incremental_ingest(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    run = lambda: incremental_ingest(spark, str(landing), table, state, HEADERS)
    put(landing, "a.csv", "I1,r1,2025-01-01,2025-01-03,5", "I1,r1,2025-01-01,2025-01-03,6", "I1,r2,2025-01-01,2025-01-03,bad")
    run()
    run()
    assert [(r.resource_id, int(r.billed_cost), r.provider) for r in sinks.read_table(spark, table).collect()] == [("r1", 5, "AWS")]
    assert [(r.resource_id, r["cell"], r.text) for r in sinks.read_table(spark, rejects_of(table)).collect()] == [("r2", "billed_cost", "bad")]
    # A later file brings a repeat, a late line of January and a new month.
    put(landing, "b.csv", "I1,r1,2025-01-01,2025-01-03,7", "I1,r3,2025-01-01,2025-01-09,8", "I2,r1,2025-02-01,2025-02-03,9")
    run()
    rows = sinks.read_table(spark, table)
    assert sorted(int(r.billed_cost) for r in rows.collect()) == [5, 8, 9]
    newest = rows.agg(F.max("ingest_batch")).first()[0]
    assert {r[0] for r in touched_periods(spark, table, newest).collect()} == {JAN, FEB}


def test_a_batch_leaves_nothing_aside_and_reads_compressed_files(spark, tmp_path, monkeypatch):
    landing, aside = tmp_path / "landing", tmp_path / "aside"
    landing.mkdir()
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(aside))
    text = "\n".join((HEADER, "I1,r1,2025-01-01,2025-01-03,5", "I1,r1,2025-01-01,2025-01-03,6", "I1,r2,,2025-01-03,7")) + "\n"
    (landing / "a.csv.gz").write_bytes(gzip.compress(text.encode()))
    table = str(tmp_path / "table")
    incremental_ingest(spark, str(landing), table, str(tmp_path / "state"), HEADERS)
    assert sorted(int(r.billed_cost) for r in sinks.read_table(spark, table).collect()) == [5, 7]
    row = ledger(spark, table).first()
    assert (row.rows_read, row.rows_inserted, row.rows_skipped, row.periods) == (3, 2, 1, [None, JAN])
    assert not list(aside.rglob("*.parquet"))


def test_journal_may_be_compressed(spark, tmp_path):
    journal = spark.createDataFrame([("a,b", "1.50"), ('say "x"', "2")], "account string, debit string")
    sinks.write_gl_csv(journal, str(tmp_path / "j"), "gzip")
    assert list((tmp_path / "j").glob("*.csv.gz")) and not list((tmp_path / "j").glob("*.csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "j")).collect()) == sorted(journal.collect())


def test_repeated_batch_leaves_the_same_table(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table = str(tmp_path / "table")
    put(landing, "a.csv", "I1,r1,2025-01-01,2025-01-03,5", "I1,r2,2025-01-01,2025-01-03,6")
    for attempt in ("s1", "s2"):
        # A lost checkpoint replays the first batch under its old number.
        incremental_ingest(spark, str(landing), table, str(tmp_path / attempt), HEADERS)
        assert sinks.read_table(spark, table).count() == 2
    assert date(2025, 1, 1) in {r.billing_period_start for r in sinks.read_table(spark, table).collect()}


def test_other_headers_and_alien_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    swapped = "ResourceId,InvoiceId," + HEADER.split(",", 2)[2]
    (landing / "a.csv").write_text(f"{swapped}\nr1,I1,2025-01-01,2025-01-03,5\nr2,I1,2025-02-01,2025-02-03,x\n")
    (landing / "b.csv").write_text("Foo,Bar\n1,2\n")
    incremental_ingest(spark, str(landing), table, state)
    assert [(r.invoice_id, r.resource_id) for r in sinks.read_table(spark, table).collect()] == [("I1", "r1")]
    (alien,) = sinks.read_table(spark, quarantine_of(table)).collect()
    assert alien.file.endswith("b.csv") and alien.header == ["Foo", "Bar"]
    put(landing, "c.csv", "I1,r1,2025-01-01,2025-01-03,5", "I1,r9,2025-03-01,2025-03-03,5")
    incremental_ingest(spark, str(landing), table, state)
    first, second = ledger(spark, table).orderBy("ingest_batch").collect()
    assert (first.rows_read, first.rows_inserted, first.rows_skipped, first.errors, len(first.quarantined), first.periods) == (2, 1, 0, 1, 1, [JAN])
    assert (second.rows_read, second.rows_inserted, second.rows_skipped, second.errors, second.periods) == (2, 1, 1, 0, [MAR])
    assert len(first.files) == 2 and second.files[0].endswith("c.csv")


def test_a_batch_reads_the_keys_of_its_months_alone(spark, tmp_path):
    files = []
    for name, day in (("a", "2025-01-03"), ("b", "2025-02-03"), ("c", "")):
        put(tmp_path, f"{name}.csv", f"I1,r1,2025-01-01,{day},5")
        files.append(str(tmp_path / f"{name}.csv"))
    table = str(tmp_path / "table")
    for batch, file in enumerate(files):
        load_batch(spark, [file], table, batch, None, "auto")
    asked = lines(spark, [line(1, "r1", 1)]).withColumn("charge_period_start", F.lit("2025-02-09").cast("timestamp_ntz"))
    keys = stored_keys(spark, table, asked, 7)
    assert [str(r.charge_period_start)[:10] for r in keys.collect()] == ["2025-02-03"]
    assert "PartitionFilters: [" in keys._jdf.queryExecution().toString() and "charge_month" in keys._jdf.queryExecution().toString()
    assert keys.inputFiles() and stored_keys(spark, table, asked, 1).count() == 0
    empty = asked.withColumn("charge_period_start", F.lit(None).cast("timestamp_ntz"))
    assert stored_keys(spark, table, empty, 7).count() == 1
    load_batch(spark, files, table, 1, None, "auto")  # a batch number that comes back with other files
    assert sinks.read_table(spark, table).count() == 3 and ledger(spark, table).count() == 3
