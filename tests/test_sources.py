"""File readers: billing CSV, IaC state, cost pages, pull requests, documents."""

import json
from datetime import date


from spendweave.functions import codes
from spendweave.sources import billing, cost_pages, documents, iac_files, pull_requests

FOCUS = ("InvoiceId,BillingPeriodStart,BillingPeriodEnd,ChargePeriodStart,ChargePeriodEnd,ServiceName,ServiceCategory,"
         "ResourceId,ResourceName,Region,AvailabilityZone,ChargeType,ChargeDescription,Quantity,Unit,UnitPrice,BilledCost,"
         "ListCost,EffectiveCost,Tags")
ROW = ('INV-001,2025-01-01,2025-01-31,2025-01-01T00:00:00,2025-01-31T00:00:00,Amazon EC2,Compute,'
       'arn:aws:ec2:us-east-1:1:instance/{rid},{rid},us-east-1,us-east-1a,Usage,EC2 running hours,744,Hrs,0.10,{cost},78.12,74.40,"{tags}"')
TAGS = '{""team"": ""backend"", ""env"": ""prod""}'


def write(folder, name, *rows):
    path = folder / name
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_focus_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", FOCUS, ROW.format(rid="i-1", cost="74.40", tags=TAGS))
    row = billing.scan_focus_csv(spark, path).first()
    assert row.tags == {"team": "backend", "env": "prod"}
    assert (str(row.billed_cost), str(row.unit_price), row.provider) == ("74.400000", "0.1000000000", "AWS")
    assert row.billing_period_start == date(2025, 1, 1) and row.charge_period_end.day == 31
    assert row.description == "EC2 running hours"


def test_duplicates_and_reingest(spark, tmp_path):
    path = write(tmp_path, "a.csv", FOCUS, *[ROW.format(rid=r, cost=c, tags=TAGS) for r, c in (("i-1", "1"), ("i-1", "2"), ("i-2", "3"))])
    loaded = billing.load_export(spark, path)
    first = billing.ingest(loaded)
    assert {(r.resource_name, int(r.billed_cost)) for r in first.collect()} == {("i-1", 1), ("i-2", 3)}
    stats = billing.load_stats(loaded).first()
    assert (stats.rows_read, stats.rows_inserted, stats.rows_skipped, stats.errors) == (3, 2, 1, 0)
    again = billing.load_stats(loaded, first).first()
    assert (again.rows_inserted, again.rows_skipped) == (0, 3)
    assert billing.ingest(loaded, first).count() == 0


def test_null_keys_do_not_reload(spark, tmp_path):
    header = "InvoiceId,ResourceId,ChargePeriodStart,BilledCost"
    path = write(tmp_path, "a.csv", header, ",,,5", ",,,6", "I,,,7")
    loaded = billing.load_export(spark, path)
    first = billing.ingest(loaded)
    assert sorted(int(r.billed_cost) for r in first.collect()) == [5, 7]
    assert billing.ingest(loaded, first).count() == 0


def test_missing_columns_and_header_only(spark, tmp_path):
    path = write(tmp_path, "a.csv", "InvoiceId,ServiceName,ResourceId,BilledCost", "I1,EC2,r1,10")
    row = billing.scan_focus_csv(spark, path).first()
    assert row.tags is None and row.billing_period_start is None and int(row.billed_cost) == 10
    empty = write(tmp_path, "b.csv", FOCUS)
    assert billing.scan_focus_csv(spark, empty).count() == 0


def test_bad_cells(spark, tmp_path):
    path = write(
        tmp_path, "a.csv", "InvoiceId,ResourceId,BillingPeriodStart,BilledCost,Tags",
        "I1,r1,2025-01-01,abc,{}", "I2,r2,soon,4,not json", 'I3,r3,2025-01-01,1e-3,"[1]"', "I4,r4,2025-01-01,NaN,")
    loaded = billing.load_export(spark, path)
    rejected = loaded.rejects.collect()
    assert [(r.invoice_id, r._rejected) for r in rejected] == [("I1", ["billed_cost"])]
    kept = {r.invoice_id: r for r in loaded.lines.collect()}
    assert kept["I2"].billing_period_start is None and kept["I2"].tags is None
    assert str(kept["I3"].billed_cost) == "0.001000" and kept["I3"].tags is None
    assert kept["I4"].billed_cost is None
    assert billing.load_stats(loaded).first().errors == 1


def test_azure_csv_and_detection(spark, tmp_path):
    header = ("InvoiceId,BillingPeriodStartDate,BillingPeriodEndDate,Date,MeterCategory,ResourceId,ResourceLocation,"
              "CostInBillingCurrency,Tags")
    rid = "/subscriptions/s/resourceGroups/g/providers/Microsoft.Web/sites/app"
    path = write(tmp_path, "a.csv", header, f"I1,01/01/2025,1/31/2025,01/05/2025,microsoft.web/sites,{rid},westeurope,12.5,")
    assert billing.detect_format(billing.read_csv(spark, path).columns) == (codes.AZURE_HEADERS, "Azure")
    for row in (billing.scan_azure_csv(spark, path).first(), billing.scan_focus_csv(spark, path).first()):
        assert (row.service_name, row.provider, row.region, str(row.billed_cost)) == ("App Service", "Azure", "westeurope", "12.500000")
        assert row.billing_period_start == date(2025, 1, 1) and row.charge_period_start.day == 5
    assert billing.detect_format(["Foo", "Bar"])[1] == "AWS"


def test_first_header_wins(spark):
    df = spark.createDataFrame([("second", "first")], "ChargeDescription string, Description string")
    assert billing.map_columns(df, codes.FOCUS_HEADERS).first().description == "first"


def test_file_order_decides(spark, tmp_path):
    rows = [ROW.format(rid=f"i-{i % 50}", cost=str(i), tags="") for i in range(1, 4001)]
    path = write(tmp_path, "big.csv", FOCUS, *rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        kept = billing.ingest(billing.load_export(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r.billed_cost) for r in kept) == list(range(1, 51))


def test_files_of_one_load_are_bound_by_their_own_headers(spark, tmp_path):
    put_lines = lambda name, *rows: write(tmp_path, name, *rows)
    put_lines("1 a[x].csv", "InvoiceId,ResourceId,BilledCost,Description", 'I1,r1,1,"two\nlines, ""quoted"""', "I1,r2,x,")
    put_lines("2.csv", "\ufeffResourceId,InvoiceId,BilledCost,InvoiceId", "r2,I2,2,other")
    put_lines("3.csv", "InvoiceId,MeterCategory,ResourceId,CostInBillingCurrency", "I3,Storage,r3,3")
    put_lines("4.csv", "ResourceId,BilledCost")
    (tmp_path / "5.csv").write_text("")
    loaded = billing.load_export(spark, str(tmp_path))
    got = {(r.invoice_id, r.resource_id, int(r.billed_cost), r.provider, r.description) for r in loaded.lines.collect()}
    assert got == {("I1", "r1", 1, "AWS", 'two\nlines, "quoted"'), ("I2", "r2", 2, "AWS", None), ("I3", "r3", 3, "Azure", None)}
    assert [r.resource_id for r in loaded.lines.orderBy("line_seq").collect()] == ["r1", "r2", "r3"]
    (cell,) = billing.ingest_rejects(loaded).collect()
    assert (cell.invoice_id, cell.resource_id, cell["cell"], cell.text, cell.reason) == ("I1", "r2", "billed_cost", "x", "not a decimal(18,6)")
    assert "1 a[x].csv" in cell.line_id.replace("%20", " ").replace("%5B", "[").replace("%5D", "]")
    assert len(billing.first_records(spark, str(tmp_path))) == 4
    counts = billing.load_into(loaded, str(tmp_path / "table"))
    assert counts == {"rows_read": 4, "rows_inserted": 3, "rows_skipped": 0, "errors": 1} == billing.load_stats(loaded).first().asDict()
    again = billing.load_into(loaded, str(tmp_path / "table"), spark.read.parquet(str(tmp_path / "table")))
    assert again == {"rows_read": 4, "rows_inserted": 0, "rows_skipped": 3, "errors": 1}
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    (tmp_path / "none").mkdir()
    write(tmp_path / "none", "a.csv", "")
    assert billing.load_export(spark, str(tmp_path / "none")).rows.count() == 0


def test_kept_lines_do_not_depend_on_packing(spark, tmp_path):
    for n in range(6):
        rows = [ROW.format(rid=f"i-{i % 30}", cost=str(1000 * n + i), tags="") for i in range(1, 400 + 200 * (n % 3))]
        write(tmp_path, f"f{n}.csv", FOCUS, *rows)
    kept = []
    for size, open_cost in (("134217728", "0"), ("20000", "0"), ("134217728", "134217728")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        try:
            for multi_line in (True, False):
                loaded = billing.load_export(spark, str(tmp_path), multi_line=multi_line)
                kept.append(sorted((r.resource_name, int(r.billed_cost)) for r in billing.ingest(loaded).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert kept[0] == sorted((f"i-{i % 30}", i) for i in range(1, 31)) and all(k == kept[0] for k in kept)


def found(df):
    return {(r.identifier, r.module, r.resource_type, r.resource_name) for r in df.collect()}


def put(folder, name, doc):
    path = folder / name
    path.write_text(json.dumps(doc, indent=2))
    return str(path)


def test_tfstate(spark, tmp_path):
    path = put(tmp_path, "s.tfstate", {"version": 4, "resources": [
        {"module": "modules/web", "type": "aws_instance", "name": "web", "instances": [
            {"attributes": {"id": "i-1", "arn": "arn:1", "dns_resource_id": "r-9", "other_resource_id": 7,
                            "list_resource_id": ["x"], "size": 3, "null_resource_id": None, "tags": {"a": "b"}}}]},
        {"instances": [{"attributes": {"id": "i-2", "arn": ""}}, {"attributes": {}}]}, {"type": "none"}]})
    assert found(iac_files.scan_tfstate(spark, path)) == {
        ("i-1", "modules/web", "aws_instance", "web"), ("arn:1", "modules/web", "aws_instance", "web"),
        ("r-9", "modules/web", "aws_instance", "web"), ("i-2", "root", "unknown", "unknown")}


def test_arm_cloudformation_pulumi(spark, tmp_path):
    arm = put(tmp_path, "arm.json", {"resources": [
        {"id": "/s/vm", "type": "T/vm", "name": "vm"}, {"name": "disk", "type": "T/disk"}, {"type": "T/none"}]})
    assert found(iac_files.scan_arm(spark, arm)) == {
        ("/s/vm", "T/vm", "T/vm", "vm"), ("vm", "T/vm", "T/vm", "vm"), ("disk", "T/disk", "T/disk", "disk"),
        ("unknown", "T/none", "T/none", "unknown")}
    cfn = put(tmp_path, "cfn.json", {"Resources": {
        "A": {"Type": "AWS::Lambda", "Properties": {"FunctionName": "fn"}}, "B": {"Type": "AWS::S3", "Properties": {"BucketName": "bk"}},
        "C": {}}})
    assert found(iac_files.scan_cloudformation(spark, cfn)) == {
        ("A", "cloudformation", "AWS::Lambda", "fn"), ("B", "cloudformation", "AWS::S3", "bk"), ("C", "cloudformation", "unknown", "C")}
    rows = [{"type": "t", "urn": "urn::x::web", "id": "i-1", "outputs": {"arn": "arn:1"}},
            {"type": "t", "urn": "urn::x::db", "outputs": {"name": "named"}},
            {"type": "t", "id": "i-3", "outputs": {"name": "lost"}}, {"type": "t"}]
    want = {("i-1", "pulumi", "t", "web"), ("arn:1", "pulumi", "t", "web"), ("urn::x::db", "pulumi", "t", "named"),
            ("i-3", "pulumi", "t", "unknown")}
    assert found(iac_files.scan_pulumi(spark, put(tmp_path, "p1.json", {"deployment": {"resources": rows}}))) == want
    assert found(iac_files.scan_pulumi(spark, put(tmp_path, "p2.json", {"resources": rows}))) == want


def test_aws_pages(spark, tmp_path):
    def group(service, rid, amount):
        keys = [service] if rid is None else [service, rid]
        return {"Keys": keys, "Metrics": {"UnblendedCost": {"Amount": amount}}}

    page = {"ResultsByTime": [{"TimePeriod": {"Start": "2025-01-01", "End": "2025-01-31"}, "Groups": [
        group("Amazon EC2", "arn:aws:ec2:instance/i-1", "10.5"), group("Amazon RDS", "arn:aws:rds:db-1", "2"),
        group("AWS Cost Explorer", "", "1"), group("Tax", None, "3"), group("S3", "b", "0.0")]}]}
    path = put(tmp_path, "p.json", page)
    rows = cost_pages.flatten_aws_cost_pages(cost_pages.read_pages(spark, path, cost_pages.AWS_PAGE, True)).collect()
    assert {(r.resource_id, r.resource_name, str(r.billed_cost)) for r in rows} == {
        ("arn:aws:ec2:instance/i-1", "i-1", "10.500000"), ("arn:aws:rds:db-1", "db-1", "2.000000"),
        ("aws-cost-explorer-aggregate", "aws-cost-explorer-aggregate", "1.000000"), ("tax-aggregate", "tax-aggregate", "3.000000")}
    assert {r.invoice_id for r in rows} == {"AWS-2025-01"}


def test_azure_pages(spark, tmp_path):
    page = {"period_start": "2025-02-01", "period_end": "2025-02-28", "properties": {
        "columns": [{"name": n} for n in ("Cost", "PreTaxCost", "ResourceId", "ResourceType")],
        "rows": [[5, None, "/s/p/vm1", "Microsoft.Compute/virtualMachines"], [0, 7, "", "Microsoft.Web/sites"],
                 ["bad", 1, "x", "t"], [0, 0, "y", "t"], [2, None, "z"], [3]], "nextLink": None}}
    path = put(tmp_path, "p.json", page)
    rows = cost_pages.flatten_azure_cost_pages(cost_pages.read_pages(spark, path, cost_pages.AZURE_PAGE, True)).collect()
    assert {(r.resource_id, r.resource_name, r.service_name, int(r.billed_cost)) for r in rows} == {
        ("/s/p/vm1", "vm1", "Virtual Machines", 5), ("azure-microsoft.web-sites-aggregate",) * 2 + ("Sites", 7),
        ("z", "z", "", 2), ("azure-subscription-aggregate", "azure-subscription-aggregate", "", 3)}
    assert rows[0].invoice_id == "AZ-2025-02"


def test_pull_request_export(spark, tmp_path):
    def pr(n, merged, *files):
        return {"number": n, "title": f"t{n}", "merged_at": merged, "user": {"login": "a"},
                "files": [{"filename": f, "status": "modified", "patch": ""} for f in files]}

    path = tmp_path / "prs.jsonl"
    path.write_text("\n".join(json.dumps(p) for p in (
        pr(1, "2025-01-15T10:00:00Z", "a.tf", "b.md"), pr(2, None, "a.tf"), pr(3, "2025-01-15T10:00:00Z", "x.py"),
        pr(4, "2024-11-01T00:00:00Z", "a.tf"), pr(5, "2025-03-09T23:59:00Z", "c/d.tf"))))
    prs = pull_requests.scan_pr_events(spark, str(path), date(2025, 1, 1), date(2025, 3, 9))
    assert {(r.pr_number, str(r.merged_at)) for r in prs.collect()} == {("1", "2025-01-15"), ("5", "2025-03-09")}
    assert {(r.pr_number, r.filename) for r in pull_requests.pr_files(prs).collect()} == {("1", "a.tf"), ("5", "c/d.tf")}


def test_docs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\nline")
    (tmp_path / "sub" / "b.md").write_text(" \n \n")
    (tmp_path / "c.txt").write_text("no")
    got = {r.source: (r.text, r.blank) for r in documents.scan_docs(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# A\nline", False), "sub/b.md": (" \n \n", True)}


def test_iac_order_does_not_depend_on_packing(spark, tmp_path):
    for n in range(5):
        put(tmp_path, f"t{n}.json", {"resources": [{"id": f"id-{n}-{k}", "type": "T", "name": f"n{n}"} for k in range(4)]})
    (tmp_path / "lines").mkdir()
    docs = [json.dumps({"resources": [{"id": f"l-{n}", "type": "T", "name": f"l-{n}"}]}) for n in range(400)]
    (tmp_path / "lines" / "a.json").write_text("\n".join(docs))
    (tmp_path / "lines" / "b.json").write_text("\n".join(docs[:100]).replace("l-", "m-"))
    for size, cost in (("134217728", "4194304"), ("3000", "0"), ("134217728", "134217728")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            order = [r.identifier for r in iac_files.scan_arm(spark, str(tmp_path / "t*.json")).orderBy("ordinal").collect()]
            lined = [r.identifier for r in iac_files.scan_arm(spark, str(tmp_path / "lines"), multi_line=False).orderBy("ordinal").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [i for i in order if i.startswith("id")] == [f"id-{n}-{k}" for n in range(5) for k in range(4)]
        assert lined == [f"l-{n}" for n in range(400)] + [f"m-{n}" for n in range(100)]


def test_document_records(spark, tmp_path):
    rows = [{"source": "a.md", "text": "# A\nline"}, {"text": " \n"}, {"source": "c.md"}, {"text": "x"}]
    (tmp_path / "docs.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    got = documents.scan_doc_records(spark, str(tmp_path)).collect()
    assert [(r.text, r.blank) for r in got] == [("# A\nline", False), (" \n", True), ("", True), ("x", False)]
    assert got[0].source == "a.md" and got[2].source == "c.md" and len({r.source for r in got}) == 4
