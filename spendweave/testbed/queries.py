"""One query per operator over the given tables.

Report queries read the gold tables, which are built from the given tables on first use in a
session; operators of the earlier layers start from the given tables every time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendweave.functions import codes, rules, text
from spendweave.functions.numbers import period_label, places, rounded
from spendweave.operators import events as ev
from spendweave.operators import pairs as pr
from spendweave.operators import silver
from spendweave.operators.dedup import dedup_new_lines
from spendweave.operators.iac import iac_match_exact, iac_match_fuzzy, iac_union
from spendweave.operators.logical import logical_resources
from spendweave.plans import allocation, forecast, marts, publish, quality, reports, star, tenants
from spendweave.plans import variance as var
from spendweave.schemas import PAIR, RESOURCE_KEY
from spendweave.session import new_dir, stored
from spendweave.sources import billing, cost_pages, documents, iac_files, pull_requests, sinks
from spendweave.streaming.ingest import incremental_ingest, ledger
from spendweave.testbed import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD = "billing_period_start"
# The re-delivery the dedup queries replay: the store ends where the year 1998 starts, and the new
# export reaches back half a year.
STORE_END = date(1998, 1, 1)
EXPORT_START = date(1997, 7, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: doubles for decimals, bigint for integers, text for arrays."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


# -- billing exports ----------------------------------------------------------------------------------


def _export(
    lines: DataFrame, headers: dict[str, str], skip: tuple[str, ...] = (), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Lines under the headers of an export, all text; the first header of a column is used."""
    by_column: dict[str, str] = {}
    for header, column in headers.items():
        by_column.setdefault(column, header)
    cells = []
    for column, header in by_column.items():
        if column in lines.columns and column not in skip:
            value = F.to_json(column) if column == "tags" else F.col(column).cast("string")
            cells.append(value.alias(header))
    return lines.select(*keep, *cells)


def _land_csv(export: DataFrame, purpose: str) -> str:
    path = new_dir(export.sparkSession, purpose)
    export.write.option("header", True).option("escape", '"').csv(path)
    return path


LINE_VIEW = [
    "invoice_id", PERIOD, "billing_period_end", "charge_period_start", "service_name", "service_category",
    "resource_id", "resource_name", "region", "charge_type", "description", "quantity", "unit_price", "billed_cost",
    "list_cost", "provider",
]


def _line_view(lines: DataFrame) -> DataFrame:
    return lines.select(
        *LINE_VIEW, F.col("tags")["team"].alias("team"), F.col("tags")["environment"].alias("env")
    )


def _azure_lines(spark, sf):
    """Lines re-keyed to ARM ids without a service name, dated as Azure writes dates."""
    ids = t._mapped(spark, sf, t.mapping.AZURE_RESOURCES).select("p_partkey", F.col("resource_id").alias("_arm"))
    lines = t.billing_lines(spark, sf).withColumn("p_partkey", F.split("line_id", "-")[1].cast("bigint"))
    day = lambda c: F.date_format(c, "M/d/yyyy")
    return (
        lines.join(ids, "p_partkey")
        .withColumn("resource_id", F.col("_arm"))
        .withColumn("service_name", F.lit(None).cast("string"))
        .withColumn(PERIOD, day(PERIOD))
        .withColumn("billing_period_end", day("billing_period_end"))
        .withColumn("charge_period_start", day("charge_period_start"))
    )


@query
def scan_azure_csv(spark, sf):
    path = _land_csv(_export(_azure_lines(spark, sf), codes.AZURE_HEADERS), "azure")
    return _line_view(billing.scan_azure_csv(spark, path))


def _mixed_folder(spark, sf):
    """One folder with the exports of three tenants: FOCUS, FOCUS with its columns in reverse, Azure. Spot lines have a break in a cell."""
    path = new_dir(spark, "mixed")
    spot = F.startswith("description", F.lit("Spot"))
    broken = F.when(spot, F.concat("description", F.lit('\nbilled "as is", per hour'))).otherwise(F.col("description"))
    lines = t.billing_lines(spark, sf).withColumn("description", broken)
    focus = _export(lines, codes.FOCUS_HEADERS, keep=("user_id",))
    columns = focus.drop("user_id").columns
    azure = _azure_lines(spark, sf).where("user_id = 3").withColumn("description", broken)
    for rows in (focus.where("user_id = 1").select(columns), focus.where("user_id = 2").select(columns[::-1]), _export(azure, codes.AZURE_HEADERS)):
        rows.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return path


@query
def scan_focus_csv(spark, sf):
    return _line_view(billing.scan_focus_csv(spark, _mixed_folder(spark, sf)))


@query
def detect_format(spark, sf):
    """Files of one folder by the format that each one's header shows, with the rows behind them."""
    files: dict[tuple[str, ...], list[str]] = {}
    for file, header in billing.first_records(spark, _mixed_folder(spark, sf)):
        files.setdefault(header, []).append(file)
    found = None
    for header, names in files.items():
        provider = billing.detect_format(list(header))[1]
        rows = billing.read_csv(spark, [billing.as_path(n) for n in names], header).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(header[0]).alias("first_column"), F.lit(provider).alias("provider"), "rows"
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _raw_focus(spark, sf):
    """FOCUS columns with both description headers, without the availability zone."""
    lines = t.billing_lines(spark, sf)
    raw = _export(lines, codes.FOCUS_HEADERS, skip=("availability_zone",))
    return raw.withColumn("ChargeDescription", F.lit("second description"))


@query
def map_columns(spark, sf):
    mapped = billing.map_columns(_raw_focus(spark, sf), codes.FOCUS_HEADERS)
    return mapped.drop("tags", "unit_price")


@query
def coerce_lines(spark, sf):
    raw = _with_bad_cells(t.billing_lines(spark, sf))
    typed = billing.coerce_lines(billing.map_columns(raw, codes.FOCUS_HEADERS))
    return typed.select(
        "line_id", PERIOD, "charge_period_start", "billed_cost", "list_cost", "_rejected",
        F.col("tags")["team"].alias("team"),
    ).withColumnRenamed("_rejected", "rejected")


def _with_bad_cells(lines: DataFrame) -> DataFrame:
    """The export of the lines where tax lines carry an unreadable cost and spot lines unreadable dates."""
    named = _export(lines, codes.FOCUS_HEADERS, keep=("line_id", "line_seq"))
    tax, spot = F.col("ChargeType") == "Tax", F.col("ChargeType") == "SpotUsage"
    return (
        named.withColumn("BilledCost", F.when(tax, "12 USD").otherwise(F.col("BilledCost")))
        .withColumn("BillingPeriodStart", F.when(spot, "soon").otherwise(F.col("BillingPeriodStart")))
        .withColumn("ChargePeriodStart", F.when(spot, "2024-13-45").otherwise(F.col("ChargePeriodStart")))
        .withColumn("Tags", F.when(tax, "{not json").otherwise(F.col("Tags")))
    )


def _redelivered(spark, sf):
    """Stored lines, and an export that repeats half a year of them and every tax line twice."""
    lines = t.billing_lines(spark, sf)
    stored = lines.where(F.col(PERIOD) < F.lit(STORE_END))
    export = lines.where(F.col(PERIOD) >= F.lit(EXPORT_START))
    again = export.where("charge_type = 'Tax'").withColumn("line_id", F.concat("line_id", F.lit("-again")))
    return export.unionByName(again), stored


@query
def dedup_new_lines_(spark, sf):
    incoming, stored = _redelivered(spark, sf)
    return dedup_new_lines(incoming, stored).select("line_id", "invoice_id", "resource_id", "charge_type", "billed_cost")


QUERIES["dedup_new_lines"] = QUERIES.pop("dedup_new_lines_")


def _landed_redelivery(spark, sf):
    """The re-delivered export landed as a file, its tax lines with an unreadable cost, and the stored lines."""
    incoming, stored = _redelivered(spark, sf)
    path = _land_csv(_with_bad_cells(incoming).drop("line_id", "line_seq"), "redelivered")
    kept = stored.withColumn("resource_id", F.nullif("resource_id", F.lit("")))  # as loads read empty cells
    return billing.load_export(spark, path), kept.withColumn("charge_period_start", F.col("charge_period_start").cast("timestamp_ntz"))


@query
def load_stats(spark, sf):
    loaded, stored = _landed_redelivery(spark, sf)
    return billing.load_stats(loaded, stored)


@query
def load_into(spark, sf):
    """Counters that the write of the new lines observed, beside the rows it wrote."""
    loaded, stored = _landed_redelivery(spark, sf)
    path = new_dir(spark, "loaded")
    counts = billing.load_into(loaded, path, stored)
    named = [F.lit(n).cast("bigint").alias(name) for name, n in sorted(counts.items())]
    return sinks.read_table(spark, path).agg(F.count(F.lit(1)).alias("rows_stored")).select("rows_stored", *named)


@query
def ingest_rejects(spark, sf):
    """Unreadable cells of an export in which tax lines have a bad cost and every hundredth supplier's lines a bad quantity too."""
    lines = _with_bad_cells(t.billing_lines(spark, sf))
    lines = lines.withColumn("Quantity", F.when(F.col("InvoiceId").endswith("-3"), F.concat("Quantity", F.lit(" of 2,5"))).otherwise(F.col("Quantity")))
    rejects = billing.ingest_rejects(billing.load_export(spark, _land_csv(lines.drop("line_id", "line_seq"), "rejected")))
    return rejects.select("invoice_id", "resource_id", PERIOD, "cell", "text", "reason")


@query
def provider_default(spark, sf):
    provider = billing.provider_default(F.col("provider"), "AWS")
    return t.billing_lines(spark, sf).groupBy(provider.alias("provider")).agg(F.count(F.lit(1)).alias("rows"))


@query
def azure_service(spark, sf):
    ids = t._mapped(spark, sf, t.mapping.AZURE_RESOURCES)
    return ids.select("p_partkey", "resource_id", rules.azure_service(F.col("resource_id")).alias("service"))


# -- infrastructure as code ----------------------------------------------------------------------------


def _land_json(docs: DataFrame, purpose: str) -> str:
    """One JSON document per line."""
    path = new_dir(docs.sparkSession, purpose)
    docs.select(F.to_json(F.struct(*docs.columns))).write.text(path)
    return path


def _found(df: DataFrame) -> DataFrame:
    return df.select("identifier", "module", "resource_type", "resource_name")


@query
def scan_tfstate(spark, sf):
    """States of one unit (ten parts) each."""
    rows = t.iac_sources(spark, sf)["terraform"]
    attributes = F.struct(
        F.col("identifier").alias("id"),
        F.concat(F.lit("arn:"), "identifier").alias("arn"),
        F.concat(F.lit("net-"), F.col("ordinal").cast("string")).alias("network_resource_id"),
        F.col("ordinal").alias("resource_id_number"),
        F.lit("eu").alias("zone"),
    )
    block = F.struct(
        F.when(F.col("ordinal") % 4 != 0, F.col("module")).alias("module"),
        F.col("resource_type").alias("type"), F.col("resource_name").alias("name"),
        F.array(F.struct(attributes.alias("attributes"))).alias("instances"),
    )
    docs = rows.groupBy(F.floor(F.col("ordinal") / 10).alias("unit")).agg(F.collect_list(block).alias("resources"))
    return _found(iac_files.scan_tfstate(spark, _land_json(docs.select("resources"), "tfstate"), multi_line=False))


@query
def scan_arm(spark, sf):
    rows = t.iac_sources(spark, sf)["arm"]
    block = F.struct(
        F.when(F.col("ordinal") % 3 != 0, F.col("identifier")).alias("id"),
        F.col("resource_type").alias("type"),
        F.when(F.col("ordinal") % 4 != 0, F.col("resource_name")).alias("name"),
    )
    docs = rows.groupBy(F.floor(F.col("ordinal") / 10).alias("unit")).agg(F.collect_list(block).alias("resources"))
    return _found(iac_files.scan_arm(spark, _land_json(docs.select("resources"), "arm"), multi_line=False))


@query
def scan_cloudformation(spark, sf):
    rows = t.iac_sources(spark, sf)["cloudformation"]
    named = F.when(F.col("ordinal") % 3 == 0, F.col("resource_name"))
    bucket = F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("bucket-"), "resource_name"))
    block = F.struct(
        F.col("resource_type").alias("Type"),
        F.struct(named.alias("FunctionName"), bucket.alias("BucketName")).alias("Properties"),
    )
    entry = F.struct(F.col("identifier"), block)
    docs = rows.groupBy(F.floor(F.col("ordinal") / 10).alias("unit")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("Resources")
    )
    path = _land_json(docs.select("Resources"), "cloudformation")
    return _found(iac_files.scan_cloudformation(spark, path, multi_line=False))


@query
def scan_pulumi(spark, sf):
    rows = t.iac_sources(spark, sf)["pulumi"]
    n = F.col("ordinal")
    block = F.struct(
        F.col("resource_type").alias("type"),
        F.when(n % 5 != 0, F.concat(F.lit("urn:pulumi:prod::app::"), F.col("resource_type"), F.lit("::u-"), n.cast("string"))).alias("urn"),
        F.when(n % 2 == 0, F.concat(F.lit("id-"), n.cast("string"))).alias("id"),
        F.struct(
            F.when(n % 3 == 0, F.col("resource_name")).alias("name"), F.col("identifier").alias("arn")
        ).alias("outputs"),
    )
    docs = rows.groupBy(F.floor(n / 10).alias("unit")).agg(F.collect_list(block).alias("resources"))
    wrapped = docs.select(F.struct("resources").alias("deployment"))
    return _found(iac_files.scan_pulumi(spark, _land_json(wrapped, "pulumi"), multi_line=False))


@query
def iac_union_(spark, sf):
    return iac_union(t.iac_sources(spark, sf))


QUERIES["iac_union"] = QUERIES.pop("iac_union_")


def _billed_ids(spark, sf):
    return t.billing_lines(spark, sf).select("resource_id").where("resource_id <> ''").distinct()


@query
def iac_match_exact_(spark, sf):
    return iac_match_exact(_billed_ids(spark, sf), t.iac_index(spark, sf))


QUERIES["iac_match_exact"] = QUERIES.pop("iac_match_exact_")


@query
def iac_match_fuzzy_(spark, sf):
    """Containment match of every id without an exact one. Ids and index are read several times, so they are written first."""
    ids, index = stored(_billed_ids(spark, sf), "ids"), stored(t.iac_index(spark, sf), "index")
    rest = ids.join(iac_match_exact(ids, index).select("resource_id"), "resource_id", "left_anti")
    return iac_match_fuzzy(rest, index)


QUERIES["iac_match_fuzzy"] = QUERIES.pop("iac_match_fuzzy_")


# -- cost pages, pull requests, documents ---------------------------------------------------------------


def _page_rows(spark, sf):
    """Resources with untagged ones stripped of their id, grouped by ten neighbours into a page."""
    rows = t.gold_resources(spark, sf)
    neighbours = F.expr("substring(resource_id, 1, length(resource_id) - 1)")
    return rows.select(
        PERIOD, neighbours.alias("page"), "service_name",
        F.when(F.col("team").isNotNull(), F.col("resource_id")).otherwise("").alias("rid"),
        F.col("total_cost").cast("string").alias("cost"),
    )


@query
def flatten_aws_cost_pages(spark, sf):
    group = F.struct(
        F.array(F.coalesce("service_name", F.lit("")), F.col("rid")).alias("Keys"),
        F.struct(F.struct(F.col("cost").alias("Amount")).alias("UnblendedCost")).alias("Metrics"),
    )
    pages = _page_rows(spark, sf).groupBy(PERIOD, "page").agg(F.collect_list(group).alias("Groups"))
    time = F.struct(F.col(PERIOD).cast("string").alias("Start"), F.last_day(PERIOD).cast("string").alias("End"))
    docs = pages.select(F.array(F.struct(time.alias("TimePeriod"), F.col("Groups"))).alias("ResultsByTime"))
    landed = cost_pages.read_pages(spark, _land_json(docs, "aws-pages"), cost_pages.AWS_PAGE)
    return cost_pages.flatten_aws_cost_pages(landed)


@query
def flatten_azure_cost_pages(spark, sf):
    kind = F.when(F.col("service_name") == "Amazon EC2", "Microsoft.Compute/virtualMachines").when(
        F.col("service_name") == "Amazon S3", "Microsoft.Storage/storageAccounts"
    ).when(F.col("service_name") == "AWS Lambda", "Functions").otherwise("")
    odd = F.col("service_name") == "Amazon RDS"
    cells = F.array(
        F.when(odd, "0").otherwise(F.col("cost")), F.when(odd, F.col("cost")).otherwise("n.a."),
        F.col("rid"), kind, F.lit("rg"),
    )
    pages = _page_rows(spark, sf).groupBy(PERIOD, "page").agg(F.collect_list(cells).alias("rows"))
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in
                      ("Cost", "PreTaxCost", "ResourceId", "ResourceType", "ResourceGroupName")])
    docs = pages.select(
        F.col(PERIOD).cast("string").alias("period_start"), F.last_day(PERIOD).cast("string").alias("period_end"),
        F.struct(names.alias("columns"), F.col("rows")).alias("properties"),
    )
    landed = cost_pages.read_pages(spark, _land_json(docs, "azure-pages"), cost_pages.AZURE_PAGE)
    return cost_pages.flatten_azure_cost_pages(landed)


@query
def scan_pr_events(spark, sf):
    """Landed export of all pull requests, merged ones of 1996 to 2000 read back."""
    prs = t._mapped(spark, sf, t.mapping.PULL_REQUESTS)
    files = t._mapped(spark, sf, t.mapping.PR_FILES)
    listed = files.groupBy("number").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("file_pos", "filename", "status", "patch"))),
            lambda f: F.struct(f["filename"].alias("filename"), f["status"].alias("status"), f["patch"].alias("patch")),
        ).alias("files")
    )
    docs = prs.join(listed, "number").select(
        "number", "title", F.concat(F.col("merged_at").cast("string"), F.lit("T10:00:00Z")).alias("merged_at"),
        F.col("commit_sha").alias("merge_commit_sha"), F.struct(F.col("author").alias("login")).alias("user"), "files",
    )
    path = _land_json(docs, "pull-requests")
    found = pull_requests.scan_pr_events(spark, path, date(1996, 1, 1), date(2000, 12, 31))
    return found.select("pr_number", "title", "author", "merged_at", "commit_sha", F.size("tf_files").alias("tf_files"))


@query
def scan_docs(spark, sf):
    """Documents landed as records of a few files and read back whole."""
    path = _land_json(t.given(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source"), "text"), "docs")
    found = documents.scan_doc_records(spark, path)
    return found.select(F.substring_index("source", "-", -1).cast("bigint").alias("doc_id"), F.length("text").alias("chars"), "blank")


# -- silver -----------------------------------------------------------------------------------------------


@query
def invoices(spark, sf):
    return silver.invoices(t.billing_lines(spark, sf))


@query
def resources(spark, sf):
    return t.silver(spark, sf)


@query
def resource_tags(spark, sf):
    tags = silver.resource_tags(t.billing_lines(spark, sf))
    return tags.select(
        *RESOURCE_KEY, F.col("tags")["team"].alias("team"), F.col("tags")["cost_center"].alias("cost_center"),
        F.col("tags")["environment"].alias("env"),
    )


@query
def resource_signals(spark, sf):
    return silver.resource_signals(t.billing_lines(spark, sf))


@query
def environment(spark, sf):
    return t.gold_resources(spark, sf).groupBy("environment", PERIOD).agg(
        F.count(F.lit(1)).alias("resources"), F.sum("total_cost").alias("cost")
    )


@query
def logical_resources_(spark, sf):
    return logical_resources(t.gold_resources(spark, sf))


QUERIES["logical_resources"] = QUERIES.pop("logical_resources_")


# -- allocation ---------------------------------------------------------------------------------------------


def _allocations(spark, sf):
    return allocation.allocate_lines(t.billing_lines(spark, sf), t.gold_resources(spark, sf))


@query
def allocate_lines(spark, sf):
    return _allocations(spark, sf)


@query
def allocation_method(spark, sf):
    return _allocations(spark, sf).groupBy("attribution_method", "confidence_score").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("allocated_cost").alias("cost")
    )


@query
def allocation_summary(spark, sf):
    rows = allocation.allocation_summary(_allocations(spark, sf))
    return rows.withColumn("avg_allocation_confidence", rounded(F.col("avg_allocation_confidence"), 4))


@query
def invoice_coverage(spark, sf):
    """Invoices after allocation has written its coverage back."""
    rows = allocation.with_coverage(silver.invoices(t.billing_lines(spark, sf)), _allocations(spark, sf))
    return rows.select("invoice_id", PERIOD, "total_billed_cost", "attribution_coverage_pct")


@query
def allocation_coverage(spark, sf):
    return allocation.allocation_coverage(_allocations(spark, sf))


# -- change events ---------------------------------------------------------------------------------------------


@query
def change_event_match(spark, sf):
    return ev.change_event_match(t.change_events(spark, sf)).select("resource_id", PAIR[1], "event.*")


@query
def tf_diff_changes(spark, sf):
    return ev.tf_diff_changes(t.pr_files(spark, sf)).drop("file_seq", "block_seq")


def _prs_near(spark, sf):
    months = t.gold_resources(spark, sf).select(PERIOD)
    return ev.pr_periods(t.pull_requests(spark, sf), months)


@query
def pr_resource_match(spark, sf):
    changes = ev.tf_diff_changes(t.pr_files(spark, sf))
    return ev.pr_resource_match(_prs_near(spark, sf), changes, t.gold_resources(spark, sf))


@query
def pr_change_events(spark, sf):
    """Events stored by period, with those of a month that no pull request is near to any more emptied."""
    changes = ev.tf_diff_changes(t.pr_files(spark, sf))
    found = ev.pr_change_events(_prs_near(spark, sf), changes, t.gold_resources(spark, sf))
    path, gone = new_dir(spark, "pr-events"), date(1980, 1, 1)
    stale = t.change_events(spark, sf).select(F.lit(gone).alias(PERIOD), *[c for c in found.columns if c != PERIOD])
    sinks.replace_pr_events(stale, path, [gone])
    sinks.replace_pr_events(found, path, [gone])
    return sinks.read_table(spark, path).drop("commit_sha")


# -- variance -----------------------------------------------------------------------------------------------------


@query
def consecutive_pairs(spark, sf):
    return t.pairs(spark, sf)


def _paired(spark, sf, baseline="prior_month", by_resource=False):
    return var.paired_sides(t.gold_resources(spark, sf), t.pairs(spark, sf), baseline, by_resource=by_resource)


def _amounts(paired: DataFrame) -> DataFrame:
    return var.variance_amounts(paired).select(
        *PAIR, "resource_id", F.col("p").isNotNull().alias("in_prior"), F.col("c").isNotNull().alias("in_current"),
        rounded(F.col("prior_raw")).alias("prior_cost"), "current_cost", rounded(F.col("delta_raw")).alias("delta"),
        rounded(F.col("pct_raw")).alias("delta_pct"), rounded(F.col("norm_pct")).alias("norm_pct"),
    )


@query
def variance_pairs(spark, sf):
    return _paired(spark, sf).select(
        *PAIR, "resource_id", F.col("p.total_cost").alias("prior_cost"), F.col("c.total_cost").alias("current_cost")
    )


@query
def variance_amounts(spark, sf):
    return _amounts(_paired(spark, sf))


@query
def rolling_3m_baseline(spark, sf):
    return _amounts(_paired(spark, sf, "rolling_3m", by_resource=True))


@query
def same_month_last_year(spark, sf):
    return _amounts(_paired(spark, sf, "same_month_last_year"))


@query
def edge_reason(spark, sf):
    signals = silver.resource_signals(t.billing_lines(spark, sf))
    return signals.select(
        *RESOURCE_KEY, rules.edge_reason(F.col("charge_types"), F.col("description")).alias("edge")
    )


def _classified(spark, sf):
    return var.classified_variance(
        t.billing_lines(spark, sf), t.gold_resources(spark, sf), t.change_events(spark, sf), t.pairs(spark, sf)
    )


@query
def classify(spark, sf):
    return _classified(spark, sf).select(*PAIR, "resource_id", "reason_code", "excluded")


@query
def confidence(spark, sf):
    return _classified(spark, sf).groupBy(*PAIR, "reason_code", "confidence_score").agg(F.count(F.lit(1)).alias("rows"))


@query
def evidence_chain(spark, sf):
    """Steps of every chain, one row each, with the inputs of the chain."""
    chain = var.evidence_chain(_classified(spark, sf))
    steps = F.posexplode("evidence_chain.classification_steps").alias("step_no", "s")
    given = F.col("evidence_chain.inputs")
    inputs = [given[c].alias(c) for c in ("prior_cost", "current_cost", "in_iac", "iac_source", "iac_module", "charge_types")]
    return chain.select(*PAIR, given["resource_id"].alias("resource_id"), *inputs, rounded(given["delta_pct"], 4).alias("delta_pct"), steps).select(
        *PAIR, "resource_id", "step_no", "s.*", "prior_cost", "current_cost", "delta_pct", "in_iac", "iac_source", "iac_module", "charge_types"
    )


@query
def evidence_text(spark, sf):
    return t.gold_variance(spark, sf).select(*PAIR, "resource_id", "evidence", "pr_number", "pr_author")


@query
def variance_report(spark, sf):
    """The whole pipeline from charge lines, no stored table read."""
    return var.run_pipeline(t.billing_lines(spark, sf), t.iac_index(spark, sf), t.change_events(spark, sf))


# -- staging, intermediate, marts -----------------------------------------------------------------------------------


def _staged_lines(spark, sf):
    return marts.stg_billing_lines(t.billing_lines(spark, sf))


def _staged(spark, sf):
    return marts.stg_resources(t.gold_resources(spark, sf))


@query
def stg_billing_lines(spark, sf):
    return _staged_lines(spark, sf).select(
        "line_id", "invoice_id", PERIOD, "charge_type", "quantity", "unit_price", "billed_cost", "list_cost",
        "effective_cost", "is_credit", "is_usage",
    )


@query
def stg_resources(spark, sf):
    return _staged(spark, sf)


@query
def line_totals_by_invoice(spark, sf):
    return marts.line_totals_by_invoice(_staged_lines(spark, sf))


def _invoice_totals(spark, sf):
    return marts.int_invoice_totals(_staged_lines(spark, sf), _allocations(spark, sf), silver.invoices(t.billing_lines(spark, sf)))


@query
def int_invoice_totals(spark, sf):
    return _invoice_totals(spark, sf)


@query
def prior_month_cost(spark, sf):
    return marts.prior_month_cost(_staged(spark, sf)).select(*RESOURCE_KEY, "total_cost", "prior_month_cost")


@query
def next_month_cost(spark, sf):
    return marts.next_month_cost(_staged(spark, sf)).select(*RESOURCE_KEY, "total_cost", "next_month_cost")


@query
def cost_rank_in_service(spark, sf):
    return marts.cost_rank_in_service(_staged(spark, sf)).select(*RESOURCE_KEY, "service_name", "cost_rank_in_service")


@query
def rolling_3m_avg(spark, sf):
    rows = marts.rolling_3m_avg(_staged(spark, sf))
    return rows.select(*RESOURCE_KEY, rounded(F.col("rolling_3m_avg_cost"), 4).alias("rolling_3m_avg_cost"))


@query
def mom_delta(spark, sf):
    rows = marts.mom_delta(marts.prior_month_cost(_staged(spark, sf)))
    return rows.select(*RESOURCE_KEY, "mom_delta_dollars", "mom_delta_pct", "billing_month")


@query
def int_monthly_resource_spend(spark, sf):
    rows = marts.int_monthly_resource_spend(_staged(spark, sf))
    return rows.select(
        *RESOURCE_KEY, "resource_name", "service_name", "team", "cost_center", "in_terraform_state", "total_cost",
        "prior_month_cost", "next_month_cost", "cost_rank_in_service", "mom_delta_dollars", "mom_delta_pct",
        rounded(F.col("rolling_3m_avg_cost"), 4).alias("rolling_3m_avg_cost"), "billing_month",
    )


@query
def latest_resource(spark, sf):
    return marts.latest_resource(_staged(spark, sf))


@query
def drift_summary_lifetime(spark, sf):
    return marts.drift_summary_lifetime(_staged(spark, sf))


@query
def dim_resources(spark, sf):
    return marts.dim_resources(_staged(spark, sf))


def _fct(spark, sf):
    return marts.fct_variance_report(
        t.gold_variance(spark, sf), t.gold_resources(spark, sf), _allocations(spark, sf), t.resource_tasks(spark, sf)
    )


@query
def fct_variance_report(spark, sf):
    rows = _fct(spark, sf)
    return rows.withColumn("avg_allocation_confidence", rounded(F.col("avg_allocation_confidence"), 4))


@query
def delta_bucket(spark, sf):
    return t.gold_variance(spark, sf).groupBy(PAIR[1], marts.delta_bucket(F.col("delta_pct")).alias("delta_bucket")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def reason_description(spark, sf):
    text_ = marts.reason_description(F.col("reason_code"))
    return t.gold_variance(spark, sf).groupBy("reason_code", text_.alias("reason_description")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def high_priority_drift(spark, sf):
    rows = t.gold_variance(spark, sf).where(marts.high_priority_drift(F.col("reason_code"), F.col("current_cost")))
    return rows.select(*PAIR, "resource_id", "reason_code", "current_cost")


@query
def reason_code_totals(spark, sf):
    return marts.reason_code_totals(t.gold_variance(spark, sf))


@query
def pct_of_total_variance(spark, sf):
    return marts.pct_of_total_variance(t.gold_variance(spark, sf)).select(
        *PAIR, "resource_id", "period_total_delta", "pct_of_total_variance"
    )


@query
def cost_reconciliation(spark, sf):
    """Resource costs without credits against all costs, by resource."""
    return marts.cost_reconciliation(
        t.billing_lines(spark, sf).where("resource_id <> ''"), _staged_lines(spark, sf).where("resource_id <> ''"),
        "resource_id", "billed_cost", "billed_cost",
    )


@query
def tf_status_flips(spark, sf):
    """Managed by the state of each month: a resource's module appears in the months it was changed."""
    found = ev.change_event_match(t.change_events(spark, sf), tasks=t.resource_tasks(spark, sf))
    seen = found.groupBy("resource_id").agg(F.collect_set(PAIR[1]).alias("_seen"))
    staged = _staged(spark, sf).join(seen, "resource_id", "left").withColumn(
        "in_terraform_state", F.col("in_terraform_state") | F.coalesce(F.array_contains("_seen", F.col(PERIOD)), F.lit(False))
    ).drop("_seen")
    return marts.tf_status_flips(staged, t.gold_variance(spark, sf))


@query
def variance_missing_resources(spark, sf):
    """Rows a report limited to kept (not edge-case) rows would miss."""
    return marts.variance_missing_resources(_staged(spark, sf), t.gold_variance(spark, sf).where("not excluded"))


@query
def invoice_line_mismatch(spark, sf):
    """Invoice totals with credits against lines without them."""
    totals = silver.invoices(t.billing_lines(spark, sf))
    return marts.invoice_line_mismatch(totals, _staged_lines(spark, sf))


# -- star schema and sinks --------------------------------------------------------------------------------------------


def _dims(spark, sf):
    old = t.gold_resources(spark, sf).where(F.col(PERIOD) < F.lit(STORE_END))
    rows = t.gold_resources(spark, sf)
    services = star.dim_services(rows, star.dim_services(old))
    teams = star.dim_teams(rows, star.dim_teams(old))
    months = star.dim_periods(rows, star.dim_periods(old))
    return services, teams, months


@query
def dim_merge_insert(spark, sf):
    """All three dimensions, first loaded from the months before 1998, then from all."""
    services, teams, months = _dims(spark, sf)
    view = lambda df, name, key, cells: df.select(
        F.lit(name).alias("dimension"), F.col(key).cast("string").alias("natural_key"),
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells]).alias("attributes"),
    )
    out = view(services, "services", "service_name", ["service_category"])
    out = out.unionByName(view(teams, "teams", "team", ["cost_center"]))
    cells = ["period_year", "period_month", "period_label", "days_in_month"]
    return out.unionByName(view(months, "periods", "period_start", cells))


@query
def load_fact_variance(spark, sf):
    """Facts stored by key, then read back through the dimensions."""
    services, teams, months = _dims(spark, sf)
    fact = star.fact_variance(t.gold_variance(spark, sf), services, teams, months)
    path = new_dir(spark, "fact")
    sinks.write_table(fact, path)
    stored = sinks.read_table(spark, path)
    label = lambda role: months.select(
        F.col("period_key").alias(f"{role}_period_key"), F.col("period_label").alias(f"{role}_period")
    )
    return (
        stored.join(services.select("service_key", "service_name"), "service_key", "left")
        .join(teams.select("team_key", "team"), "team_key", "left")
        .join(label("prior"), "prior_period_key", "left")
        .join(label("current"), "current_period_key", "left")
        .select(
            "resource_id", "service_name", "team", "prior_period", "current_period", "prior_cost", "current_cost",
            "delta_dollars", "delta_pct", "reason_code", "confidence_score", "in_terraform_state", "iac_source",
        )
    )


@query
def trend_by_period_dim(spark, sf):
    return star.trend_by_period_dim(_staged_lines(spark, sf), star.dim_periods(t.billing_lines(spark, sf)))


@query
def export_period_tables(spark, sf):
    """Everything exported, then one month again; no other month may change."""
    root = new_dir(spark, "export")
    rows = {"resources": (t.gold_resources(spark, sf), PERIOD), "variance": (t.gold_variance(spark, sf), PAIR[1])}
    sinks.export_period_tables(rows, root, in_place=True)
    sinks.export_period_tables(rows, root, STORE_END)
    out = None
    for name, (_, column) in rows.items():
        counts = sinks.read_table(spark, f"{root}/{name}").groupBy(F.col(column).alias("period")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("in_terraform_state")).alias("unmanaged")
        ).withColumn("table", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


# Months before this one are replaced by nothing.
EMPTY_UNTIL = date(1993, 1, 1)


def _emptied(rows, *keys):
    """The periods (or pairs, by the last key) before ``EMPTY_UNTIL``."""
    return [tuple(r) for r in rows.select(*keys).where(F.col(keys[-1]) < F.lit(EMPTY_UNTIL)).distinct().collect()]


@query
def replace_period_pair(spark, sf):
    """All pairs stored; then those from 1998 on replaced by themselves and those of 1992 by nothing."""
    path = new_dir(spark, "pairs")
    rows = t.gold_variance(spark, sf)
    sinks.replace_period_pair(rows, path)
    sinks.replace_period_pair(rows.where(F.col(PAIR[1]) >= F.lit(STORE_END)), path, _emptied(rows, *PAIR))
    return sinks.read_table(spark, path).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("delta_dollars").alias("delta")
    )


def _replaced_periods(rows, path, stale):
    """All periods stored in a stale form; then those from 1998 on replaced and those of 1992 by nothing."""
    sinks.replace_periods(stale, path)
    sinks.replace_periods(rows.where(F.col(PERIOD) >= F.lit(STORE_END)), path, [p for p, in _emptied(rows, PERIOD)])
    return sinks.read_table(rows.sparkSession, path)


@query
def upsert_invoices(spark, sf):
    rows = silver.invoices(t.billing_lines(spark, sf))
    stored = _replaced_periods(rows, new_dir(spark, "invoices"), rows.withColumn("status", F.lit("stale")))
    return stored.select("invoice_id", PERIOD, "total_billed_cost", "total_line_items", "status")


@query
def upsert_resources(spark, sf):
    rows = t.gold_resources(spark, sf)
    stored = _replaced_periods(rows, new_dir(spark, "resources"), rows.withColumn("team", F.lit("stale")))
    return stored.select(*RESOURCE_KEY, "team", "total_cost")


@query
def tenant_replace(spark, sf):
    """Every tenant's lines stored in one job, then tenant 2 replaced by what it billed from 1998 on and tenant 3 by nothing."""
    path = new_dir(spark, "tenants")
    lines = t.billing_lines(spark, sf).select("user_id", "line_id", PERIOD, "billed_cost")
    sinks.replace_tenants(lines, path, [1, 2, 3])
    sinks.replace_tenants(reports.tenant_scope(lines, 2).where(F.col(PERIOD) >= F.lit(STORE_END)), path, [2, 3])
    return sinks.read_table(spark, path).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("cost")
    )


def _streamed(spark, sf):
    """Two deliveries that overlap by half a year, streamed one after the other. The second has its columns in reverse,
    unreadable costs, and a file of another kind beside it."""
    landing, table, state = new_dir(spark, "landing"), new_dir(spark, "ingested"), new_dir(spark, "stream-state")
    lines = t.billing_lines(spark, sf)
    first = _export(lines.where(F.col(PERIOD) < F.lit(STORE_END)), codes.FOCUS_HEADERS)
    second = _with_bad_cells(lines.where(F.col(PERIOD) >= F.lit(EXPORT_START))).drop("line_id", "line_seq")
    other = t.given(spark, sf, "region")
    for batch in ([first], [second.select(second.columns[::-1]), other]):
        for rows in batch:
            # Compressed, as providers deliver; the text is ten times the table.
            rows.write.mode("append").option("header", True).option("escape", '"').option("compression", "gzip").csv(landing)
        incremental_ingest(spark, landing, table, state)
    return table


@query
def incremental_ingest_(spark, sf):
    return sinks.read_table(spark, _streamed(spark, sf)).groupBy(PERIOD).agg(F.count(F.lit(1)).alias("rows"))


QUERIES["incremental_ingest"] = QUERIES.pop("incremental_ingest_")


@query
def ingest_ledger(spark, sf):
    """What the stream's batches read, stored, skipped, rejected and set aside."""
    return ledger(spark, _streamed(spark, sf)).select(
        "ingest_batch", "rows_read", "rows_inserted", "rows_skipped", "errors", (F.size("quarantined") > 0).alias("quarantined"),
        F.size("periods").alias("periods"),
    )


@query
def gl_export(spark, sf):
    """Journal written as CSV and read back."""
    path = new_dir(spark, "journal")
    sinks.write_gl_csv(reports.gl_export(t.gold_variance(spark, sf)), path, "gzip")
    return spark.read.option("header", True).csv(path).na.fill("")


# -- filters and lookups -----------------------------------------------------------------------------------------------


@query
def period_filter(spark, sf):
    from spendweave.functions.numbers import parse_period

    rows = reports.period_filter(t.gold_resources(spark, sf), parse_period("1998-02"))
    return rows.select(*RESOURCE_KEY, "service_name", "total_cost")


@query
def periods(spark, sf):
    return reports.periods(t.billing_lines(spark, sf))


@query
def detected_providers(spark, sf):
    return reports.detected_providers(t.billing_lines(spark, sf))


@query
def resources_by_filter(spark, sf):
    rows = reports.resources_by_filter(
        t.gold_variance(spark, sf), service="amazon", team="platform", min_cost=300, in_terraform=True, limit=20
    )
    return rows.select(*PAIR, "resource_id", "service_name", "team", "current_cost", "delta_dollars")


@query
def direction_filter(spark, sf):
    v = t.gold_variance(spark, sf)
    out = None
    for way in ("increases", "decreases", "both"):
        rows = reports.direction_filter(v, way).groupBy(*PAIR).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("delta_dollars").alias("delta")
        ).withColumn("direction", F.lit(way))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def drift_rows(spark, sf):
    return reports.drift_rows(t.gold_variance(spark, sf)).select(*PAIR, "resource_id", "reason_code", "delta_dollars")


@query
def tenant_scope(spark, sf):
    return reports.tenant_scope(t.billing_lines(spark, sf), 2).groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("cost")
    )


@query
def tenant_variance(spark, sf):
    """The report of all tenants stored by tenant and period; tenant 2 reads its own."""
    path = new_dir(spark, "tenant-variance")
    tenants.store_by_tenant(tenants.tenant_variance(t.billing_lines(spark, sf), t.iac_index(spark, sf), t.change_events(spark, sf)), path)
    return reports.tenant_scope(sinks.read_table(spark, path), 2).select(
        "user_id", *PAIR, "resource_id", "service_name", "team", "prior_cost", "current_cost", "delta_dollars", "reason_code", "evidence",
        "pr_number", "in_terraform_state",
    )


@query
def tenant_invoices(spark, sf):
    """Invoices of all tenants stored by tenant and period; tenant 2 reads its own."""
    path = new_dir(spark, "tenant-invoices")
    tenants.store_by_tenant(tenants.tenant_invoices(t.billing_lines(spark, sf)), path, period=PERIOD)
    return reports.tenant_scope(sinks.read_table(spark, path), 2).select("user_id", "invoice_id", PERIOD, "total_billed_cost", "total_line_items", "attributed_cost")


@query
def tenant_allocations(spark, sf):
    rows = reports.tenant_scope(tenants.tenant_allocations(t.billing_lines(spark, sf), t.iac_index(spark, sf)), 2)
    return rows.select("user_id", "billing_line_id", "resource_id", PERIOD, "team", "allocated_cost", "attribution_method", "confidence_score")


@query
def redact_secrets(spark, sf):
    return reports.redact_secrets(t.given(spark, sf, "documents"), "text").select("doc_id", "text")


# -- reports ------------------------------------------------------------------------------------------------------------


def _report(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(t.gold_variance(spark, sf_dir)))


def _resource_report(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(t.gold_resources(spark, sf_dir)))


def _pair_report(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark, sf_dir):
        rows = t.gold_resources(spark, sf_dir)
        return plain(build(rows, pr.consecutive_pairs(rows)))

    QUERIES[name] = run


_report("variance_summary", reports.variance_summary)
_report("variance_by_service", reports.variance_by_service)
_report("variance_by_reason", reports.variance_by_reason)
_report("variance_totals", reports.variance_totals)
_report("root_causes", reports.root_causes)
_report("root_cause_summary_mcp", reports.root_cause_summary)
_report("top3_per_reason", reports.top_per_reason)
_report("top5_per_bucket", reports.top_per_bucket)
_report("top5_per_drift_reason", reports.top_per_drift_reason)
_report("action_items", reports.action_items)
_report("engineering_view", reports.engineering_view)
_report("iac_sources", reports.iac_sources)
_report("team_rollup", reports.team_rollup)
_report("drift_report", reports.drift_report)
_report("packet_rollups", reports.packet_reasons)
_report("packet_services", reports.packet_services)
_report("packet_journal", reports.packet_journal)
_report(
    "top_variance",
    lambda v: reports.top_variance(v, 20).select(*PAIR, "resource_id", "delta_dollars", "reason_code"),
)
_report(
    "anomalies",
    lambda v: reports.anomalies(v).withColumn("severity", rounded(F.col("severity"))),
)
_report(
    "top_anomalies",
    lambda v: reports.top_anomalies(v, 20).select(*PAIR, "resource_id", "rank", rounded(F.col("severity")).alias("severity")),
)
_report(
    "anomalies_all_periods",
    lambda v: reports.anomalies_all_periods(v).select(*PAIR, "resource_id", "delta_dollars", "delta_pct", "reason_code"),
)
_report("anomaly_summary", lambda v: reports.anomaly_summary(reports.anomalies(v)))
_report("trends_variances", reports.trends_variances)

_resource_report("ingestion_kpis", reports.ingestion_kpis)
_resource_report("top_unmatched", reports.top_unmatched)
_resource_report("iac_coverage", reports.iac_coverage)
_resource_report("trends_by_service", reports.trends_by_service)
_resource_report("top_services", reports.top_services)
_resource_report("service_period_matrix", reports.service_period_matrix)
_resource_report("spend_by_service", reports.spend_by_service)
_resource_report("cost_trend_mom", lambda r: reports.cost_trend_mom(r, "amazon"))
_resource_report("drift_by_service", lambda r: reports.drift_by_service(r).withColumn("avg_cost", rounded(F.col("avg_cost"), 4)))
_resource_report("forecast_by_service", forecast.forecast_by_service)

_pair_report("service_compare", reports.service_compare)
_pair_report("months_stacked", reports.months_stacked)
_pair_report("id_sets", reports.id_sets)
_pair_report("top_movers", reports.top_movers)
_pair_report(
    "drift_growth",
    lambda r, p: reports.drift_growth(r, p).withColumn("pct_change", rounded(F.col("pct_change"))).drop("risk_score"),
)
_pair_report(
    "risk_score",
    lambda r, p: reports.drift_growth(r, p).select(*PAIR, "resource_id", "current_cost", "risk_score"),
)
_pair_report(
    "import_priority",
    lambda r, p: reports.import_priority(reports.drift_growth(r, p)).select(
        *PAIR, "priority", "resource_id", "resource_name", "service_name", "team", "current_cost", "risk_score",
        "tf_type", "import_cmd",
    ),
)


def _invoices(spark, sf):
    return silver.invoices(t.billing_lines(spark, sf))


@query
def close_packet(spark, sf):
    return reports.close_packet(t.gold_variance(spark, sf), _invoices(spark, sf))


@query
def bill_overview(spark, sf):
    return reports.bill_overview(_invoices(spark, sf), t.pairs(spark, sf))


@query
def period_breakdown(spark, sf):
    return reports.period_breakdown(t.billing_lines(spark, sf))


@query
def service_rows_with_iac(spark, sf):
    return reports.service_rows_with_iac(t.billing_lines(spark, sf), t.gold_resources(spark, sf))


@query
def available_periods(spark, sf):
    return reports.available_periods(t.billing_lines(spark, sf), _invoices(spark, sf))


@query
def recent_events(spark, sf):
    return reports.recent_events(t.change_events(spark, sf))


@query
def forecast_total(spark, sf):
    return forecast.forecast_total(_invoices(spark, sf))


@query
def cost_describe(spark, sf):
    rows = reports.cost_describe(t.billing_lines(spark, sf))
    return rows.select(PERIOD, "lines", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query
def team_spend(spark, sf):
    return reports.team_spend(t.billing_lines(spark, sf))


# -- data quality ----------------------------------------------------------------------------------------------------------


@query
def dq_reconciliation(spark, sf):
    return quality.dq_reconciliation(t.billing_lines(spark, sf), _invoices(spark, sf))


@query
def dq_duplicates(spark, sf):
    return quality.dq_duplicates(t.billing_lines(spark, sf))


@query
def dq_missing_ids(spark, sf):
    return quality.dq_missing_ids(t.billing_lines(spark, sf))


@query
def dq_negative(spark, sf):
    return quality.dq_negative(t.billing_lines(spark, sf))


@query
def dq_coverage(spark, sf):
    return quality.dq_coverage(t.billing_lines(spark, sf), _invoices(spark, sf))


@query
def dq_line_counters(spark, sf):
    return quality.dq_line_counters(t.billing_lines(spark, sf))


@query
def dq_no_negative_costs(spark, sf):
    return marts.no_negative_costs(_staged(spark, sf))


@query
def dq_generic(spark, sf):
    want = {
        "stg_billing_lines": (
            _staged_lines(spark, sf),
            quality.Expectations(
                not_null=["line_id", "invoice_id"], unique=["line_id"],
                accepted={"charge_type": ["Usage", "Tax", "Fee", "Refund", "SavingsPlanCoveredUsage", "SavingsPlanNegation"]},
            ),
        ),
        "int_invoice_totals": (
            _invoice_totals(spark, sf),
            quality.Expectations(
                not_null=["invoice_id"], unique=["invoice_id"],
                accepted={"reconciliation_status": ["reconciled", "variance_detected"]},
            ),
        ),
        "fct_variance_report": (
            _fct(spark, sf).select("id", "resource_id", "reason_code", "delta_bucket", "team"),
            quality.Expectations(
                not_null=["id", "resource_id", "team"], unique=["id"],
                accepted={"reason_code": codes.EMITTED_CODES, "delta_bucket": ["large", "medium", "small"]},
            ),
        ),
    }
    return quality.dq_generic(want)


def _all_checks(spark, sf):
    return quality.run_quality_checks(t.billing_lines(spark, sf), _invoices(spark, sf))


@query
def dq_gate(spark, sf):
    """A verdict for each of the five checks, and whether they stop the pipeline. The log holds every period's."""
    path = new_dir(spark, "quality-log")
    try:
        quality.dq_gate(_all_checks(spark, sf), path)
        stopped = False
    except quality.QualityError:
        stopped = True
    return quality.verdicts(sinks.read_table(spark, path)).withColumn("stopped", F.lit(stopped))


@query
def publish_(spark, sf):
    """What readers see after two releases: months before 1998 behind checks that only warn, then all months behind all checks."""
    root = new_dir(spark, "published")
    lines, resources = t.billing_lines(spark, sf), t.gold_resources(spark, sf)
    old = F.col(PERIOD) < F.lit(STORE_END)
    mild = quality.dq_missing_ids(lines.where(old)).unionByName(quality.dq_negative(lines.where(old)))
    releases = [(lines.where(old), resources.where(old), mild), (lines, resources, _all_checks(spark, sf))]
    for some_lines, some_resources, checks in releases:
        tables = {
            "int_line_totals": (marts.line_totals_by_invoice(marts.stg_billing_lines(some_lines)), PERIOD),
            "dim_resources": (marts.dim_resources(marts.stg_resources(some_resources)), None),
        }
        try:
            publish.publish(spark, tables, checks, root)
        except quality.QualityError:
            pass
    out = None
    for name in tables:
        rows = publish.read_published(spark, root, name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES["publish"] = QUERIES.pop("publish_")


# -- text retrieval ----------------------------------------------------------------------------------------------------------


def _chunks(spark, sf):
    docs = t.given(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return text.chunk_docs(docs)


@query
def chunk_docs(spark, sf):
    return _chunks(spark, sf)


@query
def chunk_ids(spark, sf):
    return text.chunk_ids(_chunks(spark, sf)).select("source", "chunk_no", "chunk_id")


def _query_vectors(spark, sf):
    """Mean vector of the collection as the only query."""
    parts = t.given(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One row per dimension of the vectors.
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.agg(F.array(F.struct(F.lit("mean").alias("query_id"), vector.alias("vector")))).scalar()


@query
def vector_topk(spark, sf):
    found = text.vector_topk(t.given(spark, sf, "embeddings"), _query_vectors(spark, sf), "vec_id", "embedding", 5)
    return found.select("query_id", "vec_id", "label", "rank", rounded(F.col("distance"), 5).alias("distance"))


@query
def dedupe_overlap(spark, sf):
    docs = t.given(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    vectors = t.given(spark, sf, "embeddings").join(docs, "vec_id")
    found = text.vector_topk(vectors, _query_vectors(spark, sf), "vec_id", "embedding", 5)
    kept = text.dedupe_overlap(found.select("query_id", "rank", "vec_id", "text", "distance"), 5)
    return kept.select("query_id", "rank", "vec_id")
