"""Billing tables derived from the given TPC-H-like tables, in SQL both Spark and DuckDB read.

Attributes come from arithmetic on keys, so both engines agree without sharing a hash function.
"""

from __future__ import annotations

RESOURCE_ID = (
    "'arn:aws:' || lower(p_type) || ':us-east-1:123456789012:res-' || lpad(CAST(p_partkey AS STRING), 12, '0')"
)
RESOURCE_NAME = "p_name || '-' || CAST(p_partkey AS STRING)"
UNIT = "'unit-' || lpad(CAST(CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT) AS STRING), 10, '0')"
SERVICE = """CASE p_type WHEN 'ECONOMY' THEN 'Amazon EC2' WHEN 'LARGE' THEN 'Amazon EKS'
    WHEN 'MEDIUM' THEN 'Amazon RDS' WHEN 'PROMO' THEN 'Amazon CloudFront'
    WHEN 'SMALL' THEN 'AWS Lambda' ELSE 'Amazon S3' END"""
RESOURCE_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'aws_instance' WHEN 'LARGE' THEN 'aws_eks_cluster'
    WHEN 'MEDIUM' THEN 'aws_rds_cluster' WHEN 'PROMO' THEN 'aws_cloudfront_distribution'
    WHEN 'SMALL' THEN 'aws_lambda_function' ELSE 'aws_s3_bucket' END"""
MODULE = f"'modules/' || {UNIT} || CASE p_partkey % 40 - p_partkey % 10 WHEN 0 THEN '/prod' WHEN 10 THEN '/staging' WHEN 20 THEN '/dev' ELSE '' END"

# ARM id of a part: a known type with and without a child, two types without a service name, and none.
ARM_ID = f"""CASE p_size % 6
    WHEN 0 THEN '/subscriptions/s1/resourceGroups/rg/providers/Microsoft.Compute/virtualMachines/vm-' || CAST(p_partkey AS STRING)
    WHEN 1 THEN '/subscriptions/s1/resourceGroups/rg/providers/Microsoft.Sql/servers/db-' || CAST(p_partkey AS STRING) || '/databases/main'
    WHEN 2 THEN '/subscriptions/s1/PROVIDERS/Microsoft.Resources/x/providers/Microsoft.Storage/storageAccounts/st' || CAST(p_partkey AS STRING)
    WHEN 3 THEN '/subscriptions/s1/providers/Contoso.Backup/vaultStores/v-' || CAST(p_partkey AS STRING)
    WHEN 4 THEN '/subscriptions/s1/providers/Microsoft.Classic/virtualMachinesSets/c-' || CAST(p_partkey AS STRING)
    ELSE {RESOURCE_ID} END"""

AZURE_RESOURCES = f"SELECT p_partkey, {ARM_ID} AS resource_id FROM {{part}}"

# What depends on the part alone is computed per part, before the join.
_PARTS = f"""
SELECT p_partkey, {SERVICE} AS service,
  CASE p_type WHEN 'ECONOMY' THEN 'Compute' WHEN 'LARGE' THEN 'Containers' WHEN 'MEDIUM' THEN 'Database'
    WHEN 'PROMO' THEN 'Networking' WHEN 'SMALL' THEN 'Compute' ELSE 'Storage' END AS category,
  {RESOURCE_ID} AS rid, {RESOURCE_NAME} AS rname,
  CASE p_partkey % 29 WHEN 0 THEN 'AWS Marketplace subscription' WHEN 1 THEN 'Spot instance hours'
    WHEN 2 THEN 'NAT Gateway processing' WHEN 3 THEN NULL WHEN 4 THEN ''
    ELSE 'Running hours of ' || p_brand END AS part_text,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,10)) AS price,
  CASE WHEN p_partkey % 10 < 2 THEN 'platform' WHEN p_partkey % 10 < 4 THEN 'data-eng'
    WHEN p_partkey % 10 < 6 THEN 'payments' WHEN p_partkey % 10 = 6 THEN 'search' WHEN p_partkey % 10 = 7 THEN '' END AS team,
  CASE WHEN p_partkey % 10 < 7 THEN 'CC-' || CAST(p_partkey % 4 AS STRING) END AS center,
  CASE p_partkey % 7 WHEN 0 THEN 'prod-eu' WHEN 1 THEN 'UAT' WHEN 2 THEN 'preprod' END AS stage,
  CASE p_partkey % 17 WHEN 0 THEN 'Pulumi' WHEN 1 THEN 'ops' END AS tool,
  CASE WHEN p_partkey % 23 = 0 THEN 'stack-' || CAST(p_partkey AS STRING) END AS stack
FROM {{part}}"""

_LINES = """
SELECT *, substr(CAST(l_shipdate AS STRING), 1, 10) AS ship_day,
  CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(0.02 AS DECIMAL(3,2)) AS listed,
  CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)) AS paid_share,
  l_linenumber = 7 AND l_returnflag = 'R' AS odd_type
FROM {lineitem}"""

# Lines carry tags except where the line number is 5; line number 4 names a shared team.
BILLING_LINES = f"""
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || ship_day AS line_id,
  l_orderkey * 8 + l_linenumber AS line_seq,
  CAST(l_suppkey % 3 + 1 AS INT) AS user_id,
  'INV-' || substr(ship_day, 1, 7) || '-' || CAST(l_suppkey % 5 AS STRING) AS invoice_id,
  CAST(substr(ship_day, 1, 8) || '01' AS DATE) AS billing_period_start,
  last_day(CAST(l_shipdate AS DATE)) AS billing_period_end,
  l_shipdate AS charge_period_start,
  l_shipdate + INTERVAL 1 DAY AS charge_period_end,
  CASE WHEN l_orderkey % 601 = 0 THEN NULL ELSE service END AS service_name,
  category AS service_category,
  CASE WHEN l_orderkey % 499 = 0 THEN NULL WHEN l_orderkey % 499 = 1 THEN '' ELSE rid END AS resource_id,
  rname AS resource_name,
  CASE l_suppkey % 5 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-west-1'
    WHEN 3 THEN 'eu-central-1' ELSE 'ap-south-1' END AS region,
  CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS availability_zone,
  CASE WHEN odd_type AND l_suppkey % 4 = 0 THEN 'Credit' WHEN odd_type AND l_suppkey % 4 = 1 THEN 'RIFee'
    WHEN odd_type AND l_suppkey % 4 = 2 THEN 'SavingsPlanCoveredUsage' WHEN odd_type THEN 'Tax'
    WHEN l_linenumber = 6 AND l_returnflag = 'A' AND l_suppkey % 20 = 0 THEN 'SpotUsage'
    WHEN l_linenumber = 6 AND l_returnflag = 'A' AND l_suppkey % 20 = 1 THEN NULL
    ELSE 'Usage' END AS charge_type,
  part_text AS description,
  CAST(l_quantity AS DECIMAL(18,6)) AS quantity,
  'Hrs' AS unit,
  price AS unit_price,
  CAST(CAST(CASE WHEN l_orderkey % 307 = 0 THEN 0 WHEN odd_type AND l_suppkey % 4 = 0 THEN -1
    WHEN l_orderkey % 311 = 0 THEN -1 ELSE 1 END AS DECIMAL(2,0)) * listed * paid_share AS DECIMAL(18,6)) AS billed_cost,
  CAST(listed AS DECIMAL(18,6)) AS list_cost,
  CAST(listed * paid_share AS DECIMAL(18,6)) AS effective_cost,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN 'Azure' ELSE 'AWS' END AS provider,
  CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 4 AND p_partkey % 10 < 6 THEN 'shared-services' ELSE team END AS tag_team,
  CASE WHEN l_linenumber <> 5 THEN center END AS tag_cost_center,
  CASE WHEN l_linenumber <> 5 THEN stage END AS tag_environment,
  CASE WHEN l_linenumber <> 5 THEN tool END AS tag_managed_by,
  CASE WHEN l_linenumber <> 5 THEN stack END AS tag_stack
FROM ({_LINES}) AS line_cells JOIN ({_PARTS}) AS part_cells ON l_partkey = p_partkey
"""

# Tag column of the mapping to tag key.
TAG_KEYS = {
    "tag_team": "team",
    "tag_cost_center": "cost_center",
    "tag_environment": "environment",
    "tag_managed_by": "managed_by",
    "tag_stack": "aws:cloudformation:stack-name",
}


def iac_source(name: str, rank: int) -> str:
    """Identifiers one tool manages: the parts whose size falls below the managed share, split by size.

    Every eleventh part is listed by a second tool. Some are listed by a short id that lies in the
    resource id, some by a longer one around it.
    """
    module = {"terraform": MODULE, "arm": RESOURCE_TYPE, "cloudformation": "'cloudformation'", "pulumi": "'pulumi'"}[name]
    return f"""
SELECT p_partkey AS ordinal,
  CASE WHEN p_partkey % 5 < 3 THEN {RESOURCE_ID}
    WHEN p_partkey % 5 = 3 THEN 'res-' || lpad(CAST(p_partkey AS STRING), 12, '0')
    ELSE {RESOURCE_ID} || '/child' END AS identifier,
  {module} AS module, {RESOURCE_TYPE} AS resource_type, {RESOURCE_NAME} AS resource_name
FROM {{part}}
WHERE p_size % 10 < 7 AND (p_size % 4 = {rank} OR p_partkey % 11 = {rank})
"""


# Every line is an infrastructure change of its part, with the priority of its order.
CHANGE_EVENTS = f"""
SELECT l_orderkey * 8 + l_linenumber AS event_seq,
  CASE WHEN l_partkey % 3 = 0 THEN 'apply/' || {RESOURCE_ID} ELSE {RESOURCE_ID} END AS resource_id,
  CASE WHEN l_orderkey % 4 = 0 THEN 'terraform_apply' ELSE 'github_pr' END AS event_type,
  CAST(o_orderdate AS DATE) AS event_date,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS pr_number,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE 'Resize ' || {RESOURCE_NAME} END AS pr_title,
  'user-' || CAST(o_custkey % 50 AS STRING) AS pr_author,
  'c' || CAST(l_orderkey AS STRING) AS commit_sha,
  {MODULE} AS terraform_module,
  CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE 'Apply of order ' || CAST(l_orderkey AS STRING) END AS description,
  CAST(l_extendedprice / 100 AS DECIMAL(18,2)) AS estimated_cost_delta,
  o_orderpriority AS priority,
  CAST(l_suppkey % 3 + 1 AS INT) AS user_id
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey
"""

# Every order is a pull request; those still pending were never merged.
PULL_REQUESTS = """
SELECT o_orderkey AS number, 'Update order ' || CAST(o_orderkey AS STRING) AS title,
  'user-' || CAST(o_custkey % 50 AS STRING) AS author,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS merged_at,
  'c' || CAST(o_orderkey AS STRING) AS commit_sha,
  o_orderpriority AS priority
FROM {orders}
"""

# Their files are the lines of the order, ordered by line number, part and status.
PR_FILES = f"""
SELECT o_orderkey AS number, (l_linenumber * 1000000000000 + l_partkey) * 3
    + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS file_pos,
  CASE l_linenumber WHEN 1 THEN 'modules/' || {UNIT} || '/main.tf' WHEN 2 THEN 'legacy/' || {UNIT} || '/main.tf'
    WHEN 3 THEN 'docs/' || {UNIT} || '.md' WHEN 4 THEN 'stacks/' || {UNIT} || '/net.tf'
    ELSE 'live/' || {UNIT} || '/app.tf' END AS filename,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'modified' END AS status,
  CASE l_linenumber WHEN 1 THEN NULL
    WHEN 4 THEN '+module "net-' || CAST(p_partkey AS STRING) || '" {{{{' || chr(10) || '+module "dns-' || CAST(p_partkey AS STRING) || '" {{{{'
    WHEN 5 THEN '+  size = 3'
    ELSE '+resource "' || {RESOURCE_TYPE} || '" "' || {RESOURCE_NAME} || '" {{{{' || chr(10) || '+resource  "aws_lb" "lb-' || CAST(p_partkey AS STRING) || '" {{{{' END AS patch
FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey JOIN {{part}} ON l_partkey = p_partkey
"""
