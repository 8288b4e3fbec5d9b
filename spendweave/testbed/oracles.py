"""SQL of every query that SQL can express, for DuckDB over the same tables.

Written from the rules, not from the Spark plans: matching is a plain nested loop, ranks are plain
windows. Each text is self-contained; the views it needs are put in front of it.
"""

from __future__ import annotations

import re

from spendweave.functions import codes
from spendweave.operators.iac import SOURCE_ORDER
from spendweave.testbed import mapping

TABLES = {"lineitem": "lineitem", "part": "part", "orders": "orders"}
PAIR = "prior_period_start, current_period_start"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(column: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def rnd(expr: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def txt(expr: str, digits: int) -> str:
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(38,6)), {digits}) AS DECIMAL(38,{digits})) AS VARCHAR)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def pct(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE))"


def pct0(part: str, whole: str, digits: int = 2) -> str:
    return f"CASE WHEN {whole} > 0 THEN {rnd(pct(part, whole), digits)} ELSE 0.0 END"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def in_list(column: str, values) -> str:
    return f"{column} IN ({_list(values)})"


def _environment() -> str:
    arms = []
    for text in ("lower(coalesce(tag_environment, ''))", "lower(coalesce(terraform_module, ''))", "lower(coalesce(resource_name, ''))"):
        for stage, words in codes.ENVIRONMENT_WORDS.items():
            arms.append(f"WHEN {any_of(text, words)} THEN '{stage}'")
    return "CASE " + " ".join(arms) + " ELSE 'other' END"


def _variance(base: str) -> str:
    """Amounts of full-outer pairs; ``base`` yields the prior side with its cost as ``cost``."""
    return f"""
SELECT coalesce(p.prior_period_start, c.prior_period_start) AS prior_period_start,
  coalesce(p.current_period_start, c.current_period_start) AS current_period_start,
  coalesce(p.resource_id, c.resource_id) AS resource_id,
  p.resource_id IS NOT NULL AS in_prior, c.resource_id IS NOT NULL AS in_current,
  coalesce(p.cost, 0) AS prior_raw, coalesce(c.total_cost, 0) AS current_cost,
  p.cost AS prior_given, c.total_cost AS current_given,
  day(last_day(coalesce(p.prior_period_start, c.prior_period_start))) AS prior_days,
  day(last_day(coalesce(p.current_period_start, c.current_period_start))) AS current_days,
  CASE WHEN c.resource_id IS NOT NULL THEN c.resource_name ELSE p.resource_name END AS resource_name,
  CASE WHEN c.resource_id IS NOT NULL THEN c.service_name ELSE p.service_name END AS service_name,
  CASE WHEN c.resource_id IS NOT NULL THEN c.team ELSE p.team END AS team,
  CASE WHEN c.resource_id IS NOT NULL THEN c.cost_center ELSE p.cost_center END AS cost_center,
  CASE WHEN c.resource_id IS NOT NULL THEN c.in_terraform_state ELSE p.in_terraform_state END AS managed,
  CASE WHEN c.resource_id IS NOT NULL THEN c.terraform_module ELSE p.terraform_module END AS terraform_module,
  CASE WHEN c.resource_id IS NOT NULL THEN c.iac_source ELSE p.iac_source END AS iac_source
FROM ({base}) p FULL JOIN cur_side c
  ON p.resource_id = c.resource_id AND p.prior_period_start = c.prior_period_start AND p.current_period_start = c.current_period_start
"""


def _amounts(inner: str) -> str:
    change = "(current_cost * prior_days - prior_raw * current_days)"
    base = "(prior_raw * current_days)"
    return f"""
SELECT *, current_cost - prior_raw AS delta_raw,
  CASE WHEN prior_raw <> 0 THEN {pct('current_cost - prior_raw', 'prior_raw')} END AS pct_raw,
  CASE WHEN prior_raw > 0 THEN {pct(change, base)}
    WHEN prior_raw <> 0 THEN {pct('current_cost - prior_raw', 'prior_raw')} END AS norm_pct
FROM ({inner})
"""


CHUNK_CHARS, CHUNK_OVERLAP = 800, 100


def _chunk_end(first: str, after: str) -> str:
    """The line that closes a chunk: the first one behind line ``after`` with which the chunk gets too long; else the end."""
    return f"""coalesce({after} + nullif(list_position(list_transform(run[{after} + 3:], lambda x: x - run[{first} + 1] > {CHUNK_CHARS}), true), 0), len(sizes))::BIGINT"""


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PRIOR_SIDE = """SELECT pairs.*, r.*, r.total_cost AS cost FROM pairs
  JOIN res r ON r.billing_period_start = pairs.prior_period_start"""

_STEADY = codes.STEADY_PCT

CTES: dict[str, str] = {
    "bl": mapping.BILLING_LINES.format(**TABLES),
    "arm_ids": mapping.AZURE_RESOURCES.format(**TABLES),
    "prs": mapping.PULL_REQUESTS.format(**TABLES),
    "pr_file": mapping.PR_FILES.format(**TABLES),
    "change_events": mapping.CHANGE_EVENTS.format(**TABLES),
    "iac_listed": " UNION ALL ".join(
        f"SELECT {rank} AS rank, '{name}' AS iac_source, * FROM ({mapping.iac_source(name, rank).format(**TABLES)})"
        for rank, name in enumerate(SOURCE_ORDER)
    ),
    "idx": """
SELECT identifier, module, resource_type, resource_name, iac_source, first_rank AS rank, first_ordinal AS ordinal FROM (
  SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY rank DESC, ordinal DESC, resource_name DESC) AS rn,
    first_value(rank) OVER (PARTITION BY identifier ORDER BY rank, ordinal) AS first_rank,
    first_value(ordinal) OVER (PARTITION BY identifier ORDER BY rank, ordinal) AS first_ordinal
  FROM iac_listed WHERE identifier <> '') WHERE rn = 1""",
    "ids": "SELECT DISTINCT resource_id FROM bl WHERE resource_id <> ''",
    "exact": "SELECT ids.resource_id, module, iac_source FROM ids JOIN idx ON ids.resource_id = idx.identifier",
    "fuzzy": """
SELECT resource_id, module, iac_source FROM (
  SELECT u.resource_id, idx.module, idx.iac_source,
    row_number() OVER (PARTITION BY u.resource_id ORDER BY idx.rank, idx.ordinal, idx.identifier) AS rn
  FROM (SELECT resource_id FROM ids WHERE resource_id NOT IN (SELECT resource_id FROM exact)) u
  JOIN idx ON contains(idx.identifier, u.resource_id) OR contains(u.resource_id, idx.identifier)) WHERE rn = 1""",
    "matched": "SELECT * FROM exact UNION ALL SELECT * FROM fuzzy",
    "last_tags": """
SELECT resource_id, billing_period_start, tag_team, tag_cost_center, tag_environment FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, billing_period_start ORDER BY line_seq DESC) AS rn
  FROM bl WHERE resource_id <> ''
    AND coalesce(tag_team, tag_cost_center, tag_environment, tag_managed_by, tag_stack) IS NOT NULL) WHERE rn = 1""",
    "last_provider": """
SELECT resource_id, billing_period_start, provider FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, billing_period_start ORDER BY line_seq DESC, provider DESC) AS rn
  FROM bl WHERE resource_id <> '' AND provider <> '') WHERE rn = 1""",
    "attr_costs": """
SELECT resource_id, billing_period_start, resource_name, service_name, service_category, region, sum(billed_cost) AS c
FROM bl WHERE resource_id <> '' GROUP BY ALL""",
    "res": f"""
SELECT resource_id, billing_period_start, resource_name, service_name, service_category, region, tag_team AS team,
  tag_cost_center AS cost_center, in_terraform_state, terraform_module, iac_source, {_environment()} AS environment, total_cost, provider
FROM (
  SELECT a.resource_id, a.billing_period_start, a.resource_name, a.service_name, a.service_category, a.region,
    t.tag_team, t.tag_cost_center, t.tag_environment, m.resource_id IS NOT NULL AS in_terraform_state,
    m.module AS terraform_module, coalesce(m.iac_source, 'none') AS iac_source, a.total_cost, v.provider
  FROM (SELECT *, CAST(round(sum(c) OVER w, 2) AS DECIMAL(18,2)) AS total_cost,
      row_number() OVER (PARTITION BY resource_id, billing_period_start ORDER BY c DESC, coalesce(service_name, '') DESC, region DESC) AS rn
    FROM attr_costs WINDOW w AS (PARTITION BY resource_id, billing_period_start)) a
  LEFT JOIN last_tags t ON a.resource_id = t.resource_id AND a.billing_period_start = t.billing_period_start
  LEFT JOIN matched m ON a.resource_id = m.resource_id
  LEFT JOIN last_provider v ON a.resource_id = v.resource_id AND a.billing_period_start = v.billing_period_start
  WHERE a.rn = 1)""",
    "pairs": """
SELECT p AS prior_period_start, c AS current_period_start FROM (
  SELECT billing_period_start AS p, lead(billing_period_start) OVER (ORDER BY billing_period_start) AS c
  FROM (SELECT DISTINCT billing_period_start FROM bl)) WHERE c IS NOT NULL""",
    "sig_types": """
SELECT resource_id, billing_period_start, list(charge_type ORDER BY s, charge_type) AS charge_types FROM (
  SELECT resource_id, billing_period_start, charge_type, min(line_seq) AS s FROM bl
  WHERE resource_id <> '' AND charge_type <> '' GROUP BY ALL) GROUP BY ALL""",
    "sig_desc": """
SELECT resource_id, billing_period_start, description FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, billing_period_start ORDER BY line_seq, description) AS rn
  FROM bl WHERE resource_id <> '' AND description <> '') WHERE rn = 1""",
    "sig_tags": """
SELECT resource_id, billing_period_start, tag_managed_by, tag_stack FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, billing_period_start ORDER BY line_seq) AS rn
  FROM bl WHERE resource_id <> ''
    AND coalesce(tag_team, tag_cost_center, tag_environment, tag_managed_by, tag_stack) IS NOT NULL) WHERE rn = 1""",
    "sig": f"""
SELECT k.*, coalesce(y.charge_types, []) AS charge_types, d.description,
  CASE WHEN g.resource_id IS NOT NULL THEN coalesce({in_list('lower(g.tag_managed_by)', codes.IAC_TOOLS)}, false) OR g.tag_stack IS NOT NULL END AS other_tool,
  CASE WHEN t1 IS NOT NULL THEN {_case('t1', codes.CHARGE_TYPE_REASONS)}
    WHEN {any_of("lower(coalesce(d.description, ''))", codes.MARKETPLACE_WORDS)} THEN 'marketplace_subscription'
    WHEN {any_of("lower(coalesce(d.description, ''))", codes.SPOT_WORDS)}
      OR contains(lower(array_to_string(coalesce(y.charge_types, []), ',')), 'spot') THEN 'spot_price_volatility'
    WHEN {any_of("lower(coalesce(d.description, ''))", codes.TRANSFER_WORDS)} THEN 'cross_service_transfer' END AS edge
FROM (SELECT DISTINCT resource_id, billing_period_start FROM bl WHERE resource_id <> '') k
LEFT JOIN (SELECT *, list_filter(charge_types, lambda x: {in_list('x', codes.CHARGE_TYPE_REASONS)})[1] AS t1 FROM sig_types) y
  ON k.resource_id = y.resource_id AND k.billing_period_start = y.billing_period_start
LEFT JOIN sig_desc d ON k.resource_id = d.resource_id AND k.billing_period_start = d.billing_period_start
LEFT JOIN sig_tags g ON k.resource_id = g.resource_id AND k.billing_period_start = g.billing_period_start""",
    "event_ids": """
SELECT DISTINCT unnest([resource_id, CASE WHEN contains(resource_id, '/') THEN regexp_extract(resource_id, '[^/]*$')
  WHEN contains(resource_id, ':') THEN regexp_extract(resource_id, '[^:]*$') ELSE resource_id END]) AS rid,
  event_date, event_seq, pr_number, pr_title, pr_author, description FROM change_events""",
    "months": "SELECT DISTINCT billing_period_start FROM bl",
    "event_months": """
SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS m FROM (
  SELECT unnest([event_date - INTERVAL 7 DAY, event_date + INTERVAL 7 DAY]) AS d FROM change_events)""",
    "ev": """
SELECT * FROM (
  SELECT e.*, m AS current_period_start,
    row_number() OVER (PARTITION BY rid, m ORDER BY event_date DESC, event_seq DESC, coalesce(pr_number, '') DESC) AS rn
  FROM event_ids e JOIN event_months ON m BETWEEN e.event_date - INTERVAL 7 DAY AND e.event_date + INTERVAL 7 DAY) WHERE rn = 1""",
    "cur_side": "SELECT pairs.*, r.* FROM pairs JOIN res r ON r.billing_period_start = pairs.current_period_start",
    "amounts": _amounts(_variance(_PRIOR_SIDE)),
    "cls": f"""
SELECT *, edge IS NOT NULL AS excluded,
  CASE WHEN edge IS NOT NULL THEN edge WHEN NOT in_prior THEN 'new_resource' WHEN NOT in_current THEN 'removed_resource'
    WHEN managed AND has_event THEN 'planned'
    WHEN NOT managed AND other_tool THEN 'non_terraform_iac'
    WHEN NOT managed AND coalesce(team, '') <> '' THEN 'orphan_sdk_created'
    WHEN NOT managed AND prior_raw > 0 AND current_cost < {codes.LEGACY_COST} THEN 'legacy_untracked'
    WHEN NOT managed THEN 'orphan_unknown'
    WHEN abs(coalesce(norm_pct, 0)) > {_STEADY} THEN 'usage_growth' ELSE 'steady_state' END AS reason_code
FROM (SELECT a.*, s.charge_types, s.edge, s.other_tool, e.rid IS NOT NULL AS has_event,
    e.pr_number, e.pr_title, e.pr_author, e.description AS event_description
  FROM amounts a
  LEFT JOIN sig s ON a.resource_id = s.resource_id AND a.current_period_start = s.billing_period_start
  LEFT JOIN ev e ON a.resource_id = e.rid AND a.current_period_start = e.current_period_start)""",
    "vr": f"""
SELECT {PAIR}, resource_id, resource_name, service_name, team, cost_center,
  CAST(round(prior_raw, 2) AS DECIMAL(18,2)) AS prior_cost, current_cost,
  CAST(round(delta_raw, 2) AS DECIMAL(18,2)) AS delta_dollars,
  CAST(coalesce(round(CAST(pct_raw AS DECIMAL(38,6)), 2), 0) AS DECIMAL(18,2)) AS delta_pct, reason_code,
  CAST(CASE WHEN excluded THEN 0.90 WHEN reason_code = 'non_terraform_iac' THEN 0.85 WHEN reason_code = 'orphan_sdk_created' THEN 0.70
    WHEN reason_code = 'legacy_untracked' THEN 0.60 WHEN reason_code = 'orphan_unknown' THEN 0.50
    WHEN managed THEN 0.95 WHEN coalesce(team, '') <> '' THEN 0.70 ELSE 0.50 END AS DECIMAL(3,2)) AS confidence_score,
  nullif(concat_ws('; ',
    CASE WHEN excluded THEN 'Edge case: ' || reason_code || ' (charge_types: ' || array_to_string(charge_types, ', ') || ')' END,
    CASE WHEN reason_code = 'planned' THEN CASE WHEN coalesce(pr_number, '') <> '' THEN 'PR #' || pr_number || ': ' || pr_title
      ELSE coalesce(nullif(event_description, ''), 'terraform apply') END END,
    CASE WHEN reason_code = 'steady_state' THEN 'Day-adjusted delta is ' || {txt('coalesce(norm_pct, 0)', 1)} || '% (within normal range for ' || prior_days || '→' || current_days || ' day month)' END,
    CASE WHEN reason_code = 'usage_growth' THEN 'Day-adjusted growth of ' || {txt('coalesce(norm_pct, 0)', 1)} || '% exceeds normal variation' END,
    CASE WHEN reason_code = 'new_resource' THEN 'New ' || coalesce(service_name, 'None') || ' resource' ||
      CASE WHEN coalesce(team, '') <> '' THEN ' (team: ' || team || ')' ELSE '' END || ' costing ' || format('{{:,}}', CAST(round(current_cost, 0) AS BIGINT)) || '/mo' END,
    CASE WHEN managed THEN 'Managed by ' || iac_source || ' (' || coalesce(terraform_module, 'None') || ')' END,
    CASE WHEN NOT managed AND in_current AND NOT excluded THEN 'Not in any IaC state — possible drift' END), '') AS evidence,
  pr_number, pr_author, iac_source, managed AS in_terraform_state, false AS reviewed, excluded
FROM cls""",
    "inv": f"""
SELECT invoice_id, min(billing_period_start) AS billing_period_start, max(billing_period_end) AS billing_period_end,
  CAST(round(sum(billed_cost), 2) AS DECIMAL(18,2)) AS total_billed_cost, count(*) AS total_line_items,
  CAST(round(coalesce(sum(CASE WHEN coalesce(tag_team, '') <> '' THEN billed_cost END), 0), 2) AS DECIMAL(18,2)) AS attributed_cost,
  CAST(round(sum(billed_cost) - coalesce(sum(CASE WHEN coalesce(tag_team, '') <> '' THEN billed_cost END), 0), 2) AS DECIMAL(18,2)) AS unattributed_cost,
  CASE WHEN sum(billed_cost) > 0 THEN {rnd("CAST(coalesce(sum(CASE WHEN coalesce(tag_team, '') <> '' THEN billed_cost END), 0) AS DOUBLE) * 100 / CAST(sum(billed_cost) AS DOUBLE)")} ELSE 0 END AS attribution_coverage_pct,
  'provisional' AS status
FROM bl GROUP BY invoice_id""",
    "alloc": """
SELECT line_id AS billing_line_id, invoice_id, bl.resource_id, bl.billing_period_start,
  CASE WHEN coalesce(r.team, '') <> '' THEN r.team END AS team,
  CASE WHEN coalesce(r.team, '') <> '' THEN r.cost_center END AS cost_center,
  CAST(round(billed_cost, 2) AS DECIMAL(18,2)) AS allocated_cost,
  CASE WHEN r.in_terraform_state AND coalesce(r.team, '') <> '' THEN 'terraform_state'
    WHEN coalesce(r.team, '') <> '' THEN 'tag' WHEN coalesce(r.service_name, '') <> '' THEN 'service_default'
    ELSE 'unattributed' END AS attribution_method,
  CAST(CASE WHEN r.in_terraform_state AND coalesce(r.team, '') <> '' THEN 0.95
    WHEN coalesce(r.team, '') <> '' THEN 0.80 WHEN coalesce(r.service_name, '') <> '' THEN 0.50
    ELSE 0.30 END AS DECIMAL(3,2)) AS confidence_score
FROM bl LEFT JOIN res r ON bl.resource_id = r.resource_id AND bl.billing_period_start = r.billing_period_start""",
    "alloc_sum": """
SELECT resource_id, billing_period_start, sum(allocated_cost) AS total_allocated_cost,
  CAST(sum(confidence_score) AS DOUBLE) / count(*) AS avg_allocation_confidence, count(*) AS allocation_count
FROM alloc WHERE resource_id <> '' GROUP BY ALL""",
    "sbl": "SELECT *, charge_type = 'Credit' AS is_credit, charge_type = 'Usage' AS is_usage FROM bl WHERE charge_type <> 'Credit'",
    "sres": """
SELECT resource_id, billing_period_start, coalesce(resource_name, resource_id) AS resource_name, service_name,
  coalesce(service_category, 'Uncategorized') AS service_category, coalesce(region, 'unknown') AS region, coalesce(provider, 'AWS') AS provider,
  coalesce(team, 'Unattributed') AS team, coalesce(cost_center, 'UNALLOCATED') AS cost_center, in_terraform_state,
  terraform_module, total_cost,
  CASE WHEN in_terraform_state THEN 'managed' WHEN coalesce(team, '') <> '' THEN 'tagged_only' ELSE 'unmanaged' END AS management_status
FROM res""",
    "ltot": """
SELECT invoice_id, billing_period_start, sum(billed_cost) AS line_total, count(*) AS line_count,
  sum(CASE WHEN is_credit THEN billed_cost ELSE 0 END) AS total_credits,
  sum(CASE WHEN is_usage THEN billed_cost ELSE 0 END) AS total_usage FROM sbl GROUP BY ALL""",
    "itot": f"""
SELECT l.invoice_id, billing_period_start, line_total AS total_billed_cost, line_count AS total_line_items, total_credits, total_usage,
  coalesce(a.c, 0) AS attributed_cost, line_total - coalesce(a.c, 0) AS unattributed_cost,
  {pct0('coalesce(a.c, 0)', 'line_total')} AS attribution_coverage_pct,
  abs(line_total - inv.total_billed_cost) AS reconciliation_variance,
  CASE WHEN abs(line_total - inv.total_billed_cost) <= 0.01 THEN 'reconciled' ELSE 'variance_detected' END AS reconciliation_status
FROM ltot l JOIN (SELECT invoice_id, total_billed_cost FROM inv) inv ON l.invoice_id = inv.invoice_id
LEFT JOIN (SELECT invoice_id, sum(allocated_cost) AS c FROM alloc GROUP BY ALL) a ON l.invoice_id = a.invoice_id""",
    "spend": """
SELECT *, lag(total_cost) OVER w AS prior_month_cost, lead(total_cost) OVER w AS next_month_cost,
  row_number() OVER (PARTITION BY service_name, billing_period_start ORDER BY total_cost DESC, resource_id) AS cost_rank_in_service,
  CAST(sum(total_cost) OVER (PARTITION BY resource_id ORDER BY billing_period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE)
    / count(*) OVER (PARTITION BY resource_id ORDER BY billing_period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_raw
FROM sres WINDOW w AS (PARTITION BY resource_id ORDER BY billing_period_start)""",
    "ptot": "SELECT current_period_start AS cps, sum(delta_dollars) AS period_total_delta FROM vr GROUP BY ALL",
    "change_rows": r"""
SELECT CAST(number AS VARCHAR) AS pr_number, file_pos, k AS block_pos, tf_module AS terraform_module, status AS action, b.t AS resource_type, b.n AS resource_name
FROM (
  SELECT number, file_pos, status, tf_module, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS k FROM (
    SELECT *, CASE WHEN contains(filename, '/') THEN regexp_replace(filename, '/[^/]*$', '') ELSE 'root' END AS tf_module,
      CASE WHEN len(rt) > 0 THEN list_transform(range(1, len(rt) + 1), lambda i: {'t': rt[i], 'n': rn[i]})
        WHEN len(ms) > 0 THEN list_transform(ms, lambda m: {'t': 'module', 'n': m})
        ELSE [{'t': 'terraform_file', 'n': filename}] END AS blocks
    FROM (SELECT *, regexp_extract_all(coalesce(patch, ''), 'resource\s+"([^"]+)"\s+"([^"]+)"', 1) AS rt,
        regexp_extract_all(coalesce(patch, ''), 'resource\s+"([^"]+)"\s+"([^"]+)"', 2) AS rn,
        regexp_extract_all(coalesce(patch, ''), 'module\s+"([^"]+)"', 1) AS ms
      FROM pr_file WHERE filename LIKE '%.tf')))""",
    "pr_near": """
SELECT m.billing_period_start, CAST(number AS VARCHAR) AS pr_number, title, author, merged_at, commit_sha FROM prs
JOIN months m ON merged_at BETWEEN m.billing_period_start - INTERVAL 30 DAY AND m.billing_period_start + INTERVAL 31 DAY""",
    "pr_match": f"""
SELECT DISTINCT p.billing_period_start, p.pr_number, r.resource_id
FROM pr_near p JOIN change_rows c ON p.pr_number = c.pr_number JOIN res r ON r.billing_period_start = p.billing_period_start
WHERE (coalesce(r.terraform_module, '') <> '' AND contains(r.terraform_module, c.terraform_module))
  OR (c.resource_name <> '' AND contains(lower(r.resource_name), lower(c.resource_name)))
  OR (contains(lower(r.service_name), {_case('c.resource_type', codes.TYPE_SERVICE_HINTS)})
    AND coalesce(r.terraform_module, '') <> '' AND contains(r.terraform_module, regexp_extract(c.terraform_module, '[^/]*$')))""",
    "flagged": """
SELECT r.resource_id, r.billing_period_start AS p, r.in_terraform_state OR ev.rid IS NOT NULL AS m FROM res r
LEFT JOIN ev ON ev.rid = r.resource_id AND ev.current_period_start = r.billing_period_start""",
    # -- chunks: a line's length and heading, running lengths, and from a chunk's first line the next chunk's
    "chunk_lines": rf"""
SELECT doc_id, k, length(line)::BIGINT AS n, CASE WHEN regexp_matches(bare, '^###? ') THEN trim(ltrim(bare, '#'), {_BLANKS}) END AS head, line
FROM (SELECT doc_id, k, line, trim(line, {_BLANKS}) AS bare FROM (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE regexp_matches(text, '[^\s]'))))""",
    "chunk_lists": """
SELECT doc_id, list(line ORDER BY k) AS lines, list(n ORDER BY k) AS sizes, list_prepend(0::BIGINT, list(upto ORDER BY k)) AS run,
  list({'k': k, 'head': head} ORDER BY k) FILTER (head IS NOT NULL) AS heads
FROM (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT AS upto FROM chunk_lines) GROUP BY doc_id""",
    "chunk_ends": f"""
SELECT doc_id, 0::BIGINT AS chunk_no, 0::BIGINT AS first, {_chunk_end('0', '0')} AS last FROM chunk_lists
UNION ALL
SELECT doc_id, chunk_no + 1, next, {_chunk_end('next', 'last')} FROM (
  SELECT c.doc_id, chunk_no, sizes, run, last, (last - len(list_filter(run[first + 1:last], lambda x: run[last + 1] - x <= {CHUNK_OVERLAP})))::BIGINT AS next
  FROM chunk_ends c JOIN chunk_lists l ON l.doc_id = c.doc_id WHERE last < len(sizes))""",
    "chunks": """
SELECT c.doc_id, chunk_no, array_to_string(lines[first + 1:last], chr(10)) AS text,
  coalesce(list_filter(heads, lambda h: h.k <= last)[-1].head, '') AS section
FROM chunk_ends c JOIN chunk_lists l ON l.doc_id = c.doc_id""",
    # -- vectors nearest to the mean, and those of them that share half their words with no earlier kept one
    "near_mean": """
SELECT vec_id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT list(m ORDER BY i) FROM (
  SELECT i, avg(x) AS m FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))) AS distance
FROM embeddings""",
    "near_words": r"""
SELECT rank, vec_id, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM (
  SELECT row_number() OVER (ORDER BY distance, vec_id) AS rank, vec_id, text, distance FROM near_mean JOIN documents ON doc_id = vec_id)
WHERE rank <= 8 AND distance <= 1.2""",
    "word_clashes": """
SELECT a.rank, list(b.rank) FILTER (least(len(a.words), len(b.words)) > 0 AND len(list_intersect(a.words, b.words)) > 0.5 * least(len(a.words), len(b.words))) AS earlier
FROM near_words a LEFT JOIN near_words b ON b.rank < a.rank GROUP BY a.rank""",
    "kept_ranks": """
SELECT 0::BIGINT AS upto, []::BIGINT[] AS kept UNION ALL
SELECT rank, CASE WHEN len(kept) < 5 AND NOT list_has_any(kept, coalesce(earlier, [])) THEN list_append(kept, rank) ELSE kept END
FROM kept_ranks JOIN word_clashes ON rank = upto + 1""",
    "redelivered": """
SELECT line_id, line_seq, invoice_id, resource_id, charge_period_start, charge_type, billed_cost FROM bl WHERE billing_period_start >= DATE '1997-07-01'
UNION ALL SELECT line_id || '-again', line_seq, invoice_id, resource_id, charge_period_start, charge_type, billed_cost FROM bl
WHERE billing_period_start >= DATE '1997-07-01' AND charge_type = 'Tax'""",
    "tagged": """
SELECT i.*, CASE WHEN nth = 1 AND NOT EXISTS (SELECT 1 FROM bl s WHERE s.billing_period_start < DATE '1998-01-01'
    AND s.invoice_id IS NOT DISTINCT FROM i.invoice_id AND s.resource_id IS NOT DISTINCT FROM i.resource_id
    AND s.charge_period_start IS NOT DISTINCT FROM i.charge_period_start) THEN 'kept' ELSE 'duplicate' END AS load_status
FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id, resource_id, charge_period_start ORDER BY line_seq, line_id) AS nth FROM redelivered) i""",
    # Lines dated by spot lines have no charge date once their date is unreadable.
    "landed_keys": """
SELECT invoice_id, nullif(resource_id, '') AS rid, CASE WHEN charge_type = 'SpotUsage' THEN NULL ELSE charge_period_start END AS charged, charge_type, billing_period_start
FROM redelivered_lines""",
    "streamed": """
SELECT *, CAST(date_trunc('month', charged) AS DATE) AS billing_period_start FROM (
  SELECT DISTINCT 0 AS delivery, invoice_id, nullif(resource_id, '') AS rid, charge_period_start AS charged FROM bl WHERE billing_period_start < DATE '1998-01-01'
  UNION ALL SELECT 1, invoice_id, rid, charged FROM new_keys)""",
    "redelivered_lines": "SELECT * FROM bl WHERE billing_period_start >= DATE '1997-07-01'",
    "new_keys": """
SELECT DISTINCT invoice_id, rid, charged FROM landed_keys k WHERE coalesce(charge_type, '') <> 'Tax' AND NOT EXISTS (
  SELECT 1 FROM bl s WHERE s.billing_period_start < DATE '1998-01-01' AND s.invoice_id IS NOT DISTINCT FROM k.invoice_id
    AND nullif(s.resource_id, '') IS NOT DISTINCT FROM k.rid AND s.charge_period_start IS NOT DISTINCT FROM k.charged)""",
    "drift": f"SELECT * FROM vr WHERE {in_list('reason_code', codes.DRIFT_CODES)}",
    "growth": f"""
SELECT *, current_cost - prior_cost AS delta,
  CASE WHEN prior_cost > 0 THEN {pct('current_cost - prior_cost', 'prior_cost')} ELSE 100.0 END AS pct_change
FROM (SELECT pairs.*, r.resource_id, r.resource_name, r.service_name, coalesce(nullif(r.team, ''), 'Unknown') AS team,
    r.total_cost AS current_cost, coalesce(b.total_cost, 0) AS prior_cost
  FROM pairs JOIN res r ON r.billing_period_start = pairs.current_period_start AND NOT r.in_terraform_state
  LEFT JOIN res b ON b.resource_id = r.resource_id AND b.billing_period_start = pairs.prior_period_start)""",
    "anom": f"""
SELECT {PAIR}, resource_id, coalesce(nullif(resource_name, ''), resource_id) AS resource_name,
  coalesce(nullif(service_name, ''), 'Unknown') AS service, prior_cost, current_cost, delta_dollars, delta_pct, reason_code, team, evidence,
  CAST(abs(delta_dollars) AS DOUBLE) * (1.0 + CAST(abs(delta_pct) AS DOUBLE) / 100) AS severity
FROM vr WHERE abs(delta_dollars) > 500 AND (abs(delta_pct) > 50 OR reason_code IN ('new_resource', 'removed_resource'))""",
    "page_rows": """
SELECT billing_period_start, service_name, CASE WHEN team IS NOT NULL THEN resource_id ELSE '' END AS rid, total_cost AS cost
FROM res WHERE total_cost <> 0""",
}


# Views that a text reads more than once and that are costly.
MATERIALIZED = {"flagged", "ev", "chunk_lists", "near_words"}


def with_views(sql: str, instead: dict[str, str] | None = None) -> str:
    """Puts the views a text mentions in front of it, those they mention first. ``instead`` replaces some."""
    views = CTES | (instead or {})
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                need(views[name])
                order.append(name)

    need(sql)
    texts = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({views[name]})" for name in order)
    return f"WITH RECURSIVE {texts}\n{sql}" if texts else sql


KEY = "resource_id, billing_period_start"
STAGED_SPEND = "CAST(total_cost AS DOUBLE) AS total_cost"
LINES = f"""billing_period_start, billing_period_end, CAST(charge_period_start AS VARCHAR) AS charge_period_start"""
NUMBERS = ", ".join(f"{dbl(c)} AS {c}" for c in ("quantity", "unit_price", "billed_cost", "list_cost"))

LOADED = """(SELECT count(*) FROM redelivered) AS rows_read, (SELECT count(*) FROM redelivered WHERE charge_type = 'Tax') AS errors,
  (SELECT count(*) FROM new_keys) AS rows_inserted,
  (SELECT count(*) FROM redelivered WHERE coalesce(charge_type, '') <> 'Tax') - (SELECT count(*) FROM new_keys) AS rows_skipped"""
BROKEN = """nullif(CASE WHEN description LIKE 'Spot%' THEN description || chr(10) || 'billed "as is", per hour' ELSE description END, '')"""
ARM_SERVICE = """CASE WHEN a.resource_id LIKE '%Microsoft.Compute/virtualMachines/%' THEN 'Virtual Machines'
    WHEN a.resource_id LIKE '%Microsoft.Sql/servers/%' THEN 'SQL Database'
    WHEN a.resource_id LIKE '%Microsoft.Storage/storageAccounts/%' THEN 'Storage'
    WHEN a.resource_id LIKE '%Contoso.Backup%' THEN 'vaultStores'
    WHEN a.resource_id LIKE '%Microsoft.Classic%' THEN 'Virtual MachinesSets' END"""
SELECTS: dict[str, str] = {
    # -- exports
    "scan_focus_csv": f"""SELECT invoice_id, {LINES}, service_name, service_category, nullif(resource_id, '') AS resource_id,
  resource_name, region, charge_type, {BROKEN} AS description, {NUMBERS}, coalesce(provider, 'AWS') AS provider,
  tag_team AS team, tag_environment AS env FROM bl WHERE user_id < 3
UNION ALL SELECT invoice_id, {LINES}, {ARM_SERVICE} AS service_name,
  service_category, a.resource_id, resource_name, region, charge_type, {BROKEN} AS description, {NUMBERS},
  'Azure' AS provider, tag_team AS team, tag_environment AS env
FROM bl JOIN arm_ids a ON CAST(split_part(bl.line_id, '-', 2) AS BIGINT) = a.p_partkey WHERE user_id = 3""",
    "scan_azure_csv": f"""SELECT invoice_id, {LINES}, {ARM_SERVICE} AS service_name,
  service_category, a.resource_id, resource_name, region, charge_type, nullif(description, '') AS description, {NUMBERS},
  'Azure' AS provider, tag_team AS team, tag_environment AS env
FROM bl JOIN arm_ids a ON CAST(split_part(bl.line_id, '-', 2) AS BIGINT) = a.p_partkey""",
    "detect_format": """SELECT 'InvoiceId' AS first_column, 'AWS' AS provider, count(*) AS rows FROM bl WHERE user_id = 1
UNION ALL SELECT 'Provider', 'AWS', count(*) FROM bl WHERE user_id = 2 UNION ALL SELECT 'InvoiceId', 'Azure', count(*) FROM bl WHERE user_id = 3""",
    "map_columns": """SELECT invoice_id, CAST(billing_period_start AS VARCHAR) AS billing_period_start,
  CAST(billing_period_end AS VARCHAR) AS billing_period_end, CAST(charge_period_start AS VARCHAR) AS charge_period_start,
  CAST(charge_period_end AS VARCHAR) AS charge_period_end, service_name, service_category, nullif(resource_id, '') AS resource_id,
  resource_name, region, CAST(NULL AS VARCHAR) AS availability_zone, charge_type, nullif(description, '') AS description,
  CAST(quantity AS VARCHAR) AS quantity, unit, CAST(billed_cost AS VARCHAR) AS billed_cost, CAST(list_cost AS VARCHAR) AS list_cost,
  CAST(effective_cost AS VARCHAR) AS effective_cost, provider FROM bl""",
    "coerce_lines": f"""SELECT line_id, CASE WHEN charge_type = 'SpotUsage' THEN NULL ELSE billing_period_start END AS billing_period_start,
  CASE WHEN charge_type = 'SpotUsage' THEN NULL ELSE CAST(charge_period_start AS VARCHAR) END AS charge_period_start,
  CASE WHEN charge_type = 'Tax' THEN NULL ELSE {dbl('billed_cost')} END AS billed_cost, {dbl('list_cost')} AS list_cost,
  CASE WHEN charge_type = 'Tax' THEN 'billed_cost' ELSE '' END AS rejected,
  CASE WHEN charge_type = 'Tax' THEN NULL ELSE tag_team END AS team FROM bl""",
    "dedup_new_lines": f"SELECT line_id, invoice_id, resource_id, charge_type, {dbl('billed_cost')} AS billed_cost FROM tagged WHERE load_status = 'kept'",
    "load_stats": f"SELECT {LOADED}",
    "load_into": f"SELECT rows_inserted AS rows_stored, * FROM (SELECT {LOADED})",
    "ingest_rejects": f"""SELECT invoice_id, nullif(resource_id, '') AS resource_id, CASE WHEN charge_type = 'SpotUsage' THEN NULL ELSE billing_period_start END AS billing_period_start,
  bad.cell, bad.text, 'not a decimal(18,6)' AS reason FROM (
  SELECT *, unnest(list_concat(CASE WHEN charge_type = 'Tax' THEN [{{'cell': 'billed_cost', 'text': '12 USD'}}] ELSE [] END,
    CASE WHEN invoice_id LIKE '%-3' THEN [{{'cell': 'quantity', 'text': CAST(quantity AS VARCHAR) || ' of 2,5'}}] ELSE [] END)) AS bad FROM bl)""",
    "provider_default": "SELECT coalesce(provider, 'AWS') AS provider, count(*) AS rows FROM bl GROUP BY ALL",
    "azure_service": """SELECT p_partkey, resource_id,
  CASE WHEN resource_id LIKE '%Microsoft.Compute/virtualMachines/%' THEN 'Virtual Machines'
    WHEN resource_id LIKE '%Microsoft.Sql/servers/%' THEN 'SQL Database'
    WHEN resource_id LIKE '%Microsoft.Storage/storageAccounts/%' THEN 'Storage'
    WHEN resource_id LIKE '%Contoso.Backup%' THEN 'vaultStores'
    WHEN resource_id LIKE '%Microsoft.Classic%' THEN 'Virtual MachinesSets' END AS service FROM arm_ids""",
    # -- infrastructure as code
    "scan_tfstate": """SELECT unnest([identifier, 'arn:' || identifier, 'net-' || ordinal]) AS identifier,
  CASE WHEN ordinal % 4 <> 0 THEN module ELSE 'root' END AS module, resource_type, resource_name
FROM iac_listed WHERE iac_source = 'terraform'""",
    "scan_arm": """SELECT unnest(list_distinct(list_filter([key, name], lambda x: x <> ''))) AS identifier, resource_type AS module, resource_type, name AS resource_name FROM (
  SELECT *, CASE WHEN ordinal % 3 <> 0 THEN identifier WHEN ordinal % 4 <> 0 THEN resource_name ELSE '' END AS key,
    CASE WHEN ordinal % 4 <> 0 THEN resource_name ELSE 'unknown' END AS name FROM iac_listed WHERE iac_source = 'arm')""",
    "scan_cloudformation": """SELECT identifier, module, resource_type,
  CASE ordinal % 3 WHEN 0 THEN resource_name WHEN 1 THEN 'bucket-' || resource_name ELSE identifier END AS resource_name
FROM iac_listed WHERE iac_source = 'cloudformation'""",
    "scan_pulumi": """SELECT unnest(list_distinct(list_filter([CASE WHEN ordinal % 2 = 0 THEN 'id-' || ordinal
    WHEN ordinal % 5 <> 0 THEN 'urn:pulumi:prod::app::' || resource_type || '::u-' || ordinal END, identifier], lambda x: x IS NOT NULL))) AS identifier,
  module, resource_type, CASE WHEN ordinal % 5 = 0 THEN 'unknown' WHEN ordinal % 3 = 0 THEN resource_name ELSE 'u-' || ordinal END AS resource_name
FROM iac_listed WHERE iac_source = 'pulumi'""",
    "iac_union": f"SELECT identifier, {big('rank')} AS rank, {big('ordinal')} AS ordinal, module, resource_type, resource_name, iac_source FROM idx",
    "iac_match_exact": "SELECT * FROM exact",
    "iac_match_fuzzy": "SELECT * FROM fuzzy",
    # -- landed pages and exports
    "flatten_aws_cost_pages": f"""SELECT 'AWS-' || strftime(billing_period_start, '%Y-%m') AS invoice_id, billing_period_start,
  last_day(billing_period_start) AS billing_period_end, coalesce(service_name, '') AS service_name,
  CASE WHEN rid <> '' THEN rid ELSE replace(lower(coalesce(service_name, '')), ' ', '-') || '-aggregate' END AS resource_id,
  CASE WHEN rid <> '' THEN regexp_extract(rid, '[^:]*$') ELSE replace(lower(coalesce(service_name, '')), ' ', '-') || '-aggregate' END AS resource_name,
  'us-east-1' AS region, 'Usage' AS charge_type, {dbl('cost')} AS billed_cost FROM page_rows""",
    "flatten_azure_cost_pages": f"""SELECT 'AZ-' || strftime(billing_period_start, '%Y-%m') AS invoice_id, billing_period_start,
  last_day(billing_period_start) AS billing_period_end,
  CASE service_name WHEN 'Amazon EC2' THEN 'Virtual Machines' WHEN 'Amazon S3' THEN 'Storage Accounts' WHEN 'AWS Lambda' THEN 'Functions' ELSE '' END AS service_name,
  rid2 AS resource_id, CASE WHEN contains(rid2, '/') THEN regexp_extract(rid2, '[^/]*$') ELSE rid2 END AS resource_name,
  'Usage' AS charge_type, {dbl('cost')} AS billed_cost
FROM (SELECT *, CASE WHEN rid <> '' THEN rid ELSE 'azure-' || CASE service_name WHEN 'Amazon EC2' THEN 'microsoft.compute-virtualmachines'
  WHEN 'Amazon S3' THEN 'microsoft.storage-storageaccounts' WHEN 'AWS Lambda' THEN 'functions' ELSE 'subscription' END || '-aggregate' END AS rid2 FROM page_rows)""",
    "scan_pr_events": f"""SELECT CAST(p.number AS VARCHAR) AS pr_number, title, author, merged_at, commit_sha, {big('count(*)')} AS tf_files
FROM prs p JOIN pr_file f ON p.number = f.number WHERE filename LIKE '%.tf' AND merged_at BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY ALL""",
    "scan_docs": "SELECT doc_id, length(text) AS chars, NOT regexp_matches(text, '[^\\s]') AS blank FROM documents",
    # -- silver
    "invoices": f"""SELECT invoice_id, billing_period_start, billing_period_end, {dbl('total_billed_cost')} AS total_billed_cost, total_line_items,
  {dbl('attributed_cost')} AS attributed_cost, {dbl('unattributed_cost')} AS unattributed_cost, attribution_coverage_pct, status FROM inv""",
    "resources": f"SELECT * REPLACE ({dbl('total_cost')} AS total_cost) FROM res",
    "resource_tags": f"SELECT {KEY}, tag_team AS team, tag_cost_center AS cost_center, tag_environment AS env FROM last_tags",
    "resource_signals": f"""SELECT {KEY}, array_to_string(charge_types, ',') AS charge_types, description, other_tool FROM sig""",
    "environment": f"SELECT environment, billing_period_start, count(*) AS resources, {dbl('sum(total_cost)')} AS cost FROM res GROUP BY ALL",
    "logical_resources": """
SELECT c.billing_period_start, c.resource_id AS logical_resource_id, c.resource_name AS logical_resource_name, c.kind AS resource_type,
  r.resource_id AS child_resource_id,
  CASE WHEN r.resource_id = c.resource_id THEN CASE c.kind WHEN 'eks_cluster' THEN 'cluster' ELSE 'primary' END
    WHEN c.kind = 'eks_cluster' THEN CASE WHEN contains(r.svc, 'ec2') OR contains(r.svc, 'instance') THEN 'node'
      WHEN contains(r.svc, 'ebs') OR contains(r.nm, 'vol') THEN 'volume' WHEN contains(r.svc, 'elb') OR contains(r.svc, 'load') THEN 'load_balancer'
      WHEN contains(r.nm, 'nat') THEN 'nat_gateway' ELSE 'associated' END
    WHEN contains(r.nm, 'replica') OR contains(r.nm, 'reader') THEN 'replica' WHEN contains(r.nm, 'storage') THEN 'storage' ELSE 'associated' END AS relationship
FROM (SELECT *, lower(resource_name) AS nm, CASE WHEN contains(lower(service_name), 'eks') THEN 'eks_cluster' ELSE 'rds_cluster' END AS kind
  FROM res WHERE in_terraform_state AND (contains(lower(service_name), 'eks') OR contains(lower(service_name), 'rds') OR contains(lower(service_name), 'aurora'))) c
JOIN (SELECT *, lower(resource_name) AS nm, lower(coalesce(service_name, '')) AS svc FROM res) r
  ON r.billing_period_start = c.billing_period_start AND contains(r.nm, c.nm)
WHERE r.resource_id = c.resource_id OR c.kind = 'eks_cluster' OR contains(r.svc, 'rds') OR contains(r.svc, 'aurora')""",
    # -- allocation
    "allocate_lines": f"SELECT * REPLACE ({dbl('allocated_cost')} AS allocated_cost, {dbl('confidence_score')} AS confidence_score) FROM alloc",
    "allocation_method": f"SELECT attribution_method, {dbl('confidence_score')} AS confidence_score, count(*) AS rows, {dbl('sum(allocated_cost)')} AS cost FROM alloc GROUP BY attribution_method, alloc.confidence_score",
    "allocation_summary": f"""SELECT {KEY}, {dbl('sum(allocated_cost)')} AS total_allocated_cost,
  {rnd('CAST(sum(confidence_score) AS DOUBLE) / count(*)', 4)} AS avg_allocation_confidence, count(*) AS allocation_count FROM alloc GROUP BY {KEY}""",
    "invoice_coverage": f"""SELECT invoice_id, billing_period_start, {dbl('total_billed_cost')} AS total_billed_cost, {rnd(pct('count(team)', 'count(*)'))} AS attribution_coverage_pct
FROM inv JOIN (SELECT billing_period_start, team FROM alloc) USING (billing_period_start) GROUP BY invoice_id, billing_period_start, total_billed_cost""",
    "allocation_coverage": f"""SELECT billing_period_start, count(*) AS total_lines, count(team) AS attributed_lines,
  {rnd('CAST(count(team) AS DOUBLE) * 100 / count(*)')} AS attribution_coverage_pct FROM alloc GROUP BY ALL""",
    # -- events
    "change_event_match": "SELECT rid AS resource_id, current_period_start, pr_number, pr_title, pr_author, description, event_date FROM ev",
    "tf_diff_changes": "SELECT pr_number, terraform_module, action, resource_type, resource_name FROM change_rows",
    "pr_resource_match": "SELECT * FROM pr_match",
    "pr_change_events": """SELECT m.billing_period_start, m.resource_id, 'github_pr' AS event_type, p.merged_at AS event_date, p.pr_number, p.title AS pr_title,
  p.author AS pr_author, h.terraform_module, 'PR #' || p.pr_number || ': ' || p.title AS description
FROM pr_match m JOIN pr_near p ON m.pr_number = p.pr_number AND m.billing_period_start = p.billing_period_start
JOIN (SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY file_pos, block_pos, terraform_module) AS n FROM change_rows) h ON h.pr_number = m.pr_number AND h.n = 1
UNION ALL
SELECT p.billing_period_start, 'tf:' || h.terraform_module || '/' || h.resource_name, 'github_pr', p.merged_at, p.pr_number, p.title, p.author, h.terraform_module,
  'PR #' || p.pr_number || ': ' || p.title || ' (' || h.action || ' ' || h.resource_type || '.' || h.resource_name || ')'
FROM pr_near p JOIN (SELECT *, row_number() OVER (PARTITION BY pr_number ORDER BY file_pos, block_pos) AS n FROM change_rows) h ON h.pr_number = p.pr_number AND h.n <= 3
WHERE NOT EXISTS (SELECT 1 FROM pr_match m WHERE m.pr_number = p.pr_number AND m.billing_period_start = p.billing_period_start)""",
    # -- variance
    "consecutive_pairs": "SELECT * FROM pairs",
    "variance_pairs": f"SELECT {PAIR}, resource_id, {dbl('prior_given')} AS prior_cost, {dbl('current_given')} AS current_cost FROM amounts",
    "variance_amounts": f"""SELECT {PAIR}, resource_id, in_prior, in_current, {rnd('prior_raw')} AS prior_cost, {dbl('current_cost')} AS current_cost,
  {rnd('delta_raw')} AS delta, {rnd('pct_raw')} AS delta_pct, {rnd('norm_pct')} AS norm_pct FROM amounts""",
    "edge_reason": f"SELECT {KEY}, edge FROM sig",
    "classify": f"SELECT {PAIR}, resource_id, reason_code, excluded FROM cls",
    "confidence": f"SELECT {PAIR}, reason_code, {dbl('confidence_score')} AS confidence_score, count(*) AS rows FROM vr GROUP BY {PAIR}, reason_code, vr.confidence_score",
    "evidence_chain": f"""SELECT {PAIR}, resource_id, {big('step_no')} AS step_no, s.step, s.result, s.detail, {dbl('prior_raw')} AS prior_cost,
  {dbl('current_cost')} AS current_cost, {rnd('pct_raw', 4)} AS delta_pct, managed AS in_iac, iac_source, terraform_module AS iac_module,
  array_to_string(charge_types, ',') AS charge_types FROM (
  SELECT * REPLACE (coalesce(charge_types, []) AS charge_types), unnest(steps) AS s, generate_subscripts(steps, 1) - 1 AS step_no FROM (
    SELECT *, CASE WHEN excluded THEN [{{'step': 'edge_case_detection', 'result': reason_code,
          'detail': 'Charge types [' || array_to_string(list_transform(charge_types, lambda x: '''' || x || ''''), ', ') || '] matched edge case pattern'}}]
      WHEN NOT in_prior THEN [{{'step': 'period_presence', 'result': reason_code, 'detail': 'Resource not found in prior period'}}]
      WHEN NOT in_current THEN [{{'step': 'period_presence', 'result': reason_code, 'detail': 'Resource not found in current period'}}]
      ELSE [{{'step': 'iac_lookup', 'result': CASE WHEN managed THEN 'managed' ELSE 'unmanaged' END,
          'detail': CASE WHEN managed THEN 'Source: ' || iac_source || ', module: ' || coalesce(terraform_module, 'None') ELSE 'Not found in any IaC state' END}},
        {{'step': 'change_event_match', 'result': CASE WHEN has_event THEN 'matched' ELSE 'no_match' END,
          'detail': CASE WHEN has_event THEN 'PR #' || coalesce(pr_number, 'None') || ': ' || coalesce(pr_title, 'None') ELSE 'No change events found within window' END}},
        {{'step': 'classification', 'result': reason_code, 'detail': 'Delta ' || CASE WHEN pct_raw IS NULL THEN 'N/A (new baseline)' ELSE {txt('pct_raw', 1)} || '%' END
          || ', IaC=' || CASE WHEN managed THEN 'True' ELSE 'False' END || ', change_event=' || CASE WHEN has_event THEN 'yes' ELSE 'no' END}}] END AS steps FROM cls))""",
    "evidence_text": f"SELECT {PAIR}, resource_id, evidence, pr_number, pr_author FROM vr",
    "variance_report": "SELECT * REPLACE (" + ", ".join(
        f"{dbl(c)} AS {c}" for c in ("prior_cost", "current_cost", "delta_dollars", "delta_pct", "confidence_score")
    ) + ") FROM vr",
    # -- models
    "stg_billing_lines": "SELECT line_id, invoice_id, billing_period_start, charge_type, " + ", ".join(
        f"{dbl(c)} AS {c}" for c in ("quantity", "unit_price", "billed_cost", "list_cost", "effective_cost")
    ) + ", is_credit, is_usage FROM sbl",
    "stg_resources": f"SELECT * REPLACE ({dbl('total_cost')} AS total_cost) FROM sres",
    "line_totals_by_invoice": f"""SELECT invoice_id, billing_period_start, {dbl('line_total')} AS line_total, line_count,
  {dbl('total_credits')} AS total_credits, {dbl('total_usage')} AS total_usage FROM ltot""",
    "int_invoice_totals": "SELECT * REPLACE (" + ", ".join(
        f"{dbl(c)} AS {c}" for c in ("total_billed_cost", "total_credits", "total_usage", "attributed_cost", "unattributed_cost", "reconciliation_variance")
    ) + ") FROM itot",
    "prior_month_cost": f"SELECT {KEY}, {STAGED_SPEND}, {dbl('prior_month_cost')} AS prior_month_cost FROM spend",
    "next_month_cost": f"SELECT {KEY}, {STAGED_SPEND}, {dbl('next_month_cost')} AS next_month_cost FROM spend",
    "cost_rank_in_service": f"SELECT {KEY}, service_name, cost_rank_in_service FROM spend",
    "rolling_3m_avg": f"SELECT {KEY}, {rnd('rolling_raw', 4)} AS rolling_3m_avg_cost FROM spend",
    "mom_delta": f"""SELECT {KEY}, {dbl('total_cost - coalesce(prior_month_cost, 0)')} AS mom_delta_dollars,
  CASE WHEN prior_month_cost > 0 THEN {rnd(pct('total_cost - prior_month_cost', 'prior_month_cost'))} END AS mom_delta_pct,
  billing_period_start AS billing_month FROM spend""",
    "int_monthly_resource_spend": f"""SELECT {KEY}, resource_name, service_name, team, cost_center, in_terraform_state, {STAGED_SPEND},
  {dbl('prior_month_cost')} AS prior_month_cost, {dbl('next_month_cost')} AS next_month_cost, cost_rank_in_service,
  {dbl('total_cost - coalesce(prior_month_cost, 0)')} AS mom_delta_dollars,
  CASE WHEN prior_month_cost > 0 THEN {rnd(pct('total_cost - prior_month_cost', 'prior_month_cost'))} END AS mom_delta_pct,
  {rnd('rolling_raw', 4)} AS rolling_3m_avg_cost, billing_period_start AS billing_month FROM spend""",
    "latest_resource": f"""SELECT * EXCLUDE (rn) REPLACE ({dbl('total_cost')} AS total_cost) FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY billing_period_start DESC) AS rn FROM sres) WHERE rn = 1""",
    "drift_summary_lifetime": f"""SELECT resource_id, {dbl('sum(CASE WHEN NOT in_terraform_state THEN total_cost ELSE 0 END)')} AS total_drift_spend,
  {dbl('sum(CASE WHEN in_terraform_state THEN total_cost ELSE 0 END)')} AS total_managed_spend,
  count(DISTINCT billing_period_start) AS periods_observed FROM sres GROUP BY ALL""",
    "dim_resources": f"""SELECT l.* EXCLUDE (rn, total_cost, billing_period_start), {dbl('l.total_cost')} AS latest_period_cost,
  l.billing_period_start AS latest_billing_period, total_drift_spend, total_managed_spend, periods_observed
FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY billing_period_start DESC) AS rn FROM sres) l
JOIN (SELECT resource_id AS rid, {dbl('sum(CASE WHEN NOT in_terraform_state THEN total_cost ELSE 0 END)')} AS total_drift_spend,
  {dbl('sum(CASE WHEN in_terraform_state THEN total_cost ELSE 0 END)')} AS total_managed_spend,
  count(DISTINCT billing_period_start) AS periods_observed FROM sres GROUP BY ALL) s ON l.resource_id = s.rid WHERE rn = 1""",
    "fct_variance_report": f"""SELECT substr(sha256(vr.resource_id || '|' || CAST(prior_period_start AS VARCHAR) || '|' || CAST(current_period_start AS VARCHAR)), 1, 16) AS id,
  vr.resource_id, vr.resource_name, vr.service_name, vr.team, vr.cost_center, {PAIR}, {dbl('prior_cost')} AS prior_cost, {dbl('current_cost')} AS current_cost,
  {dbl('delta_dollars')} AS delta_dollars, {dbl('delta_pct')} AS delta_pct, reason_code, {dbl('vr.confidence_score')} AS confidence_score, evidence, pr_number, pr_author,
  vr.in_terraform_state, reviewed, r.service_category, r.region, r.terraform_module, {dbl('coalesce(total_allocated_cost, 0)')} AS allocated_cost,
  {rnd('avg_allocation_confidence', 4)} AS avg_allocation_confidence, allocation_count,
  CASE WHEN abs(delta_pct) > 20 THEN 'large' WHEN abs(delta_pct) > 5 THEN 'medium' ELSE 'small' END AS delta_bucket,
  {_case('reason_code', codes.REASON_TEXT, "'Unknown'")} AS reason_description,
  {in_list('reason_code', codes.DRIFT_CODES)} AND current_cost > 1000 AS high_priority_drift,
  {dbl('period_total_delta')} AS period_total_delta,
  CASE WHEN period_total_delta <> 0 THEN {rnd(pct('delta_dollars', 'period_total_delta'))} ELSE 0.0 END AS pct_of_total_variance
FROM vr LEFT JOIN res r ON vr.resource_id = r.resource_id AND r.billing_period_start = vr.current_period_start
LEFT JOIN alloc_sum a ON vr.resource_id = a.resource_id AND a.billing_period_start = vr.current_period_start
LEFT JOIN ptot ON cps = current_period_start""",
    "delta_bucket": """SELECT current_period_start, CASE WHEN abs(delta_pct) > 20 THEN 'large' WHEN abs(delta_pct) > 5 THEN 'medium' ELSE 'small' END AS delta_bucket,
  count(*) AS rows FROM vr GROUP BY ALL""",
    "reason_description": f"SELECT reason_code, {_case('reason_code', codes.REASON_TEXT, chr(39) + 'Unknown' + chr(39))} AS reason_description, count(*) AS rows FROM vr GROUP BY ALL",
    "high_priority_drift": f"SELECT {PAIR}, resource_id, reason_code, {dbl('current_cost')} AS current_cost FROM drift WHERE current_cost > 1000",
    "reason_code_totals": f"""SELECT current_period_start, {dbl(f"sum(CASE WHEN {in_list('reason_code', codes.DRIFT_CODES)} THEN delta_dollars ELSE 0 END)")} AS total_drift_delta, """
    + ", ".join(
        f"""{dbl(f"sum(CASE WHEN reason_code = '{code}' THEN delta_dollars ELSE 0 END)")} AS {name}"""
        for code, name in (("planned", "total_planned_delta"), ("new_resource", "total_new_delta"), ("removed_resource", "total_removed_delta"),
                           ("usage_growth", "total_usage_growth_delta"), ("price_change", "total_price_change_delta"))
    ) + f", {dbl('sum(delta_dollars)')} AS period_total_delta FROM vr GROUP BY ALL",
    "pct_of_total_variance": f"""SELECT {PAIR}, resource_id, {dbl('period_total_delta')} AS period_total_delta,
  CASE WHEN period_total_delta <> 0 THEN {rnd(pct('delta_dollars', 'period_total_delta'))} ELSE 0.0 END AS pct_of_total_variance
FROM vr JOIN ptot ON cps = current_period_start""",
    "cost_reconciliation": f"""SELECT resource_id, {dbl('a')} AS total_a, {dbl('b')} AS total_b, {dbl('abs(a - b)')} AS difference FROM (
  SELECT resource_id, sum(billed_cost) AS a, coalesce(sum(CASE WHEN charge_type <> 'Credit' THEN billed_cost END), 0) AS b
  FROM bl WHERE resource_id <> '' GROUP BY ALL) WHERE abs(a - b) > 0.01""",
    "tf_status_flips": """SELECT a.resource_id, b.p AS period_2, a.p AS period_1, a.m AS tf_period_1, b.m AS tf_period_2
FROM flagged a JOIN flagged b ON a.resource_id = b.resource_id AND b.p > a.p AND a.m <> b.m
WHERE NOT EXISTS (SELECT 1 FROM vr WHERE vr.resource_id = a.resource_id AND vr.current_period_start = b.p AND reason_code IN ('new_resource', 'removed_resource'))""",
    "variance_missing_resources": """SELECT resource_id, billing_period_start FROM res
WHERE billing_period_start <> (SELECT min(billing_period_start) FROM res)
  AND NOT EXISTS (SELECT 1 FROM vr WHERE vr.resource_id = res.resource_id AND vr.current_period_start = res.billing_period_start AND NOT excluded)""",
    "invoice_line_mismatch": f"""SELECT i.invoice_id, {dbl('total_billed_cost')} AS total_billed_cost, {dbl('t')} AS line_total, {dbl('abs(total_billed_cost - t)')} AS difference
FROM inv i JOIN (SELECT invoice_id, sum(billed_cost) AS t FROM sbl GROUP BY ALL) s ON i.invoice_id = s.invoice_id WHERE abs(total_billed_cost - t) > 0.01""",
    # -- star schema and sinks
    "dim_merge_insert": """SELECT 'services' AS dimension, service_name AS natural_key, min(service_category) AS attributes FROM res WHERE service_name IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'teams', team, coalesce(old, new, '-') FROM (
  SELECT team, min(coalesce(cost_center, '')) FILTER (billing_period_start < DATE '1998-01-01') AS old0, nullif(old0, '') AS old1,
    min(coalesce(cost_center, '')) AS new0, CASE WHEN old0 IS NOT NULL THEN coalesce(old1, '-') END AS old, coalesce(nullif(new0, ''), '-') AS new
  FROM res WHERE team IS NOT NULL GROUP BY team)
UNION ALL SELECT 'periods', CAST(billing_period_start AS VARCHAR), year(billing_period_start) || '|' || month(billing_period_start) || '|' || strftime(billing_period_start, '%Y-%m') || '|' || day(last_day(billing_period_start))
  FROM (SELECT DISTINCT billing_period_start FROM res)""",
    "load_fact_variance": f"""SELECT resource_id, service_name, team, strftime(prior_period_start, '%Y-%m') AS prior_period, strftime(current_period_start, '%Y-%m') AS current_period,
  {dbl('prior_cost')} AS prior_cost, {dbl('current_cost')} AS current_cost, {dbl('delta_dollars')} AS delta_dollars, {dbl('delta_pct')} AS delta_pct, reason_code,
  {dbl('confidence_score')} AS confidence_score, in_terraform_state, iac_source FROM vr""",
    "trend_by_period_dim": f"SELECT strftime(billing_period_start, '%Y-%m') AS period, {dbl('sum(billed_cost)')} AS cost, min(billing_period_start) AS first_period FROM sbl GROUP BY 1",
    "export_period_tables": """SELECT billing_period_start AS period, count(*) AS rows, count(*) FILTER (NOT in_terraform_state) AS unmanaged, 'resources' AS "table" FROM res GROUP BY 1
UNION ALL SELECT current_period_start, count(*), count(*) FILTER (NOT in_terraform_state), 'variance' FROM vr GROUP BY 1""",
    "replace_period_pair": f"SELECT {PAIR}, count(*) AS rows, {dbl('sum(delta_dollars)')} AS delta FROM vr WHERE current_period_start >= DATE '1993-01-01' GROUP BY {PAIR}",
    "upsert_invoices": f"""SELECT invoice_id, billing_period_start, {dbl('total_billed_cost')} AS total_billed_cost, total_line_items,
  CASE WHEN billing_period_start < DATE '1998-01-01' THEN 'stale' ELSE status END AS status FROM inv WHERE billing_period_start >= DATE '1993-01-01'""",
    "upsert_resources": f"""SELECT {KEY}, CASE WHEN billing_period_start < DATE '1998-01-01' THEN 'stale' ELSE team END AS team, {STAGED_SPEND} FROM res
WHERE billing_period_start >= DATE '1993-01-01'""",
    "tenant_replace": f"""SELECT {big('user_id')} AS user_id, count(*) AS rows, {dbl('sum(billed_cost)')} AS cost FROM bl
WHERE user_id = 1 OR user_id = 2 AND billing_period_start >= DATE '1998-01-01' GROUP BY bl.user_id""",
    "incremental_ingest": "SELECT billing_period_start, count(*) AS rows FROM streamed GROUP BY ALL",
    "ingest_ledger": """SELECT ingest_batch, rows_read, rows_inserted, rows_read - errors - rows_inserted AS rows_skipped, errors, ingest_batch = 1 AS quarantined, periods FROM (
  SELECT 0::BIGINT AS ingest_batch, count(*) AS rows_read, 0::BIGINT AS errors FROM bl WHERE billing_period_start < DATE '1998-01-01'
  UNION ALL SELECT 1, count(*), count(*) FILTER (charge_type = 'Tax') FROM redelivered_lines)
JOIN (SELECT delivery AS ingest_batch, count(*) AS rows_inserted, count(DISTINCT billing_period_start) + max((billing_period_start IS NULL)::BIGINT) AS periods
  FROM streamed GROUP BY delivery) USING (ingest_batch)""",
    "gl_export": f"""SELECT strftime(current_period_start, '%Y-%m-%d') AS "Date", '6' || upper(substr(coalesce(nullif(service_name, ''), 'CLD'), 1, 3)) || '00' AS "Account",
  resource_name || ' — ' || replace(reason_code, '_', ' ') AS "Description",
  CAST(CASE WHEN delta_dollars > 0 THEN abs(delta_dollars) ELSE 0 END AS VARCHAR) AS "Debit",
  CAST(CASE WHEN delta_dollars < 0 THEN abs(delta_dollars) ELSE 0 END AS VARCHAR) AS "Credit", reason_code AS "Reason", coalesce(service_name, '') AS "Service" FROM vr""",
    # -- filters
    "period_filter": f"SELECT {KEY}, service_name, {STAGED_SPEND} FROM res WHERE billing_period_start = DATE '1998-02-01'",
    "periods": "SELECT DISTINCT strftime(billing_period_start, '%Y-%m') AS period FROM bl",
    "detected_providers": "SELECT DISTINCT provider FROM bl WHERE provider <> ''",
    "resources_by_filter": f"""SELECT {PAIR}, resource_id, service_name, team, {dbl('current_cost')} AS current_cost, {dbl('delta_dollars')} AS delta_dollars FROM vr
WHERE service_name ILIKE '%amazon%' AND team = 'platform' AND current_cost >= 300 AND in_terraform_state
ORDER BY abs(vr.delta_dollars) DESC, resource_id, current_period_start LIMIT 20""",
    "direction_filter": f"""SELECT {PAIR}, count(*) AS rows, {dbl('sum(delta_dollars)')} AS delta, 'increases' AS direction FROM vr WHERE delta_dollars > 0 GROUP BY {PAIR}
UNION ALL SELECT {PAIR}, count(*), {dbl('sum(delta_dollars)')}, 'decreases' FROM vr WHERE delta_dollars < 0 GROUP BY {PAIR}
UNION ALL SELECT {PAIR}, count(*), {dbl('sum(delta_dollars)')}, 'both' FROM vr GROUP BY {PAIR}""",
    "drift_rows": f"SELECT {PAIR}, resource_id, reason_code, {dbl('delta_dollars')} AS delta_dollars FROM drift",
    "tenant_scope": f"SELECT billing_period_start, count(*) AS rows, {dbl('sum(billed_cost)')} AS cost FROM bl WHERE user_id = 2 GROUP BY ALL",
    "tenant_variance": f"""SELECT {big('2')} AS user_id, {PAIR}, resource_id, service_name, team, {dbl('prior_cost')} AS prior_cost, {dbl('current_cost')} AS current_cost,
  {dbl('delta_dollars')} AS delta_dollars, reason_code, evidence, pr_number, in_terraform_state FROM vr""",
    "tenant_invoices": f"""SELECT {big('2')} AS user_id, invoice_id, billing_period_start, {dbl('total_billed_cost')} AS total_billed_cost, total_line_items,
  {dbl('attributed_cost')} AS attributed_cost FROM inv""",
    "tenant_allocations": f"""SELECT {big('2')} AS user_id, billing_line_id, resource_id, billing_period_start, team, {dbl('allocated_cost')} AS allocated_cost, attribution_method,
  {dbl('confidence_score')} AS confidence_score FROM alloc WHERE resource_id <> ''""",
    "redact_secrets": "SELECT doc_id, regexp_replace(regexp_replace(text, 'AKIA[A-Z0-9]{12,}', '[REDACTED]', 'g'), '[A-Za-z0-9/+=]{40,}', '[REDACTED]', 'g') AS text FROM documents",
    # -- reports on variance
    "variance_summary": f"""SELECT {PAIR}, reason_code, count(*) AS rows, {dbl('sum(delta_dollars)')} AS dollars, {dbl('any_value(t)')} AS total_delta, any_value(a) AS attribution_coverage_pct
FROM vr JOIN (SELECT prior_period_start AS pp, current_period_start AS cc, sum(delta_dollars) AS t,
  {rnd('CAST(count(*) FILTER (confidence_score >= 0.70) AS DOUBLE) * 100 / count(*)')} AS a FROM vr GROUP BY ALL) ON pp = prior_period_start AND cc = current_period_start
GROUP BY {PAIR}, reason_code""",
    "variance_by_service": f"""SELECT {PAIR}, coalesce(service_name, 'Unknown') AS service, {dbl('sum(delta_dollars)')} AS delta, {dbl('sum(abs(delta_dollars))')} AS abs_delta,
  count(*) AS resources, {dbl('sum(vr.prior_cost)')} AS prior_cost, {dbl('sum(vr.current_cost)')} AS current_cost FROM vr GROUP BY {PAIR}, service""",
    "variance_by_reason": f"""SELECT {PAIR}, reason_code, {dbl('sum(delta_dollars)')} AS delta, {dbl('sum(abs(delta_dollars))')} AS abs_delta, count(*) AS resources
FROM vr GROUP BY {PAIR}, reason_code""",
    "variance_totals": f"""SELECT {PAIR}, {dbl('coalesce(sum(delta_dollars) FILTER (delta_dollars > 0), 0)')} AS total_increases,
  {dbl('coalesce(sum(delta_dollars) FILTER (delta_dollars < 0), 0)')} AS total_decreases, {dbl('sum(delta_dollars)')} AS net_change,
  {dbl('sum(abs(delta_dollars))')} AS total_variance FROM vr GROUP BY {PAIR}""",
}

_BUCKET = (
    f"CASE WHEN reason_code = 'planned' THEN 'planned' WHEN {in_list('reason_code', codes.USAGE_CODES)} THEN 'usage' "
    f"WHEN {in_list('reason_code', codes.EDGE_CODES)} THEN 'edge_cases' ELSE 'drift' END"
)
_DRIFT = in_list("reason_code", codes.DRIFT_CODES)


def _top(rows: str, group: str, order: str, n: int, cells: str, rank: str = "rank") -> str:
    return f"SELECT {cells}, {rank} FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS {rank} FROM {rows}) WHERE {rank} <= {n}"


def _sums(condition: str, value: str, name: str) -> str:
    return f"{dbl(f'coalesce(sum({value}) FILTER ({condition}), 0)')} AS {name}"


_BIG_FIRST = "abs(delta_dollars) DESC, resource_id"
_DELTA = f"{dbl('delta_dollars')} AS delta_dollars"

SELECTS |= {
    "root_causes": f"""SELECT {PAIR}, b.bucket, {_sums('k = b.bucket', 'abs(delta_dollars)', 'amount')}, {_sums('k = b.bucket', 'delta_dollars', 'delta')},
  count(*) FILTER (k = b.bucket) AS rows
FROM (SELECT *, {_BUCKET} AS k FROM vr), (SELECT unnest(['planned', 'drift', 'usage', 'edge_cases']) AS bucket) b GROUP BY {PAIR}, b.bucket""",
    "root_cause_summary_mcp": f"""SELECT {PAIR}, bucket, {dbl('sum(delta_dollars)')} AS delta, count(*) AS rows FROM (SELECT *, {_BUCKET} AS bucket FROM vr) WHERE bucket <> 'edge_cases' GROUP BY {PAIR}, bucket""",
    "top3_per_reason": _top("vr", f"{PAIR}, reason_code", _BIG_FIRST, 3, f"{PAIR}, reason_code, resource_id, resource_name, service_name, {_DELTA}"),
    "top5_per_bucket": _top(f"(SELECT *, {_BUCKET} AS bucket FROM vr)", f"{PAIR}, bucket", _BIG_FIRST, 5, f"{PAIR}, bucket, resource_id, resource_name, service_name, {_DELTA}"),
    "top5_per_drift_reason": _top("drift", f"{PAIR}, reason_code", _BIG_FIRST, 5, f"{PAIR}, reason_code, resource_id, resource_name, {dbl('current_cost')} AS current_cost, {_DELTA}"),
    "action_items": _top(
        "drift", PAIR, _BIG_FIRST, 5,
        f"{PAIR}, resource_id, resource_name, coalesce(nullif(service_name, ''), 'Unknown') AS service, {_DELTA}, reason_code, "
        f"CASE WHEN {in_list('reason_code', codes.IMPORT_CODES)} THEN 'Import to Terraform' ELSE 'Investigate drift' END AS action",
    ),
    "engineering_view": f"""SELECT {PAIR}, count(*) FILTER (in_terraform_state) AS managed_count, count(*) FILTER (NOT in_terraform_state) AS unmanaged_count,
  {_sums('in_terraform_state', 'current_cost', 'managed_cost')}, {_sums('NOT in_terraform_state', 'current_cost', 'unmanaged_cost')}, {dbl('sum(current_cost)')} AS total_cost,
  count(*) FILTER (reason_code = 'planned') AS planned_count, {_sums("reason_code = 'planned'", 'abs(delta_dollars)', 'planned_total')},
  count(*) FILTER ({_DRIFT}) AS drift_count, {_sums(_DRIFT, 'abs(delta_dollars)', 'drift_total')}, count(*) AS total_resources FROM vr GROUP BY {PAIR}""",
    "iac_sources": f"""SELECT {PAIR}, source, resources, {dbl('cost')} AS cost, {rnd(pct('resources', 't'), 1)} AS share_pct FROM (
  SELECT *, sum(resources) OVER (PARTITION BY {PAIR}) AS t FROM (SELECT {PAIR}, iac_source AS source, count(*) AS resources, sum(current_cost) AS cost FROM vr GROUP BY ALL))""",
    "team_rollup": f"""SELECT {PAIR}, coalesce(nullif(team, ''), 'Untagged') AS team, count(*) AS resources, {dbl('sum(current_cost)')} AS cost,
  {dbl('sum(delta_dollars)')} AS delta, count(*) FILTER (in_terraform_state) AS managed FROM vr GROUP BY {PAIR}, coalesce(nullif(team, ''), 'Untagged')""",
    "drift_report": f"""SELECT {PAIR}, count(*) AS total_resources, count(*) FILTER ({_DRIFT}) AS drift_count, count(*) FILTER (NOT {_DRIFT}) AS non_drift_count,
  count(*) FILTER (in_terraform_state) AS in_iac_count, {_sums(_DRIFT, 'current_cost', 'drift_cost')}, {_sums('in_terraform_state', 'current_cost', 'in_iac_cost')},
  {rnd(f'CAST(count(*) FILTER (NOT {_DRIFT}) AS DOUBLE) * 100 / count(*)', 0)} AS coverage_pct FROM vr GROUP BY {PAIR}""",
    "packet_rollups": f"""SELECT {PAIR}, reason_code, {dbl('amount')} AS amount, rows, {pct0('amount', 't', 0)} AS share_pct, {_case('reason_code', codes.PACKET_REASON_TEXT, "''")} AS description FROM (
  SELECT *, sum(amount) OVER (PARTITION BY {PAIR}) AS t FROM (SELECT {PAIR}, reason_code, sum(abs(delta_dollars)) AS amount, count(*) AS rows FROM vr GROUP BY ALL))""",
    "packet_services": _top(f"(SELECT {PAIR}, service_name, sum(abs(delta_dollars)) AS a FROM vr GROUP BY ALL)", PAIR, "a DESC, service_name NULLS FIRST", 6, f"{PAIR}, service_name, {dbl('a')} AS amount"),
    "packet_journal": f"""SELECT {PAIR}, {_sums("reason_code = 'planned'", 'abs(delta_dollars)', 'planned_total')}, {_sums(_DRIFT, 'abs(delta_dollars)', 'drift_total')},
  {_sums(in_list('reason_code', codes.USAGE_CODES), 'abs(delta_dollars)', 'usage_total')}, count(*) FILTER ({_DRIFT}) AS drift_count FROM vr GROUP BY {PAIR}""",
    "top_variance": f"SELECT {PAIR}, resource_id, {dbl('vr.delta_dollars')} AS delta_dollars, reason_code FROM vr ORDER BY abs(vr.delta_dollars) DESC, resource_id, current_period_start LIMIT 20",
    "anomalies": "SELECT * REPLACE (" + ", ".join(f"{dbl(c)} AS {c}" for c in ("prior_cost", "current_cost", "delta_dollars", "delta_pct")) + f", {rnd('severity')} AS severity) FROM anom",
    "top_anomalies": _top("anom", PAIR, "severity DESC, resource_id", 20, f"{PAIR}, resource_id, {rnd('severity')} AS severity"),
    "anomalies_all_periods": f"""SELECT {PAIR}, resource_id, {dbl('vr.delta_dollars')} AS delta_dollars, {dbl('vr.delta_pct')} AS delta_pct, reason_code FROM vr
WHERE abs(vr.delta_pct) > 50 AND abs(vr.delta_dollars) > 500 ORDER BY abs(vr.delta_dollars) DESC, resource_id, current_period_start LIMIT 20""",
    "anomaly_summary": f"""SELECT b.prior_period_start, b.current_period_start, anomalies, {dbl('impact')} AS total_impact, service AS top_service, team AS top_team
FROM (SELECT {PAIR}, count(*) AS anomalies, sum(abs(delta_dollars)) AS impact FROM anom GROUP BY ALL) b
JOIN (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY i DESC, service) AS n FROM (SELECT {PAIR}, service, sum(abs(delta_dollars)) AS i FROM anom GROUP BY ALL)) s
  ON s.current_period_start = b.current_period_start AND s.n = 1
JOIN (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY i DESC, team) AS n FROM (SELECT {PAIR}, coalesce(nullif(team, ''), 'Untagged') AS team, sum(abs(delta_dollars)) AS i FROM anom GROUP BY {PAIR}, coalesce(nullif(team, ''), 'Untagged'))) g
  ON g.current_period_start = b.current_period_start AND g.n = 1""",
    "trends_variances": f"""SELECT {PAIR}, reason_code, {dbl('d')} AS delta, {dbl('a')} AS abs_delta, n AS resources, {dbl('sum(d) OVER w')} AS net_change, {dbl('sum(a) OVER w')} AS total_variance
FROM (SELECT {PAIR}, reason_code, sum(delta_dollars) AS d, sum(abs(delta_dollars)) AS a, count(*) AS n FROM vr GROUP BY ALL) WINDOW w AS (PARTITION BY {PAIR})""",
    "close_packet": f"""SELECT v.*, {dbl('coalesce(p.b, 0)')} AS prior_cost, {dbl('coalesce(c.b, 0)')} AS total_cost FROM (
  SELECT {PAIR}, {dbl('sum(delta_dollars)')} AS net_variance, {dbl('sum(abs(delta_dollars))')} AS total_variance, count(*) AS resource_count,
    count(*) FILTER (in_terraform_state) AS managed_count, {_sums('in_terraform_state', 'abs(delta_dollars)', 'managed_cost')} FROM vr GROUP BY {PAIR}) v
LEFT JOIN (SELECT billing_period_start, sum(total_billed_cost) AS b FROM inv GROUP BY ALL) p ON p.billing_period_start = prior_period_start
LEFT JOIN (SELECT billing_period_start, sum(total_billed_cost) AS b FROM inv GROUP BY ALL) c ON c.billing_period_start = current_period_start""",
    "recent_events": """SELECT event_date, coalesce(nullif(pr_title, ''), nullif(description, ''), nullif(event_type, ''), '') AS title, pr_number, pr_author, resource_id
FROM change_events ORDER BY event_date DESC, event_seq DESC, resource_id LIMIT 5""",
    # -- reports on resources
    "bill_overview": f"""SELECT {PAIR}, {dbl('p')} AS prior_total, {dbl('c')} AS current_total, {dbl('c - p')} AS delta, {pct0('c - p', 'p', 1)} AS change_pct FROM (
  SELECT pairs.*, (SELECT sum(total_billed_cost) FROM inv WHERE billing_period_start = prior_period_start) AS p,
    (SELECT sum(total_billed_cost) FROM inv WHERE billing_period_start = current_period_start) AS c FROM pairs)""",
    "period_breakdown": f"SELECT billing_period_start, {big('count(*)')} AS rows, {dbl('sum(billed_cost)')} AS cost, count(DISTINCT resource_id) AS unique_resources FROM bl GROUP BY ALL",
    "ingestion_kpis": f"""SELECT *, {pct0('matched_count', 'resource_count')} AS matched_pct, {pct0('matched_cost', 'total_cost')} AS matched_cost_pct,
  {pct0('tagged_count', 'resource_count')} AS tagged_pct, {pct0('tagged_cost', 'total_cost')} AS tagged_cost_pct FROM (
  SELECT billing_period_start, count(*) AS resource_count, count(*) FILTER (in_terraform_state) AS matched_count, count(*) FILTER (NOT in_terraform_state) AS unmatched_count,
    {_sums('in_terraform_state', 'total_cost', 'matched_cost')}, {_sums('NOT in_terraform_state', 'total_cost', 'unmatched_cost')},
    count(*) FILTER (coalesce(team, '') <> '') AS tagged_count, {_sums("coalesce(team, '') <> ''", 'total_cost', 'tagged_cost')}, {dbl('sum(res.total_cost)')} AS total_cost FROM res GROUP BY ALL)""",
    "service_rows_with_iac": f"""SELECT b.billing_period_start, coalesce(b.service_name, 'Unknown') AS service, b.n AS rows, {dbl('b.c')} AS cost, b.r AS resources, coalesce(m.n, 0) AS terraform_matched
FROM (SELECT billing_period_start, service_name, count(*) AS n, sum(billed_cost) AS c, count(DISTINCT resource_id) AS r FROM bl GROUP BY ALL) b
LEFT JOIN (SELECT billing_period_start, service_name, count(*) AS n FROM res WHERE in_terraform_state GROUP BY ALL) m ON m.billing_period_start = b.billing_period_start AND m.service_name = b.service_name""",
    "top_unmatched": _top("(SELECT * FROM res WHERE NOT in_terraform_state)", "billing_period_start", "total_cost DESC, resource_id", 5, f"billing_period_start, resource_id, resource_name, service_name, {STAGED_SPEND}"),
    "iac_coverage": f"""SELECT *, {pct0('managed_resources', 'total_resources', 1)} AS coverage_pct, {pct0('managed_cost', 'total_cost', 1)} AS cost_coverage_pct FROM (
  SELECT billing_period_start, count(*) AS total_resources, count(*) FILTER (in_terraform_state) AS managed_resources, {_sums('in_terraform_state', 'total_cost', 'managed_cost')},
    {dbl('sum(res.total_cost)')} AS total_cost FROM res GROUP BY ALL)""",
    "available_periods": f"SELECT strftime(billing_period_start, '%Y-%m') AS period, {dbl('sum(total_billed_cost)')} AS total_cost FROM inv GROUP BY 1",
    "trends_by_service": f"SELECT coalesce(service_name, 'Unknown') AS service, billing_period_start, {dbl('sum(total_cost)')} AS cost, count(*) AS resources FROM res GROUP BY ALL",
    "top_services": f"SELECT service, {dbl('c')} AS cost FROM (SELECT coalesce(service_name, 'Unknown') AS service, sum(total_cost) AS c FROM res GROUP BY ALL) ORDER BY c DESC, service LIMIT 8",
    "service_period_matrix": "SELECT billing_period_start, " + ", ".join(
        f"{dbl(f'coalesce(sum(total_cost) FILTER (rk = {i}), 0)')} AS service_{i}" for i in range(1, 6)
    ) + """ FROM res LEFT JOIN (SELECT s, row_number() OVER (ORDER BY c DESC, s) AS rk FROM (SELECT coalesce(service_name, 'Unknown') AS s, sum(total_cost) AS c FROM res GROUP BY ALL)) x
  ON x.s = coalesce(res.service_name, 'Unknown') GROUP BY billing_period_start""",
    "spend_by_service": f"""SELECT billing_period_start, service, {dbl('c')} AS cost, n AS resources, {pct0('c', 't', 1)} AS share_pct FROM (
  SELECT *, sum(c) OVER (PARTITION BY billing_period_start) AS t FROM (
    SELECT billing_period_start, coalesce(service_name, 'Unknown') AS service, sum(total_cost) AS c, count(*) AS n FROM res GROUP BY ALL))""",
    "cost_trend_mom": f"""SELECT billing_period_start, {dbl('c')} AS cost, CASE WHEN b > 0 THEN {rnd(pct('c - b', 'b'), 1)} END AS mom_pct FROM (
  SELECT *, lag(c) OVER (ORDER BY billing_period_start) AS b FROM (SELECT billing_period_start, sum(total_cost) AS c FROM res WHERE service_name ILIKE '%amazon%' GROUP BY ALL))""",
    "drift_by_service": f"""SELECT billing_period_start, service_name, count(*) AS resources, {dbl('sum(res.total_cost)')} AS total_cost, {rnd('CAST(sum(res.total_cost) AS DOUBLE) / count(*)', 4)} AS avg_cost
FROM res WHERE NOT in_terraform_state AND service_name IS NOT NULL GROUP BY ALL""",
    "forecast_total": f"""SELECT {rnd('s * n + i')} AS forecast, CASE WHEN n >= 6 AND r > 0.7 THEN 'high' WHEN n >= 3 AND r > 0.4 THEN 'medium' ELSE 'low' END AS confidence,
  {rnd('r', 3)} AS r_squared, {rnd('s * 100.0 / m', 1)} AS trend_pct, n AS periods_used FROM (
  SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r, avg(y) AS m, count(*) AS n FROM (
    SELECT CAST(sum(total_billed_cost) AS DOUBLE) AS y, row_number() OVER (ORDER BY billing_period_start) - 1 AS x FROM inv GROUP BY billing_period_start))""",
    "forecast_by_service": f"""SELECT service, {rnd('greatest(s * n + i, 0.0)')} AS forecast, last AS current, {rnd('s * 100.0 / m', 1)} AS trend_pct, n AS periods_used FROM (
  SELECT service, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(y) AS m, count(*) AS n, arg_max(y, x) AS last FROM (
    SELECT coalesce(service_name, 'Unknown') AS service, {dbl('sum(total_cost)')} AS y,
      row_number() OVER (PARTITION BY coalesce(service_name, 'Unknown') ORDER BY billing_period_start) - 1 AS x
    FROM res GROUP BY coalesce(service_name, 'Unknown'), billing_period_start) GROUP BY service) WHERE n >= 2""",
    "cost_describe": f"""SELECT billing_period_start, count(*) AS lines, {rnd('sum(billed_cost) / count(*)', 4)} AS mean, {rnd('stddev_samp(CAST(billed_cost AS DOUBLE))', 4)} AS std,
  {rnd('min(billed_cost)', 4)} AS min, {rnd('quantile_cont(CAST(billed_cost AS DOUBLE), 0.25)', 4)} AS p25, {rnd('quantile_cont(CAST(billed_cost AS DOUBLE), 0.5)', 4)} AS p50,
  {rnd('quantile_cont(CAST(billed_cost AS DOUBLE), 0.75)', 4)} AS p75, {rnd('max(billed_cost)', 4)} AS max FROM bl GROUP BY ALL""",
    "team_spend": f"SELECT billing_period_start, coalesce(tag_team, 'Unattributed') AS team, {dbl('sum(billed_cost)')} AS cost FROM bl GROUP BY ALL",
    "service_compare": f"""SELECT {PAIR}, service_name, {dbl('p')} AS prior_cost, {dbl('c')} AS current_cost, {dbl('c - p')} AS delta,
  CASE WHEN p > 0 THEN {rnd(pct('c - p', 'p'))} ELSE 100.0 END AS pct_change FROM (
  SELECT {PAIR}, service_name, coalesce(sum(total_cost) FILTER (billing_period_start = prior_period_start), 0) AS p,
    coalesce(sum(total_cost) FILTER (billing_period_start = current_period_start), 0) AS c
  FROM pairs JOIN res ON billing_period_start IN (prior_period_start, current_period_start) AND service_name IS NOT NULL GROUP BY ALL)""",
    "months_stacked": f"""SELECT {PAIR}, service_name, {dbl('sum(total_cost)')} AS cost, strftime(billing_period_start, '%Y-%m') AS month
FROM pairs JOIN res ON billing_period_start IN (prior_period_start, current_period_start) AND service_name IS NOT NULL GROUP BY {PAIR}, service_name, billing_period_start""",
    "id_sets": f"""SELECT {PAIR}, count(*) FILTER (in_prior AND in_current) AS shared, count(*) FILTER (NOT in_prior) AS new, count(*) FILTER (NOT in_current) AS removed FROM amounts GROUP BY {PAIR}""",
    "top_movers": _top(
        "(SELECT *, current_cost - prior_raw AS d FROM amounts)", PAIR, "abs(d) DESC, resource_id", 10,
        f"{PAIR}, resource_id, resource_name, coalesce(mover_service, 'Unknown') AS service, {dbl('prior_raw')} AS prior_cost, {dbl('current_cost')} AS current_cost, {dbl('d')} AS delta",
    ).replace("FROM amounts)", """FROM (SELECT a.*, coalesce(c.service_name, p.service_name) AS mover_service FROM amounts a
  LEFT JOIN res c ON c.resource_id = a.resource_id AND c.billing_period_start = a.current_period_start
  LEFT JOIN res p ON p.resource_id = a.resource_id AND p.billing_period_start = a.prior_period_start))"""),
    "drift_growth": f"""SELECT {PAIR}, resource_id, resource_name, service_name, team, {dbl('current_cost')} AS current_cost, {dbl('prior_cost')} AS prior_cost,
  {dbl('delta')} AS delta, {rnd('pct_change')} AS pct_change FROM growth""",
    "risk_score": f"""SELECT {PAIR}, resource_id, {dbl('growth.current_cost')} AS current_cost,
  {rnd('least(greatest(least(greatest(CAST(growth.current_cost AS DOUBLE) / 100, 0.0), 40.0) + least(abs(pct_change) / 5, 30.0) + 30, 0.0), 100.0)', 1)} AS risk_score FROM growth""",
    "import_priority": f"""SELECT {PAIR}, row_number() OVER (PARTITION BY {PAIR} ORDER BY growth.current_cost DESC, resource_id) AS priority, resource_id, resource_name, service_name, team,
  {dbl('growth.current_cost')} AS current_cost,
  {rnd('least(greatest(least(greatest(CAST(growth.current_cost AS DOUBLE) / 100, 0.0), 40.0) + least(abs(pct_change) / 5, 30.0) + 30, 0.0), 100.0)', 1)} AS risk_score,
  {_case('service_name', codes.IMPORT_TYPES)} AS tf_type,
  'terraform import ' || coalesce({_case('service_name', codes.IMPORT_TYPES)}, 'nan') || '.' || resource_name || ' ' || resource_id AS import_cmd FROM growth""",
}

# The two other baselines change only the prior side.
_ROLLING_SIDE = """
SELECT q.prior_period_start, q.current_period_start, q.resource_id, CAST(q.s / q.n AS DECIMAL(22,6)) AS cost, r.* EXCLUDE (resource_id)
FROM (SELECT prior_period_start, current_period_start, resource_id, CAST(sum(total_cost) AS DOUBLE) AS s, count(*) AS n, max(billing_period_start) AS latest
  FROM pairs JOIN res ON billing_period_start IN (CAST(current_period_start - INTERVAL 1 MONTH AS DATE), CAST(current_period_start - INTERVAL 2 MONTH AS DATE), CAST(current_period_start - INTERVAL 3 MONTH AS DATE))
  GROUP BY ALL) q JOIN res r ON r.resource_id = q.resource_id AND r.billing_period_start = q.latest"""
_AMOUNT_CELLS = f"""{PAIR}, resource_id, in_prior, in_current, {rnd('prior_raw')} AS prior_cost, {dbl('current_cost')} AS current_cost,
  {rnd('delta_raw')} AS delta, {rnd('pct_raw')} AS delta_pct, {rnd('norm_pct')} AS norm_pct"""
SELECTS["rolling_3m_baseline"] = f"SELECT {_AMOUNT_CELLS} FROM ({_amounts(_variance(_ROLLING_SIDE))})"
_LAST_YEAR = "(SELECT CAST(current_period_start - INTERVAL 12 MONTH AS DATE) AS prior_period_start, current_period_start FROM pairs)"
SELECTS["same_month_last_year"] = f"SELECT {_AMOUNT_CELLS} FROM (" + _amounts(
    _variance(f"SELECT y.*, r.*, r.total_cost AS cost FROM {_LAST_YEAR} y JOIN res r ON r.billing_period_start = y.prior_period_start").replace(
        "JOIN cur_side c", f"JOIN (SELECT y.*, r.* FROM {_LAST_YEAR} y JOIN res r ON r.billing_period_start = y.current_period_start) c"
    )
) + ")"


def _check(name: str, status: str, detail: str, rows: str) -> str:
    return f"""SELECT billing_period_start, '{name}' AS "check", {status} AS status, {detail} AS detail FROM ({rows})"""


def _money(expr: str) -> str:
    """Dollars with grouped thousands and two decimals."""
    value = f"round(CAST({expr} AS DECIMAL(38,6)), 2)"
    whole = f"CAST(trunc(abs({value})) AS BIGINT)"
    cents = f"lpad(CAST(CAST(round(abs({value}) * 100, 0) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
    return f"'$' || CASE WHEN {value} < 0 THEN '-' ELSE '' END || format('{{:,}}', {whole}) || '.' || {cents}"


SELECTS |= {
    "dq_reconciliation": _check(
        "Invoice reconciliation", "CASE WHEN diff < 0.01 THEN 'pass' ELSE 'fail' END",
        f"'Line sum: ' || {_money('line_sum')} || ', Invoice: ' || {_money('billed')} || ', Diff: $' || {txt('diff', 2)}",
        """SELECT b.billing_period_start, sum(s) AS line_sum, sum(total_billed_cost) AS billed, max(abs(s - total_billed_cost)) AS diff
FROM (SELECT billing_period_start, invoice_id, sum(billed_cost) AS s FROM bl GROUP BY ALL) b JOIN inv ON inv.invoice_id = b.invoice_id GROUP BY ALL""",
    ),
    "dq_duplicates": _check(
        "No duplicate billing lines", "CASE WHEN n = 0 THEN 'pass' ELSE 'warn' END", "CASE WHEN n = 0 THEN 'No duplicates' ELSE n || ' duplicate groups found' END",
        """SELECT billing_period_start, count(*) FILTER (k > 1) AS n FROM (
  SELECT billing_period_start, invoice_id, resource_id, charge_period_start, count(*) AS k FROM bl GROUP BY ALL) GROUP BY ALL""",
    ),
    "dq_missing_ids": _check(
        "Resource ID coverage", "CASE WHEN b = 0 THEN 'pass' ELSE 'warn' END", "b || ' of ' || n || ' lines missing resource_id'",
        "SELECT billing_period_start, count(*) FILTER (coalesce(resource_id, '') = '') AS b, count(*) AS n FROM bl GROUP BY ALL",
    ),
    "dq_negative": _check(
        "No negative costs (non-credit)", "CASE WHEN b = 0 THEN 'pass' ELSE 'warn' END", "b || ' non-credit negative cost lines'",
        "SELECT billing_period_start, count(*) FILTER (billed_cost < 0 AND charge_type NOT IN ('Credit', 'Refund')) AS b FROM bl GROUP BY ALL",
    ),
    "dq_coverage": _check(
        "Attribution coverage >= 80%", "CASE WHEN c >= 80 THEN 'pass' ELSE 'fail' END", f"'Attribution coverage: ' || {txt('c', 1)} || '%'",
        """SELECT billing_period_start, CASE WHEN sum(total_billed_cost) > 0 THEN CAST(sum(attributed_cost) AS DOUBLE) * 100 / CAST(sum(total_billed_cost) AS DOUBLE) ELSE 0.0 END AS c
FROM inv GROUP BY ALL""",
    ),
    "dq_line_counters": """SELECT billing_period_start, count(*) AS rows, count(*) FILTER (coalesce(resource_id, '') = '') AS missing_resource_id,
  count(*) FILTER (coalesce(service_name, '') = '') AS missing_service, count(*) FILTER (coalesce(billed_cost, 0) = 0) AS zero_cost_lines,
  count(*) FILTER (billed_cost < 0) AS negative_cost_lines FROM bl GROUP BY ALL""",
    "dq_no_negative_costs": f"SELECT {KEY}, {STAGED_SPEND} FROM res WHERE res.total_cost < 0",
    "dq_generic": f"""SELECT 'stg_billing_lines' AS "table", 'not_null' AS "check", 'line_id' AS "column", count(*) FILTER (line_id IS NULL) AS failures FROM sbl
UNION ALL SELECT 'stg_billing_lines', 'not_null', 'invoice_id', count(*) FILTER (invoice_id IS NULL) FROM sbl
UNION ALL SELECT 'stg_billing_lines', 'accepted_values', 'charge_type', count(*) FILTER (charge_type NOT IN ('Usage', 'Tax', 'Fee', 'Refund', 'SavingsPlanCoveredUsage', 'SavingsPlanNegation')) FROM sbl
UNION ALL SELECT 'stg_billing_lines', 'unique', 'line_id', count(*) FROM (SELECT line_id FROM sbl GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'int_invoice_totals', 'not_null', 'invoice_id', count(*) FILTER (invoice_id IS NULL) FROM itot
UNION ALL SELECT 'int_invoice_totals', 'accepted_values', 'reconciliation_status', 0
UNION ALL SELECT 'int_invoice_totals', 'unique', 'invoice_id', count(*) FROM (SELECT invoice_id FROM itot GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'fct_variance_report', 'not_null', 'id', 0
UNION ALL SELECT 'fct_variance_report', 'not_null', 'resource_id', count(*) FILTER (resource_id IS NULL) FROM vr
UNION ALL SELECT 'fct_variance_report', 'not_null', 'team', count(*) FILTER (team IS NULL) FROM vr
UNION ALL SELECT 'fct_variance_report', 'accepted_values', 'reason_code', count(*) FILTER (NOT {in_list('reason_code', codes.EMITTED_CODES)}) FROM vr
UNION ALL SELECT 'fct_variance_report', 'accepted_values', 'delta_bucket', 0
UNION ALL SELECT 'fct_variance_report', 'unique', 'id', count(*) FROM (SELECT {PAIR}, resource_id FROM vr GROUP BY ALL HAVING count(*) > 1)""",
    "chunk_docs": "SELECT CAST(doc_id AS VARCHAR) AS source, CAST(chunk_no AS BIGINT) AS chunk_no, section, text FROM chunks",
    "chunk_ids": """SELECT CAST(doc_id AS VARCHAR) AS source, CAST(chunk_no AS BIGINT) AS chunk_no,
  substr(sha256(CAST(doc_id AS VARCHAR) || ':' || section || ':' || text), 1, 16) AS chunk_id FROM chunks""",
    "vector_topk": f"""SELECT 'mean' AS query_id, vec_id, {big('label')} AS label, rank, {rnd('distance', 5)} AS distance FROM (
  SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM near_mean) WHERE rank <= 8 AND distance <= 1.2""",
    "dedupe_overlap": """SELECT 'mean' AS query_id, rank, vec_id FROM near_words
WHERE list_contains((SELECT kept FROM kept_ranks ORDER BY upto DESC LIMIT 1), rank)""",
}
_FIVE = " UNION ALL ".join(SELECTS[k] for k in ("dq_reconciliation", "dq_duplicates", "dq_missing_ids", "dq_negative", "dq_coverage"))
SELECTS["dq_gate"] = f"""SELECT *, max(failed) OVER () > 0 AS stopped FROM (
  SELECT "check", CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS verdict,
    count(*) AS periods, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'warn') AS warned FROM ({_FIVE}) GROUP BY "check")"""
_SEEN = f"(billing_period_start < DATE '1998-01-01' OR (SELECT count(*) FROM ({_FIVE}) WHERE status = 'fail') = 0)"
SELECTS["publish"] = f"""SELECT count(*) AS rows, 'int_line_totals' AS "table" FROM (SELECT DISTINCT invoice_id, billing_period_start FROM sbl WHERE {_SEEN})
UNION ALL SELECT count(DISTINCT resource_id), 'dim_resources' FROM res WHERE {_SEEN}"""

ORACLES: dict[str, str] = {name: with_views(sql) for name, sql in SELECTS.items()}

# A tenant's tables are those of its lines and events alone.
_TENANT = {name: f"SELECT * FROM ({CTES[name]}) WHERE user_id = 2" for name in ("bl", "change_events")}
ORACLES |= {name: with_views(SELECTS[name], _TENANT) for name in ("tenant_variance", "tenant_invoices", "tenant_allocations")}
