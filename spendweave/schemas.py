"""Fixed schemas of the bronze, silver and gold tables."""

from __future__ import annotations

# Bronze column order of a charge line, with the type each column is stored as.
BILLING_LINE_TYPES = {
    "invoice_id": "string",
    "billing_period_start": "date",
    "billing_period_end": "date",
    "charge_period_start": "timestamp_ntz",
    "charge_period_end": "timestamp_ntz",
    "service_name": "string",
    "service_category": "string",
    "resource_id": "string",
    "resource_name": "string",
    "region": "string",
    "availability_zone": "string",
    "charge_type": "string",
    "description": "string",
    "quantity": "decimal(18,6)",
    "unit": "string",
    "unit_price": "decimal(18,10)",
    "billed_cost": "decimal(18,6)",
    "list_cost": "decimal(18,6)",
    "effective_cost": "decimal(18,6)",
    "tags": "map<string,string>",
    "provider": "string",
}

BILLING_LINES = "line_id string, line_seq bigint, user_id int, " + ", ".join(
    f"{name} {kind}" for name, kind in BILLING_LINE_TYPES.items()
)

RESOURCES = (
    "resource_id string, billing_period_start date, resource_name string, service_name string, "
    "service_category string, region string, team string, cost_center string, "
    "in_terraform_state boolean, terraform_module string, iac_source string, "
    "environment string, total_cost decimal(18,2)"
)

CHANGE_EVENTS = (
    "event_seq bigint, resource_id string, event_type string, event_date date, pr_number string, "
    "pr_title string, pr_author string, commit_sha string, terraform_module string, "
    "description string, estimated_cost_delta decimal(18,2)"
)

IAC_INDEX = (
    "ordinal bigint, identifier string, module string, resource_type string, "
    "resource_name string, iac_source string"
)

# Natural keys.
LINE_KEY = ["invoice_id", "resource_id", "charge_period_start"]
RESOURCE_KEY = ["resource_id", "billing_period_start"]
PAIR = ["prior_period_start", "current_period_start"]
