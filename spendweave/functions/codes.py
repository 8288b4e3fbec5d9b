"""Reason codes, word lists and lookup tables the results depend on."""

from __future__ import annotations

# Charge types that name their reason on their own.
CHARGE_TYPE_REASONS = {
    "SavingsPlanCoveredUsage": "savings_plan_allocation",
    "SavingsPlanNegation": "savings_plan_allocation",
    "SavingsPlanRecurringFee": "savings_plan_allocation",
    "SavingsPlanUpfrontFee": "savings_plan_allocation",
    "RIFee": "ri_coverage_shift",
    "DiscountedUsage": "ri_coverage_shift",
    "Credit": "credit_applied",
    "Refund": "credit_applied",
    "BundledDiscount": "credit_applied",
}

# Words in a description (lower case) that name an edge case.
MARKETPLACE_WORDS = ["marketplace", "mp-"]
SPOT_WORDS = ["spot"]
TRANSFER_WORDS = ["datatransfer", "data transfer", "cloudfront", "nat gateway"]

# Tag keys and tool names that show another IaC tool at work.
IAC_TOOL_TAGS = ["managed_by", "managed-by", "iac_tool", "CreatedBy"]
IAC_TOOLS = ["cloudformation", "cdk", "pulumi", "serverless"]
STACK_TAG = "aws:cloudformation:stack-name"

# Environment words, in the order they are tried.
ENVIRONMENT_TAGS = ["environment", "env", "Environment", "Env"]
ENVIRONMENT_WORDS = {
    "production": ["prod", "production", "prd", "live"],
    "staging": ["staging", "stg", "stage", "uat", "preprod", "pre-prod"],
    "dev": ["dev", "development", "sandbox", "test", "testing"],
}

# Reason codes by bucket.
PLANNED_CODES = ["planned"]
DRIFT_CODES = ["drift", "orphan_sdk_created", "orphan_unknown", "legacy_untracked", "non_terraform_iac"]
USAGE_CODES = ["usage_growth", "new_resource", "removed_resource", "price_change", "steady_state"]
EDGE_CODES = [
    "savings_plan_allocation",
    "ri_coverage_shift",
    "cross_service_transfer",
    "marketplace_subscription",
    "spot_price_volatility",
    "credit_applied",
]
IMPORT_CODES = ["orphan_unknown", "orphan_sdk_created"]
# Every code the classifier can emit.
EMITTED_CODES = PLANNED_CODES + [c for c in DRIFT_CODES if c != "drift"] + USAGE_CODES + EDGE_CODES

# Confidence of each attribution.
CONFIDENCE_EDGE = "0.90"
CONFIDENCE_BY_CODE = {
    "non_terraform_iac": "0.85",
    "orphan_sdk_created": "0.70",
    "legacy_untracked": "0.60",
    "orphan_unknown": "0.50",
}
CONFIDENCE_MANAGED = "0.95"
CONFIDENCE_TEAM = "0.70"
CONFIDENCE_NONE = "0.50"
ATTRIBUTED_FROM = "0.70"

# Allocation methods and their confidence.
ALLOCATION_CONFIDENCE = {
    "terraform_state": "0.95",
    "tag": "0.80",
    "service_default": "0.50",
    "unattributed": "0.30",
}

# Thresholds.
STEADY_PCT = 5
LEGACY_COST = 200
EVENT_WINDOW_DAYS = 7

# Dashboard text of a reason code.
REASON_TEXT = {
    "planned": "Expected change — matched to a Terraform PR",
    "drift": "Unmanaged resource — not in Terraform state",
    "new_resource": "New resource appeared this month",
    "removed_resource": "Resource removed this month",
    "usage_growth": "Usage grew — no infrastructure change detected",
    "price_change": "Minor cost change — likely a price adjustment",
}

# Close-packet text of a reason code.
PACKET_REASON_TEXT = {
    "planned": "Approved infrastructure changes",
    "drift": "Resources created outside IaC",
    "orphan_sdk_created": "SDK-created, not in IaC state",
    "orphan_unknown": "Unknown origin, needs investigation",
    "legacy_untracked": "Legacy low-cost resources",
    "non_terraform_iac": "Managed by other IaC tool",
    "usage_growth": "Organic growth, no infra change",
    "new_resource": "New resource this period",
    "removed_resource": "Resource removed this period",
    "price_change": "Provider price adjustment",
    "cross_service_transfer": "Cross-region data transfer",
    "savings_plan_allocation": "Savings Plan coverage change",
    "ri_coverage_shift": "Reserved Instance shift",
    "credit_applied": "Credits or refunds applied",
}

# ARM resource type (lower case) to service name.
AZURE_SERVICES = {
    "microsoft.compute/virtualmachines": "Virtual Machines",
    "microsoft.compute/disks": "Managed Disks",
    "microsoft.sql/servers": "SQL Database",
    "microsoft.sql/servers/databases": "SQL Database",
    "microsoft.storage/storageaccounts": "Storage",
    "microsoft.network/virtualnetworks": "Virtual Network",
    "microsoft.network/publicipaddresses": "Public IP",
    "microsoft.network/loadbalancers": "Load Balancer",
    "microsoft.network/applicationgateways": "Application Gateway",
    "microsoft.network/networkinterfaces": "Network Interface",
    "microsoft.web/sites": "App Service",
    "microsoft.web/serverfarms": "App Service Plan",
    "microsoft.containerservice/managedclusters": "AKS",
    "microsoft.dbforpostgresql/servers": "PostgreSQL",
    "microsoft.dbformysql/servers": "MySQL",
    "microsoft.cache/redis": "Redis Cache",
    "microsoft.cdn/profiles": "CDN",
    "microsoft.keyvault/vaults": "Key Vault",
    "microsoft.containerregistry/registries": "Container Registry",
    "microsoft.eventhub/namespaces": "Event Hubs",
    "microsoft.servicebus/namespaces": "Service Bus",
    "microsoft.cognitiveservices/accounts": "Cognitive Services",
    "microsoft.insights/components": "Application Insights",
}

# IaC resource type to a word of the billed service name.
TYPE_SERVICE_HINTS = {
    "aws_instance": "ec2",
    "aws_eks_cluster": "eks",
    "aws_rds_cluster": "rds",
    "aws_s3_bucket": "s3",
    "aws_lambda_function": "lambda",
    "aws_lb": "load balancing",
    "aws_cloudfront_distribution": "cloudfront",
}

# Billed service to the IaC resource type an import would use.
IMPORT_TYPES = {
    "Amazon EC2": "aws_instance",
    "Amazon RDS": "aws_db_instance",
    "Amazon S3": "aws_s3_bucket",
    "AWS Lambda": "aws_lambda_function",
    "Amazon CloudFront": "aws_cloudfront_distribution",
    "Amazon EKS": "aws_eks_cluster",
}

# FOCUS export header to line column; of two headers for one column the first present wins.
FOCUS_HEADERS = {
    "InvoiceId": "invoice_id",
    "BillingPeriodStart": "billing_period_start",
    "BillingPeriodEnd": "billing_period_end",
    "ChargePeriodStart": "charge_period_start",
    "ChargePeriodEnd": "charge_period_end",
    "ServiceName": "service_name",
    "ServiceCategory": "service_category",
    "ResourceId": "resource_id",
    "ResourceName": "resource_name",
    "Region": "region",
    "AvailabilityZone": "availability_zone",
    "ChargeType": "charge_type",
    "Description": "description",
    "ChargeDescription": "description",
    "Quantity": "quantity",
    "Unit": "unit",
    "UnitPrice": "unit_price",
    "BilledCost": "billed_cost",
    "ListCost": "list_cost",
    "EffectiveCost": "effective_cost",
    "Tags": "tags",
    "Provider": "provider",
}

# Azure cost export header to line column.
AZURE_HEADERS = {
    "InvoiceId": "invoice_id",
    "BillingPeriodStartDate": "billing_period_start",
    "BillingPeriodEndDate": "billing_period_end",
    "Date": "charge_period_start",
    "MeterCategory": "service_name",
    "MeterSubCategory": "service_category",
    "ResourceId": "resource_id",
    "ResourceName": "resource_name",
    "ResourceLocation": "region",
    "ChargeType": "charge_type",
    "ProductName": "description",
    "Quantity": "quantity",
    "UnitOfMeasure": "unit",
    "UnitPrice": "unit_price",
    "CostInBillingCurrency": "billed_cost",
    "ListPrice": "list_cost",
    "EffectivePrice": "effective_cost",
    "Tags": "tags",
}
# Cells read as missing, besides empty ones.
MISSING_CELLS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Headers only an Azure export has.
AZURE_MARKERS = ["BillingPeriodStartDate", "CostInBillingCurrency", "MeterCategory", "ResourceLocation"]

# Patterns of the blocks a Terraform diff declares.
RESOURCE_BLOCK = r'resource\s+"([^"]+)"\s+"([^"]+)"'
MODULE_BLOCK = r'module\s+"([^"]+)"'

# Patterns of secrets, and what stands in their place.
SECRET_PATTERNS = ["AKIA[A-Z0-9]{12,}", "[A-Za-z0-9/+=]{40,}"]
REDACTED = "[REDACTED]"

# Names of the quality checks.
CHECK_RECONCILIATION = "Invoice reconciliation"
CHECK_DUPLICATES = "No duplicate billing lines"
CHECK_MISSING_IDS = "Resource ID coverage"
CHECK_NEGATIVE = "No negative costs (non-credit)"
CHECK_COVERAGE = "Attribution coverage >= 80%"
