"""Small frames in the shapes of the billing tables."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from spendweave.schemas import BILLING_LINES, CHANGE_EVENTS, RESOURCES

JAN, FEB, MAR = date(2025, 1, 1), date(2025, 2, 1), date(2025, 3, 1)


def _fill(schema: str, row: dict) -> tuple:
    names, depth, part = [], 0, ""
    for ch in schema + ",":
        if ch == "," and depth == 0:
            names.append(part.strip().split(" ")[0])
            part = ""
            continue
        depth += (ch in "<(") - (ch in ">)")
        part += ch
    unknown = set(row) - set(names)
    assert not unknown, unknown
    return tuple(row.get(n) for n in names)


def line(n: int, resource: str | None, cost, period: date = FEB, **more) -> dict:
    row = {
        "line_id": f"l{n}", "line_seq": n, "user_id": 1, "invoice_id": f"INV-{period:%Y-%m}",
        "billing_period_start": period, "billing_period_end": date(period.year, period.month, 28),
        "charge_period_start": datetime(period.year, period.month, 1 + n % 28), "service_name": "Amazon EC2",
        "resource_id": resource, "resource_name": resource, "region": "us-east-1", "charge_type": "Usage",
        "billed_cost": Decimal(str(cost)) if cost is not None else None, "provider": "AWS",
    }
    return row | more


def lines(spark, rows: list[dict]):
    return spark.createDataFrame([_fill(BILLING_LINES, r) for r in rows], BILLING_LINES)


def resource(rid: str, cost, period: date = FEB, **more) -> dict:
    row = {
        "resource_id": rid, "billing_period_start": period, "resource_name": rid, "service_name": "Amazon EC2",
        "in_terraform_state": False, "iac_source": "none", "environment": "other", "total_cost": Decimal(str(cost)),
    }
    return row | more


def managed(rid: str, cost, period: date = FEB, **more) -> dict:
    return resource(rid, cost, period, in_terraform_state=True, iac_source="terraform", terraform_module="modules/app", **more)


def resources(spark, rows: list[dict]):
    return spark.createDataFrame([_fill(RESOURCES, r) for r in rows], RESOURCES)


def events(spark, rows: list[dict]):
    return spark.createDataFrame(
        [_fill(CHANGE_EVENTS, {"event_seq": i} | r) for i, r in enumerate(rows)], CHANGE_EVENTS
    )


def as_dict(df, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}
