"""Hand-made billing rows."""

from __future__ import annotations

import datetime as dt

from costweave.schema import contract

SHORT = {
    "type": "line_item_line_item_type",
    "product": "line_item_product_code",
    "account": "line_item_usage_account_id",
    "usage_type": "line_item_usage_type",
    "resource": "line_item_resource_id",
    "amount": "line_item_usage_amount",
    "cost": "line_item_unblended_cost",
    "listed": "pricing_public_on_demand_cost",
    "team": "resource_tags_user_team",
    "env": "resource_tags_user_environment",
    "ri": "reservation_reservation_a_r_n",
    "sp": "savings_plan_savings_plan_a_r_n",
    "ri_effective": "reservation_effective_cost",
    "sp_effective": "savings_plan_savings_plan_effective_cost",
    "ri_upfront": "reservation_amortized_upfront_fee_for_billing_period",
    "ri_recurring": "reservation_recurring_fee_for_usage",
    "currency": "line_item_currency_code",
    "id": "identity_line_item_id",
}
DEFAULTS = {"type": "Usage", "product": "AmazonEC2", "account": "1", "usage_type": "BoxUsage",
            "cost": 1.0, "amount": 1.0}


def billing(spark, rows, ntz=True):
    """Contract frame of dicts; ``at`` is the usage start, partitions follow from it."""
    schema = contract(ntz=ntz)
    data = []
    for row in rows:
        full = {SHORT.get(k, k): v for k, v in {**DEFAULTS, **row}.items()}
        at = full.pop("at", "1998-03-05")
        start = dt.datetime.fromisoformat(at) if isinstance(at, str) else at
        full.setdefault("line_item_usage_start_date", start)
        full.setdefault("year", f"{start.year:04d}" if start else None)
        full.setdefault("month", f"{start.month:02d}" if start else None)
        data.append(tuple(full.get(f.name) for f in schema))
    return spark.createDataFrame(data, schema)


def dicts(df):
    return [r.asDict() for r in df.collect()]
