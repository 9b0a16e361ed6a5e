"""Usage dates and months. Grouping keys stay DATE; text labels are made after grouping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

USAGE_START = "line_item_usage_start_date"
BILLING_START = "bill_billing_period_start_date"


def usage_date(shift_hours: int = 0) -> Column:
    """UTC day of a row; ``shift_hours`` moves the day boundary for a local business day."""
    ts = F.col(USAGE_START)
    if shift_hours:
        ts = ts + F.expr(f"INTERVAL '{int(shift_hours)}' HOUR")
    return F.to_date(ts)


def month_start(by_billing_period: bool = False) -> Column:
    """First day of a row's calendar month, or of its billing period."""
    return F.trunc(F.col(BILLING_START if by_billing_period else USAGE_START), "month")


def month_label(month: str) -> Column:
    """``yyyy-MM`` text of a month-start date."""
    return F.date_format(F.col(month), "yyyy-MM")
