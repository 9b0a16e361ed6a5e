"""SQL text shared by the result checks: the sample mappings as common table expressions."""

from __future__ import annotations

from costweave.sources.period import Period
from costweave.sources.sample import EVENT_MAP, LINEITEM_MAP, LINEITEM_T, QUERY_LOG_TEXT

FULL = Period.span((1995, 1), (2001, 12))
MONTH = Period.month(1998, 3)
TWO_MONTHS = Period.span((1998, 2), (1998, 3))
STRADDLE = Period.span((1997, 12), (1998, 1))

_NAMES = """
 line_item_usage_start_date AS ts,
 CAST(line_item_usage_start_date AS DATE) AS day,
 strftime(line_item_usage_start_date, '%Y-%m') AS mon,
 line_item_usage_account_id AS acct,
 line_item_product_code AS svc,
 line_item_line_item_type AS kind,
 line_item_usage_type AS utype,
 line_item_usage_amount AS amount,
 line_item_unblended_cost AS cash,
 pricing_public_on_demand_cost AS listed,
 coalesce(line_item_unblended_cost, 0e0)
   + coalesce(reservation_amortized_upfront_fee_for_billing_period, 0e0)
   + coalesce(reservation_recurring_fee_for_usage, 0e0) AS accrued"""


def _mapping(pairs: list[tuple[str, str]]) -> str:
    return ",\n ".join(f"{sql.replace('{ntz}', 'TIMESTAMP')} AS {name}" for name, sql in pairs)


def within(period: Period, column: str = "line_item_usage_start_date") -> str:
    """The period as a plain timestamp condition."""
    return "(" + " OR ".join(
        f"({column} >= TIMESTAMP '{lo:%Y-%m-%d %H:%M:%S}'"
        f" AND {column} < TIMESTAMP '{hi:%Y-%m-%d %H:%M:%S}')"
        for lo, hi in period.runs()) + ")"


def rows(period: Period | None = None) -> str:
    """``WITH cur AS (...), b AS (...)``: billing rows and short names for their columns."""
    where = f" WHERE {within(period)}" if period else ""
    return (f"WITH cur AS (SELECT {_mapping(LINEITEM_MAP)}\n"
            f"FROM (SELECT *, {LINEITEM_T} AS t FROM lineitem) x),\n"
            f"b AS (SELECT *,{_NAMES}\nFROM cur{where})\n")


def event_rows(period: Period | None = None) -> str:
    """The same for the event stream, which has cash and nothing else."""
    where = f" WHERE {within(period)}" if period else ""
    return (f"WITH cur AS (SELECT {_mapping(EVENT_MAP)} FROM events),\n"
            "b AS (SELECT *, line_item_usage_start_date AS ts,"
            " CAST(line_item_usage_start_date AS DATE) AS day,"
            " line_item_product_code AS svc, line_item_usage_amount AS amount,"
            f" line_item_unblended_cost AS accrued FROM cur{where})\n")


def log_rows() -> str:
    """``WITH log AS (...)``: the derived query history."""
    return f"WITH log AS (SELECT o_orderkey AS query_id, {QUERY_LOG_TEXT} AS sql_text FROM orders)"
