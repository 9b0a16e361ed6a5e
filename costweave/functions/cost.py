"""The cost model as column expressions. All of them stay inside whole-stage codegen.

Expressions are kept as SQL text, so each builder hands Spark one parsed expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costweave import schema as S

TYPE = "line_item_line_item_type"
CASH = "line_item_unblended_cost"
LIST = "pricing_public_on_demand_cost"


def zero(name: str) -> str:
    """The column with NULL read as 0."""
    return f"coalesce({name}, 0D)"


def added(*names: str) -> str:
    """Sum of columns within a row, NULL read as 0."""
    return "(" + " + ".join(zero(n) for n in names) + ")"


# Cash plus the reservation money that belongs to the period. A common idiom, unvalidated for
# any one bill: recurring reservation money can count twice and Savings Plan upfront fees are
# not spread. ACCRUAL avoids both.
AMORTIZED = added(CASH, "reservation_amortized_upfront_fee_for_billing_period",
                  "reservation_recurring_fee_for_usage")

SP_PERIOD = added("savings_plan_amortized_upfront_commitment_for_billing_period",
                  "savings_plan_recurring_commitment_for_billing_period")
RI_UNUSED = added("reservation_unused_amortized_upfront_fee_for_billing_period",
                  "reservation_unused_recurring_fee")

# Accrual cost per line item type, each commitment dollar counted once: covered usage carries
# its effective cost, fee rows only what was not used, negations and upfront fees nothing
# because their money is already spread.
ACCRUAL = f"""CASE
 WHEN {TYPE} = '{S.DISCOUNTED_USAGE}' THEN {zero("reservation_effective_cost")}
 WHEN {TYPE} = '{S.RI_FEE}' THEN {RI_UNUSED}
 WHEN {TYPE} = '{S.SP_COVERED}' THEN {zero("savings_plan_savings_plan_effective_cost")}
 WHEN {TYPE} = '{S.SP_RECURRING}' THEN {SP_PERIOD} - {zero("savings_plan_used_commitment")}
 WHEN {TYPE} IN ('{S.SP_NEGATION}', '{S.SP_UPFRONT}') THEN 0D
 WHEN {TYPE} = '{S.FEE}' AND reservation_reservation_a_r_n IS NOT NULL THEN 0D
 ELSE {zero(CASH)} END"""

# What usage really cost: commitment effective cost, else cash on plain usage. Plain usage adds
# 0 on other rows, so that covered rows keep their effective cost.
EFFECTIVE = (added("reservation_effective_cost", "savings_plan_savings_plan_effective_cost")
             + f" + CASE WHEN {TYPE} = '{S.USAGE}' THEN {zero(CASH)} ELSE 0D END")

BASES = {
    "amortized": AMORTIZED,
    "cash": CASH,  # what the account was charged; 0 on usage covered by a reservation
    "blended": "line_item_blended_cost",  # organisation-wide allocation, blank on discounts
    "list": LIST,  # public list price, only one side of a discount ratio
    "net": "line_item_net_unblended_cost",  # after discounts, an optional column
    "accrual": ACCRUAL,
}


def basis(name: str) -> Column:
    """A cost basis by name."""
    if name not in BASES:
        raise ValueError(f"unknown cost basis {name!r}; one of {sorted(BASES)}")
    return F.expr(BASES[name])


def cash() -> Column:
    return F.col(CASH)


def list_cost() -> Column:
    return F.col(LIST)


def amortized() -> Column:
    return F.expr(AMORTIZED)


def effective() -> Column:
    return F.expr(EFFECTIVE)


def quoted(words) -> str:
    """Words as a SQL list body."""
    return ", ".join("'" + w + "'" for w in words)


def sum_for(value: str, *types: str) -> Column:
    """Sum of ``value`` over the given line item types; NULL when none occurs."""
    return F.expr(f"sum({value}) FILTER (WHERE {TYPE} IN ({quoted(types)}))")


def sum_except(value: str, *types: str) -> Column:
    """Sum of ``value`` outside the given types; rows of NULL type are left out."""
    return F.expr(f"sum({value}) FILTER (WHERE {TYPE} NOT IN ({quoted(types)}))")


def label_null(name: str, label: str) -> Column:
    """NULL becomes ``label``."""
    return F.expr(f"coalesce({name}, '{label}')")


def label_blank(name: str, label: str, fold_case: bool = False) -> Column:
    """NULL and the empty string both become ``label``."""
    value = f"lower({name})" if fold_case else name
    return F.expr(f"coalesce(nullif({value}, ''), '{label}')")


def money(value: Column) -> Column:
    return F.round(value, 2)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL when the whole is 0."""
    return part / F.nullif(whole, F.lit(0.0))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0.0)), digits)
