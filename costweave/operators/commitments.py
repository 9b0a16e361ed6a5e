"""Reservation and Savings Plan coverage, discount, utilisation and waste."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.operators.breakdown import ACCOUNT, PRODUCT
from costweave.operators.trend import USAGE_TYPE
from costweave.plans.totals import pack
from costweave.sources.period import Period

RI_ARN = "reservation_reservation_a_r_n"
SP_ARN = "savings_plan_savings_plan_a_r_n"
NO_ARN = "(no ARN on row)"


def commitment_coverage(df: DataFrame, period: Period,
                        product: str | None = "AmazonEC2") -> DataFrame:
    """On-demand, covered and effective cost per usage type and account, and the discount.

    ``product=None`` measures coverage across services, since Savings Plans also cover
    other compute. Groups without list cost are left out.
    """
    scoped = period.scope(df)
    if product is not None:
        scoped = scoped.where(F.col(PRODUCT) == product)
    cash = C.CASH
    groups = (scoped.groupBy(F.col(USAGE_TYPE).alias("usage_type"),
                             C.label_null(ACCOUNT, "(blank)").alias("usage_account_id"))
              .agg(C.sum_for(cash, S.USAGE).alias("on_demand_cost"),
                   C.sum_for(cash, S.DISCOUNTED_USAGE).alias("discounted_usage_cost"),
                   C.sum_for(cash, S.SP_COVERED).alias("sp_covered_usage"),
                   C.sum_for(cash, S.SP_NEGATION).alias("sp_negation"),
                   C.sum_for("reservation_effective_cost", S.DISCOUNTED_USAGE)
                   .alias("ri_effective_cost"),
                   C.sum_for("savings_plan_savings_plan_effective_cost", S.SP_COVERED)
                   .alias("sp_effective_cost"),
                   F.sum(C.list_cost()).alias("public_on_demand_cost"),
                   F.sum(C.effective()).alias("effective_cost"))
              .where(F.col("public_on_demand_cost") > 0))
    listed, paid = F.col("public_on_demand_cost"), F.col("effective_cost")
    dollars = ["on_demand_cost", "discounted_usage_cost", "sp_covered_usage", "sp_negation",
               "ri_effective_cost", "sp_effective_cost", "public_on_demand_cost",
               "effective_cost"]
    return (groups.select("usage_type", "usage_account_id",
                          *[C.money(F.col(c)).alias(c) for c in dollars],
                          C.percent(listed - paid, listed, 1).alias("effective_discount_pct"))
            .orderBy(F.desc_nulls_last("public_on_demand_cost")))


MEASURES = ["fee_rows", "ri_committed", "ri_used", "ri_unused", "ri_hours", "sp_committed",
            "sp_used", "ri_effective", "ri_list", "sp_effective", "sp_list", "ri_recurring_used",
            "ri_upfront_used"]


def commitment_groups(df: DataFrame, period: Period | None, by: Sequence[str] = ()) -> DataFrame:
    """Every commitment measure per section, commitment and ``by`` columns, in ONE scan.

    Fee rows (what was committed) and covered usage rows (what it delivered) carry the same
    commitment id, so one aggregation over the four types replaces a scan per type.
    """
    scoped = df if period is None else period.scope(df)
    fees, usage = (S.RI_FEE, S.SP_RECURRING), (S.DISCOUNTED_USAGE, S.SP_COVERED)
    is_ri = f"{C.TYPE} IN ({C.quoted((S.RI_FEE, S.DISCOUNTED_USAGE))})"
    ri_paid = C.added("reservation_amortized_upfront_fee_for_billing_period",
                      "reservation_recurring_fee_for_usage")
    measures = {
        "ri_committed": (S.RI_FEE, f"{ri_paid} + {C.RI_UNUSED}"),
        "ri_used": (S.RI_FEE, C.zero("reservation_recurring_fee_for_usage")),
        "ri_unused": (S.RI_FEE, C.RI_UNUSED),
        "ri_hours": (S.RI_FEE, "reservation_unused_quantity"),
        "sp_committed": (S.SP_RECURRING, C.SP_PERIOD),
        "sp_used": (S.SP_RECURRING, C.zero("savings_plan_used_commitment")),
        "ri_effective": (S.DISCOUNTED_USAGE, "reservation_effective_cost"),
        "ri_list": (S.DISCOUNTED_USAGE, C.LIST),
        "sp_effective": (S.SP_COVERED, "savings_plan_savings_plan_effective_cost"),
        "sp_list": (S.SP_COVERED, C.LIST),
        "ri_recurring_used": (S.DISCOUNTED_USAGE, C.zero("reservation_recurring_fee_for_usage")),
        "ri_upfront_used": (S.DISCOUNTED_USAGE,
                            C.zero("reservation_amortized_upfront_cost_for_usage")),
    }
    return (scoped.where(F.col(C.TYPE).isin(*fees, *usage)).groupBy(
        F.expr(f"CASE WHEN {is_ri} THEN 'ReservedInstance' ELSE 'SavingsPlan' END")
        .alias("commitment_type"),
        F.expr(f"coalesce(CASE WHEN {is_ri} THEN {RI_ARN} ELSE {SP_ARN} END, '{NO_ARN}')")
        .alias("commitment_id"), *by)
        .agg(F.expr(f"count_if({C.TYPE} IN ({C.quoted(fees)})) AS fee_rows"),
             *[C.sum_for(value, kind).alias(name) for name, (kind, value) in measures.items()]))


def _utilisation(frame: DataFrame, by: Sequence[str], committed: Column, used: Column,
                 unused: Column, hours: Column, effective: Column, listed: Column) -> DataFrame:
    return (frame.select("commitment_type", "commitment_id", *by,
                         C.money(committed).alias("period_commitment_cost"),
                         C.money(used).alias("used_commitment"),
                         C.money(unused).alias("unused_commitment"),
                         C.money(hours).alias("unused_hours"),
                         C.percent(unused, committed, 1).alias("unused_pct"),
                         C.percent(used, committed, 1).alias("utilisation_pct"),
                         C.money(effective).alias("effective_cost"),
                         C.money(listed).alias("on_demand_equivalent"))
            .orderBy(F.desc_nulls_last("unused_commitment"), "commitment_type", "commitment_id"))


def utilisation_of(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Utilisation report of commitment groups; see ``commitment_utilisation``."""
    packed = pack(groups, MEASURES)
    m = F.col("measures")
    totals = packed.agg(F.struct(*[
        F.sum(m[n]).alias(n) for n in ("ri_effective", "ri_list", "sp_effective", "sp_list")])
        ).scalar()
    ri = F.col("commitment_type") == "ReservedInstance"
    return _utilisation(
        packed.where(m["fee_rows"] > 0), by,
        committed=F.when(ri, m["ri_committed"]).otherwise(m["sp_committed"]),
        used=F.when(ri, m["ri_used"]).otherwise(m["sp_used"]),
        unused=F.when(ri, m["ri_unused"]).otherwise(m["sp_committed"] - m["sp_used"]),
        hours=F.when(ri, m["ri_hours"]),
        effective=F.when(ri, totals["ri_effective"]).otherwise(totals["sp_effective"]),
        listed=F.when(ri, totals["ri_list"]).otherwise(totals["sp_list"]))


def commitment_utilisation(df: DataFrame, period: Period, by: Sequence[str] = ()) -> DataFrame:
    """Committed, used and unused money per commitment that has fee rows in the period.

    Used reservation money is read from fee rows, and ``effective_cost`` and
    ``on_demand_equivalent`` are totals of the whole section repeated on each row.
    ``by`` splits the rows further by columns of the fee rows.
    """
    return utilisation_of(commitment_groups(df, period, by), by)


def commitment_utilisation_by_arn(df: DataFrame, period: Period) -> DataFrame:
    """Utilisation with every figure belonging to its own commitment.

    Used reservation money comes from the covered usage rows of that reservation (upfront
    and recurring), and so do effective cost and list equivalent.
    """
    groups = commitment_groups(df, period)
    ri = F.col("commitment_type") == "ReservedInstance"

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    used = F.when(ri, n("ri_recurring_used") + n("ri_upfront_used")).otherwise(n("sp_used"))
    unused = F.when(ri, n("ri_unused")).otherwise(n("sp_committed") - n("sp_used"))
    return _utilisation(
        groups, (), committed=used + unused, used=used, unused=unused,
        hours=F.when(ri, F.col("ri_hours")),
        effective=F.when(ri, F.col("ri_effective")).otherwise(F.col("sp_effective")),
        listed=F.when(ri, F.col("ri_list")).otherwise(F.col("sp_list")))
