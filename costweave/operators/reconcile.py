"""Monthly totals to hold against a figure you trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.functions.calendar import month_label, month_start
from costweave.operators.breakdown import ACCOUNT, PRODUCT
from costweave.sources.period import Period


def reconcile(df: DataFrame, period: Period) -> DataFrame:
    """Cash, amortized, consumption-only and gross totals per month.

    Rows are summed per (month, product, account) first. The two distinct counts then run
    on those groups, where expanding rows for them costs nothing.
    """
    groups = (period.scope(df)
              .groupBy(month_start().alias("month_date"), F.col(PRODUCT), F.col(ACCOUNT))
              .agg(F.sum(C.CASH).alias("cash"), F.sum(C.amortized()).alias("accrued"),
                   C.sum_except(C.AMORTIZED, *S.NON_CONSUMPTION).alias("consumed"),
                   C.sum_for(C.CASH, *S.GROSS_USAGE).alias("gross"), F.count("*").alias("n")))
    return (groups.groupBy("month_date")
            .agg(C.money(F.sum("cash")).alias("unblended_all_types"),
                 C.money(F.sum("accrued")).alias("amortized_all_types"),
                 C.money(F.sum("consumed")).alias("amortized_usage_only"),
                 C.money(F.sum("gross")).alias("gross_usage_only"),
                 F.sum("n").alias("line_items"),
                 F.countDistinct(PRODUCT).alias("distinct_products"),
                 F.countDistinct(ACCOUNT).alias("distinct_accounts"))
            .select(month_label("month_date").alias("usage_month"), "unblended_all_types",
                    "amortized_all_types", "amortized_usage_only", "gross_usage_only",
                    "line_items", "distinct_products", "distinct_accounts")
            .orderBy("usage_month"))
