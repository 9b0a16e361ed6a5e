"""Cost breakdowns of a period: by service, account, resource, tag, team and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.functions.calendar import USAGE_START
from costweave.plans.totals import with_share
from costweave.sources.period import Period

ACCOUNT = "line_item_usage_account_id"
PRODUCT = "line_item_product_code"
AMOUNT = "line_item_usage_amount"
RESOURCE = "line_item_resource_id"


def month_probe(df: DataFrame, year: int, month: int) -> DataFrame:
    """Cheapest look at one month: rows, first and last usage, types, cash total.

    Zero rows means a wrong partition spelling or a month that is not loaded. Types are
    counted from per-type partial sums, so the row-level pass only keeps 14-odd groups.
    """
    by_type = (df.where(Period.month(year, month).partitions())
               .groupBy(C.TYPE)
               .agg(F.count("*").alias("n"), F.min(USAGE_START).alias("lo"),
                    F.max(USAGE_START).alias("hi"), F.sum(C.cash()).alias("cash")))
    return by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_month"),
        F.min("lo").alias("first_usage"),
        F.max("hi").alias("last_usage"),
        F.count(C.TYPE).alias("distinct_line_item_types"),
        C.money(F.sum("cash")).alias("unblended_total"))


def _service_groups(df: DataFrame, period: Period, basis: str) -> DataFrame:
    return (period.scope(df)
            .groupBy(F.col(ACCOUNT).alias("usage_account_id"), F.col(PRODUCT).alias("service"))
            .agg(F.sum(C.cash()).alias("unblended_cost"),
                 F.sum(C.basis(basis)).alias("amortized_cost"),
                 F.sum(AMOUNT).alias("usage_amount"),
                 F.count("*").alias("line_items")))


def cost_by_service(df: DataFrame, period: Period, basis: str = "amortized") -> DataFrame:
    """Cost per account and service with its share of the period. NULL keys stay rows."""
    groups = _service_groups(df, period, basis).drop("usage_amount")
    shared = with_share(groups, "amortized_cost",
                        ["unblended_cost", "amortized_cost", "line_items"], "share_of_total_pct")
    return (shared.select("usage_account_id", "service",
                          C.money(F.col("unblended_cost")).alias("unblended_cost"),
                          C.money(F.col("amortized_cost")).alias("amortized_cost"),
                          "share_of_total_pct", "line_items")
            .orderBy(F.desc_nulls_last("amortized_cost")))


def cost_by_service_pruned(df: DataFrame, period: Period, basis: str = "amortized") -> DataFrame:
    """Cost and usage per service and account: the narrowest full-period read, no share."""
    return (_service_groups(df, period, basis)
            .select("service", "usage_account_id",
                    C.money(F.col("unblended_cost")).alias("unblended_cost"),
                    C.money(F.col("amortized_cost")).alias("amortized_cost"),
                    F.round("usage_amount", 4).alias("usage_amount"), "line_items")
            .orderBy(F.desc_nulls_last("amortized_cost")))


def cost_by_account(df: DataFrame, period: Period, basis: str = "amortized") -> DataFrame:
    """Cash per account split by line item type, plus subtotals. Absent types are NULL.

    Rows are first summed per (account, type); the wide split then runs on those few
    groups and the distinct type count comes for free.
    """
    by_type = (period.scope(df)
               .groupBy(C.label_null(ACCOUNT, "(blank)").alias("usage_account_id"),
                        F.col(C.TYPE))
               .agg(F.sum(C.cash()).alias("cash"), F.sum(C.basis(basis)).alias("accrued")))
    cash = "cash"
    split = {
        "usage_on_demand": C.sum_for(cash, S.USAGE),
        "ri_discounted_usage": C.sum_for(cash, S.DISCOUNTED_USAGE),
        "sp_covered_usage": C.sum_for(cash, S.SP_COVERED),
        "sp_negation": C.sum_for(cash, S.SP_NEGATION),
        "ri_fee": C.sum_for(cash, S.RI_FEE),
        "sp_fee": C.sum_for(cash, S.SP_RECURRING, S.SP_UPFRONT),
        "other_fees": C.sum_for(cash, S.FEE),
        "tax": C.sum_for(cash, S.TAX),
        "credits": C.sum_for(cash, S.CREDIT),
        "refunds": C.sum_for(cash, S.REFUND),
        "discounts": C.sum_for(cash, S.DISCOUNT, S.BUNDLED_DISCOUNT),
        "consumption_subtotal": C.sum_except(cash, *S.NON_CONSUMPTION),
        "unblended_total": F.sum(cash),
        "amortized_total": F.sum("accrued"),
    }
    return (by_type.groupBy("usage_account_id")
            .agg(*[C.money(v).alias(k) for k, v in split.items()],
                 F.count(C.TYPE).alias("distinct_line_item_types"))
            .orderBy(F.desc_nulls_last("amortized_total")))


def resource_groups(df: DataFrame, period: Period, basis: str = "amortized") -> DataFrame:
    """Unrounded cost per account, service and resource."""
    return (period.scope(df)
            .groupBy(C.label_null(ACCOUNT, "(blank)").alias("usage_account_id"),
                     F.col(PRODUCT).alias("service"),
                     C.label_blank(RESOURCE, "(no resource id)").alias("resource_id"))
            .agg(F.sum(C.basis(basis)).alias("amortized_cost"),
                 F.sum(AMOUNT).alias("usage_amount"), F.count("*").alias("line_items")))


def rank_resources(groups: DataFrame, limit: int | None = 200) -> DataFrame:
    """Shares of the whole period, then the head of the list (all of it for ``None``)."""
    shared = with_share(groups, "amortized_cost",
                        ["amortized_cost", "usage_amount", "line_items"], "share_of_period_pct")
    ranked = (shared.select("usage_account_id", "service", "resource_id",
                            C.money(F.col("amortized_cost")).alias("amortized_cost"),
                            F.round("usage_amount", 4).alias("usage_amount"), "line_items",
                            "share_of_period_pct")
              .orderBy(F.desc_nulls_last("amortized_cost"), F.asc_nulls_last("usage_account_id"),
                       F.asc_nulls_last("service"), F.asc_nulls_last("resource_id")))
    return ranked if limit is None else ranked.limit(limit)


def cost_by_resource(df: DataFrame, period: Period, limit: int | None = 200,
                     basis: str = "amortized") -> DataFrame:
    """Costliest resources, with spend that has no resource id as a row of its own.

    NULL and empty ids are one bucket. The bucket may hold most of the rows; partial
    aggregation reduces it to one row per task before the shuffle.
    """
    return rank_resources(resource_groups(df, period, basis), limit)


def cost_by_tag(df: DataFrame, period: Period, tag_column: str = "resource_tags_user_team",
                label: str = "team", fold_case: bool = False,
                basis: str = "amortized") -> DataFrame:
    """Cost per value of one tag; NULL and empty tags form '(untagged)'."""
    groups = (period.scope(df)
              .groupBy(C.label_blank(tag_column, "(untagged)", fold_case).alias(label))
              .agg(F.sum(C.basis(basis)).alias("amortized_cost"),
                   F.sum(C.cash()).alias("unblended_cost"), F.count("*").alias("line_items")))
    shared = with_share(groups, "amortized_cost",
                        ["amortized_cost", "unblended_cost", "line_items"], "share_of_period_pct")
    return (shared.select(label, C.money(F.col("amortized_cost")).alias("amortized_cost"),
                          C.money(F.col("unblended_cost")).alias("unblended_cost"),
                          "line_items", "share_of_period_pct")
            .orderBy(F.desc_nulls_last("amortized_cost")))


def cost_by_team_env(df: DataFrame, period: Period,
                     team_column: str = "resource_tags_user_team",
                     env_column: str = "resource_tags_user_environment",
                     fold_case: bool = False, basis: str = "amortized") -> DataFrame:
    """Cost per team and environment; a row is allocated if either tag is present.

    Accounts are counted from per-account partial sums instead of a row-level distinct.
    """
    per_account = (period.scope(df)
                   .groupBy(C.label_blank(team_column, "(no team)", fold_case).alias("team"),
                            C.label_blank(env_column, "(no env)", fold_case).alias("environment"),
                            (F.nullif(F.col(team_column), F.lit("")).isNull()
                             & F.nullif(F.col(env_column), F.lit("")).isNull()).alias("bare"),
                            F.col(ACCOUNT))
                   .agg(F.sum(C.basis(basis)).alias("amortized_cost"),
                        F.count("*").alias("line_items")))
    groups = (per_account.groupBy("team", "environment", "bare")
              .agg(F.sum("amortized_cost").alias("amortized_cost"),
                   F.count(ACCOUNT).alias("accounts"), F.sum("line_items").alias("line_items")))
    shared = with_share(groups, "amortized_cost", ["amortized_cost", "accounts", "line_items"],
                        "share_of_period_pct")
    return (shared.select("team", "environment",
                          F.when(F.col("bare"), F.lit("unallocated")).otherwise(F.lit("allocated"))
                          .alias("allocated_vs_unallocated"),
                          C.money(F.col("amortized_cost")).alias("amortized_cost"),
                          "accounts", "line_items", "share_of_period_pct")
            .orderBy(F.desc_nulls_last("amortized_cost")))


def type_contribution(df: DataFrame, period: Period) -> DataFrame:
    """Rows and cash per line item type."""
    return (period.scope(df).groupBy(F.col(C.TYPE).alias("line_item_type"))
            .agg(F.count("*").alias("line_items"), C.money(F.sum(C.cash())).alias("unblended_cost"))
            .orderBy(F.desc_nulls_last("unblended_cost")))
