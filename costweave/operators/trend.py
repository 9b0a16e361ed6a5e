"""Change over time: month trend, top drivers, daily series, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from costweave.functions import cost as C
from costweave.functions.calendar import (BILLING_START, USAGE_START, month_label, month_start,
                                          usage_date)
from costweave.operators.breakdown import ACCOUNT, AMOUNT, PRODUCT
from costweave.plans.spine import fill_gaps
from costweave.plans.totals import totals_struct
from costweave.sources.period import Month, Period

USAGE_TYPE = "line_item_usage_type"


def _only(df: DataFrame, products: str | Sequence[str] | None) -> DataFrame:
    if products is None:
        return df
    if isinstance(products, str):
        return df.where(F.col(PRODUCT) == products)
    return df.where(F.col(PRODUCT).isin(*products))


def monthly_cost(df: DataFrame, period: Period, products: Sequence[str] | None = None,
                 by_billing_period: bool = False, basis: str = "amortized") -> DataFrame:
    """Unrounded cost per service and month (a DATE, the first of the month).

    By billing period the bounds are those of the billing period too, so usage from before
    it that was billed in it counts.
    """
    column = BILLING_START if by_billing_period else USAGE_START
    return (_only(period.scope(df, column), products)
            .groupBy(month_start(by_billing_period).alias("month_date"),
                     F.col(PRODUCT).alias("service"))
            .agg(F.sum(C.basis(basis)).alias("amortized_cost")))


def trend_of(monthly: DataFrame, min_abs_delta: float | None = None) -> DataFrame:
    """Month-over-month view of a monthly series (see ``monthly_cost``)."""
    previous = F.lag("amortized_cost").over(Window.partitionBy("service").orderBy("month_date"))
    total = F.sum("amortized_cost").over(Window.partitionBy("month_date"))
    lagged = (monthly.withColumn("prev", previous).withColumn("month_total", total)
              .withColumn("delta", F.col("amortized_cost") - F.col("prev")))
    if min_abs_delta is not None:
        lagged = lagged.where(F.abs("delta") >= min_abs_delta)
    return (lagged.select(month_label("month_date").alias("usage_month"), "service",
                          C.money(F.col("amortized_cost")).alias("amortized_cost"),
                          C.money(F.col("prev")).alias("prev_month_cost"),
                          C.money(F.col("delta")).alias("mom_delta"),
                          C.percent(F.col("delta"), F.col("prev"), 1).alias("mom_delta_pct"),
                          C.money(F.col("month_total")).alias("month_total"))
            .orderBy(F.desc("usage_month"), F.desc_nulls_last("mom_delta")))


def mom_trend(df: DataFrame, period: Period, products: Sequence[str] | None = None,
              spine: bool = False, by_billing_period: bool = False,
              min_abs_delta: float | None = None, basis: str = "amortized") -> DataFrame:
    """Cost per service and month against the month before.

    By default the month before is the previous month *with rows*; ``spine=True`` fills
    absent months with 0 so that it is always the calendar month before.
    """
    monthly = monthly_cost(df, period, products, by_billing_period, basis)
    if spine:
        first, last = period.months[0], period.months[-1]
        monthly = fill_gaps(monthly, ["service"], "month_date", Period.month(*first)
                            .first_instant.date(), Period.month(*last).first_instant.date(),
                            "month", {"amortized_cost": 0.0})
    return trend_of(monthly, min_abs_delta)


DRIVER_KEYS = ["usage_account_id", "service", "usage_type"]


def _driver_keys() -> list[Column]:
    return [C.label_null(ACCOUNT, "(blank)").alias("usage_account_id"),
            F.col(PRODUCT).alias("service"), F.col(USAGE_TYPE).alias("usage_type")]


def _month_drivers(df: DataFrame, month: Month, basis: str) -> DataFrame:
    return (Period.month(*month).scope(df).groupBy(*_driver_keys())
            .agg(F.sum(C.basis(basis)).alias("cost")))


def joined_drivers(df: DataFrame, prev: Month, curr: Month, null_safe: bool = True,
                   basis: str = "amortized") -> DataFrame:
    """Previous and current cost per driver by a full outer join of two monthly aggregates.

    ``null_safe=False`` joins with plain equality, where a driver with a NULL key never
    meets itself and shows up twice.
    """
    p = _month_drivers(df, prev, basis).alias("p")
    c = _month_drivers(df, curr, basis).alias("c")

    def same(k: str) -> Column:
        left, right = F.col(f"c.{k}"), F.col(f"p.{k}")
        return left.eqNullSafe(right) if null_safe else left == right

    cond = same(DRIVER_KEYS[0]) & same(DRIVER_KEYS[1]) & same(DRIVER_KEYS[2])
    return c.join(p, cond, "full_outer").select(
        *[F.coalesce(F.col(f"c.{k}"), F.col(f"p.{k}")).alias(k) for k in DRIVER_KEYS],
        F.coalesce(F.col("p.cost"), F.lit(0.0)).alias("prev_cost"),
        F.coalesce(F.col("c.cost"), F.lit(0.0)).alias("curr_cost"))


def onepass_drivers(df: DataFrame, prev: Month, curr: Month,
                    basis: str = "amortized") -> DataFrame:
    """The null-safe result of ``joined_drivers`` from one aggregation and one shuffle."""
    both = Period((prev, curr))
    day = usage_date()
    in_curr = day >= F.lit(Period.month(*curr).first_instant.date())
    if curr < prev:
        in_curr = day < F.lit(Period.month(*prev).first_instant.date())
    value = C.basis(basis)
    return (both.scope(df).groupBy(*_driver_keys())
            .agg(F.coalesce(F.sum(F.when(~in_curr, value)), F.lit(0.0)).alias("prev_cost"),
                 F.coalesce(F.sum(F.when(in_curr, value)), F.lit(0.0)).alias("curr_cost")))


def driver_report(pairs: DataFrame, min_abs_delta: float | None = None,
                  total_row: bool = True) -> DataFrame:
    """Deltas, shares of the total change, directions and the total row.

    The total change covers all drivers, also those hidden by ``min_abs_delta``.
    Direction calls a zero delta and a new negative cost DOWN.
    """
    pairs = pairs.select(*DRIVER_KEYS, "prev_cost", "curr_cost")
    deltas = pairs.withColumn("delta", F.col("curr_cost") - F.col("prev_cost"))
    total = totals_struct(deltas, ["prev_cost", "curr_cost", "delta"])["delta"]
    direction = (F.when((F.col("prev_cost") == 0) & (F.col("curr_cost") > 0), "NEW")
                 .when((F.col("curr_cost") == 0) & (F.col("prev_cost") > 0), "GONE")
                 .when(F.col("delta") > 0, "UP").otherwise("DOWN"))
    shown = deltas
    if min_abs_delta is not None:
        shown = shown.where(F.abs("delta") >= min_abs_delta)
    detail = shown.select(
        *DRIVER_KEYS, C.money(F.col("prev_cost")).alias("prev_cost"),
        C.money(F.col("curr_cost")).alias("curr_cost"), C.money(F.col("delta")).alias("delta"),
        F.round(100.0 * F.col("delta") / F.nullif(total, F.lit(0.0)), 1)
        .alias("pct_of_total_change"),
        direction.alias("direction"), C.money(total).alias("period_total_change"))
    if total_row:
        detail = detail.unionByName(_total_row(pairs.sparkSession.range(1), total))
    return detail.orderBy(F.abs("delta").desc_nulls_last(), F.asc_nulls_last("usage_account_id"),
                          F.asc_nulls_last("service"), F.asc_nulls_last("usage_type"))


def _total_row(one_row: DataFrame, change: Column) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return one_row.select(
        F.lit("(all accounts)").alias("usage_account_id"),
        F.lit("(TOTAL CHANGE)").alias("service"),
        F.lit("(all usage types)").alias("usage_type"),
        nothing.alias("prev_cost"), nothing.alias("curr_cost"),
        C.money(change).alias("delta"), F.lit(100.0).alias("pct_of_total_change"),
        F.when(change > 0, "UP").otherwise("DOWN").alias("direction"),
        C.money(change).alias("period_total_change"))


def top_drivers(df: DataFrame, prev: Month, curr: Month, null_safe: bool = True,
                min_abs_delta: float | None = None, total_row: bool = True,
                method: str = "onepass", basis: str = "amortized") -> DataFrame:
    """What moved the bill between two months, biggest change first.

    The default sums both months in one pass over the two partitions. ``method="join"`` or
    ``null_safe=False`` use the full outer join.
    """
    if method == "onepass" and null_safe:
        pairs = onepass_drivers(df, prev, curr, basis)
    else:
        pairs = joined_drivers(df, prev, curr, null_safe, basis)
    return driver_report(pairs, min_abs_delta, total_row)


def daily_cost(df: DataFrame, period: Period, products: str | Sequence[str] | None = None,
               day_shift_hours: int = 0, basis: str = "amortized") -> DataFrame:
    """Unrounded cost, usage and rows per service and day.

    With a shifted day boundary the period means whole local days, so its bounds shift too.
    """
    if day_shift_hours:
        period = period.shifted(day_shift_hours)
    return (_only(period.scope(df), products)
            .groupBy(F.col(PRODUCT).alias("service"),
                     usage_date(day_shift_hours).alias("usage_date"))
            .agg(F.sum(C.basis(basis)).alias("amortized_cost"),
                 F.sum(AMOUNT).alias("usage_amount"), F.count("*").alias("row_count")))


def trailing(days: int):
    """The ``days`` rows before the current one, per service; the current row is left out."""
    return (Window.partitionBy("service").orderBy("usage_date")
            .rowsBetween(-days, -1))


def daily_series(df: DataFrame, period: Period, product: str, spine: bool = False,
                 window_days: int = 7, day_shift_hours: int = 0,
                 basis: str = "amortized") -> DataFrame:
    """Daily cost of one product against its trailing mean.

    The window is partitioned by product, so it never collapses to one partition when
    several series are computed together. ``spine=True`` adds absent days as zeros.
    """
    daily = daily_cost(df, period, product, day_shift_hours, basis)
    if spine:
        daily = fill_gaps(daily, ["service"], "usage_date", period.first_instant.date(),
                          period.last_day.date(), "day",
                          {"amortized_cost": 0.0, "usage_amount": 0.0, "row_count": 0})
    mean = F.avg("amortized_cost").over(trailing(window_days))
    return (daily.withColumn("mean", mean)
            .select("usage_date", C.money(F.col("amortized_cost")).alias("amortized_cost"),
                    F.round("usage_amount", 4).alias("usage_amount"), "row_count",
                    C.money(F.col("mean")).alias("trailing_7d_avg"),
                    C.money(F.col("amortized_cost") - F.col("mean")).alias("vs_trailing_7d"))
            .orderBy("usage_date"))


def baselined(daily: DataFrame, window_days: int = 7) -> DataFrame:
    """Trailing mean, sample deviation and row count of each service-day."""
    w = trailing(window_days)
    return daily.select("service", "usage_date", "amortized_cost",
                        F.avg("amortized_cost").over(w).alias("mean"),
                        F.stddev_samp("amortized_cost").over(w).alias("sd"),
                        F.count("*").over(w).alias("baseline_days"))


def anomalies_of(daily: DataFrame, min_days: int = 5, min_mean: float = 1.0, z: float = 3.0,
                 pct: float = 50.0, window_days: int = 7,
                 same_weekday_rows: int | None = None) -> DataFrame:
    """Service-days far from their trailing baseline, out of a daily series."""
    base = baselined(daily, window_days)
    extra = []
    if same_weekday_rows:
        same_day = (Window.partitionBy("service", F.dayofweek("usage_date"))
                    .orderBy("usage_date").rowsBetween(-same_weekday_rows, -1))
        base = base.withColumn("weekday_mean", F.avg("amortized_cost").over(same_day))
        extra = [C.money(F.col("weekday_mean")).alias("same_weekday_mean"),
                 C.percent(F.col("amortized_cost") - F.col("weekday_mean"),
                           F.col("weekday_mean"), 1).alias("same_weekday_pct")]
    off = F.col("amortized_cost") - F.col("mean")
    far = ((F.abs(C.ratio(off, F.col("sd"))) >= z)
           | (F.abs(100.0 * off / F.nullif(F.col("mean"), F.lit(0.0))) >= pct))
    return (base.where((F.col("baseline_days") >= min_days) & (F.col("mean") >= min_mean) & far)
            .select("service", "usage_date", C.money(F.col("amortized_cost"))
                    .alias("amortized_cost"),
                    C.money(F.col("mean")).alias("trailing_7d_mean"),
                    C.money(F.col("sd")).alias("trailing_7d_sd"), "baseline_days",
                    C.money(off).alias("deviation_abs"),
                    C.percent(off, F.col("mean"), 1).alias("deviation_pct"),
                    F.round(C.ratio(off, F.col("sd")), 2).alias("z_score"),
                    F.when(off > 0, "SPIKE").otherwise("DROP").alias("direction"), *extra)
            .orderBy(F.abs("deviation_abs").desc_nulls_last()))


def anomalies(df: DataFrame, period: Period, min_days: int = 5, min_mean: float = 1.0,
              z: float = 3.0, pct: float = 50.0, window_days: int = 7,
              same_weekday_rows: int | None = None, day_shift_hours: int = 0,
              spine: bool = False, basis: str = "amortized") -> DataFrame:
    """Days on which a service left its own recent normal.

    A flat baseline has a NULL z-score and is judged by percentage alone. For weekly cycles
    widen ``window_days`` and set ``same_weekday_rows`` to compare with the same weekdays.
    """
    daily = daily_cost(df, period, None, day_shift_hours, basis)
    if spine:
        daily = fill_gaps(daily, ["service"], "usage_date", period.first_instant.date(),
                          period.last_day.date(), "day",
                          {"amortized_cost": 0.0, "usage_amount": 0.0, "row_count": 0})
    return anomalies_of(daily, min_days, min_mean, z, pct, window_days, same_weekday_rows)
