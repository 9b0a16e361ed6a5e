"""Anomalies of new days from the days before them that trailing windows still see.

The state of a month is, for every service, the last rows of its daily series up to the end of that month:
as many as the trailing window has, and as many of each weekday as the weekday mean has. A month is judged
from the state of the month before it and its own days, so older days are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from costweave.operators import trend as T
from costweave.plans.rollups import _files, _sum_back
from costweave.sources.billing_table import write_partitioned
from costweave.sources.period import Month, Period

STATE = "year string, month string, service string, usage_date date, amortized_cost double"
SERIES = ["service", "usage_date", "amortized_cost"]


def last_rows(daily: DataFrame, window_days: int = 7, same_weekday_rows: int | None = None) -> DataFrame:
    """The rows of each service that windows of a later day still see."""
    newest = lambda *keys: Window.partitionBy("service", *keys).orderBy(F.col("usage_date").desc())
    ranked = daily.select(*SERIES).withColumn("back", F.row_number().over(newest()))
    seen = F.col("back") <= window_days
    if same_weekday_rows:
        ranked = ranked.withColumn("back_weekday", F.row_number().over(newest(F.dayofweek("usage_date"))))
        seen = seen | (F.col("back_weekday") <= same_weekday_rows)
    return ranked.where(seen).select(*SERIES)


def before(month: Month) -> Month:
    return (month[0] - 1, 12) if month[1] == 1 else (month[0], month[1] - 1)


def state_of(spark: SparkSession, root: str, month: Month) -> DataFrame | None:
    """The state at the end of a month; None where none was kept."""
    (folder,) = Period.month(*month).paths(root)
    if not _files(spark, folder):
        return None
    return spark.read.schema(STATE).option("basePath", root).parquet(folder).select(*SERIES)


def keep_state(daily: DataFrame, root: str, month: Month, window_days: int = 7,
               same_weekday_rows: int | None = None) -> None:
    """Writes the state at the end of ``month``; ``daily`` are the days up to it, or the state before and its days."""
    state = last_rows(daily, window_days, same_weekday_rows)
    labels = {"year": F.lit(f"{month[0]:04d}"), "month": F.lit(f"{month[1]:02d}")}
    write_partitioned(state.withColumns(labels).select("year", "month", *SERIES), root, ["service"])


def start(rollup: DataFrame, root: str, period: Period, window_days: int = 7,
          same_weekday_rows: int | None = None) -> None:
    """Keeps the state at the end of a first period, from all its days."""
    days = _sum_back(rollup, period, ["service", "usage_date"], ["amortized_cost"])
    keep_state(days, root, period.months[-1], window_days, same_weekday_rows)


def anomalies_next(rollup: DataFrame, root: str, month: Month, window_days: int = 7,
                   same_weekday_rows: int | None = None, **thresholds) -> DataFrame:
    """``anomalies`` for the days of one month of ``service_day``, equal to those of a run over all
    days; keeps the state at its end for the month after.

    The state must have been kept with the same windows, for the month before (ValueError if there is none). A month
    delivered again is run again, and then the months after it, in order. Months without rows keep
    the state as it was. Only this month's part of the rollup is read.
    """
    spark = rollup.sparkSession
    state = state_of(spark, root, before(month))
    if state is None:
        raise ValueError(f"no state for {before(month)} under {root}")
    days = _sum_back(rollup, Period.month(*month), ["service", "usage_date"], ["amortized_cost"]).select(*SERIES)
    series = state.unionByName(days)
    keep_state(series, root, month, window_days, same_weekday_rows)
    first = F.lit(Period.month(*month).first_instant.date())
    found = T.anomalies_of(series, window_days=window_days, same_weekday_rows=same_weekday_rows, **thresholds)
    return found.where(F.col("usage_date") >= first)
