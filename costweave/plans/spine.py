"""Complete day or month series for sparse aggregated series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

STEPS = {"day": "INTERVAL '1' DAY", "month": "INTERVAL '1' MONTH"}


def fill_gaps(series: DataFrame, keys: list[str], slot: str, first: date, last: date,
              step: str, fills: dict[str, object]) -> DataFrame:
    """One row per key and step from ``first`` to ``last``; new rows take ``fills``.

    ``series`` holds at most one row per key and slot. Each row spreads over the gap behind
    it, so the series is read once and needs neither a join nor the list of keys.
    """
    width = F.expr(STEPS[step])
    by_key = Window.partitionBy(*keys).orderBy(slot)
    lo = F.least(F.lit(first).cast("date"), F.col(slot))
    hi = F.greatest(F.lit(last).cast("date"), F.col(slot))
    spread = (series
              .withColumn("_behind", F.lag(slot).over(by_key))
              .withColumn("_ahead", F.lead(slot).over(by_key))
              .withColumn("_from", F.when(F.col("_behind").isNull(), lo).otherwise(F.col(slot)))
              .withColumn("_to", F.coalesce(F.to_date(F.col("_ahead") - width), hi))
              .withColumn("_slot", F.explode(F.sequence("_from", "_to", width))))
    real = F.col("_slot") == F.col(slot)
    names = [c for c in series.columns if c not in keys and c != slot]
    return spread.select(
        *keys, F.col("_slot").alias(slot),
        *[F.when(real, F.col(c)).otherwise(F.lit(fills[c])).alias(c) if c in fills
          else F.when(real, F.col(c)).alias(c) for c in names])


def calendar_spine(spark: SparkSession, slot: str, first: date, last: date, step: str) -> DataFrame:
    """The days or months from ``first`` to ``last``; its size is fixed by the period."""
    return spark.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(STEPS[step]))).alias(slot))


def left_join_spine(series: DataFrame, slot: str, first: date, last: date, step: str) -> DataFrame:
    """Calendar spine LEFT JOIN an aggregated series: absent steps appear with NULLs."""
    spine = calendar_spine(series.sparkSession, slot, first, last, step)
    return spine.join(series, slot, "left")
