"""Comparing results: against trusted figures, and pruned against unpruned reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from costweave.checks.findings import per_row, spread, finding
from costweave.operators.reconcile import reconcile
from costweave.plans.scans import scanned_by_side, whole_plans
from costweave.sources.period import Period


def check_reconciles(df: DataFrame, period: Period, trusted: DataFrame,
                     measure: str = "unblended_all_types", tolerance: float = 0.01) -> DataFrame:
    """Monthly totals against ``trusted`` (usage_month, figure).

    Months missing on either side are findings too. Both sides hold one row per month.
    """
    ours = reconcile(df, period).select("usage_month", F.col(measure).alias("ours"))
    both = ours.join(trusted.select("usage_month", "figure"), "usage_month", "full_outer")
    gap = F.round(F.col("ours") - F.col("figure"), 2)
    state = (F.when(F.col("ours").isNull(), "no rows for this month")
             .when(F.col("figure").isNull(), "no trusted figure")
             .when(F.abs(gap) <= tolerance, "agrees").otherwise("differs"))
    return per_row(both.withColumn("state", state), "reconcile", "error",
                   F.col("state") == "agrees", F.col("usage_month"), gap, F.col("state"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur a different number of times on both sides, with the surplus on the left.

    One aggregation over the union instead of an ``exceptAll`` each way.
    """
    names = left.columns
    signed = (left.withColumn("_side", F.lit(1))
              .unionByName(right.select(*names).withColumn("_side", F.lit(-1))))
    return (signed.groupBy(*names).agg(F.sum("_side").alias("surplus"))
            .where(F.col("surplus") != 0))


def differing_keys(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Keys (all columns that are not floating) whose rows differ between both sides.

    Sums of doubles depend on the order of rows, so measures count as equal within
    ``tolerance``; a missing measure equals no amount. One aggregation over the union.
    """
    measures = [f.name for f in left.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    keys = [c for c in left.columns if c not in measures]
    signed = (left.withColumn("_side", F.lit(1))
              .unionByName(right.select(*left.columns).withColumn("_side", F.lit(-1))))
    gaps = [F.sum(F.coalesce(F.col(m), F.lit(0.0)) * F.col("_side")).alias(m) for m in measures]
    nulls = [F.sum(F.when(F.col(m).isNull(), F.col("_side")).otherwise(0)).alias(f"_null_{m}") for m in measures]
    off = F.col("surplus") != 0
    for m in measures:
        off = off | (F.abs(F.col(m)) > tolerance) | (F.col(f"_null_{m}") != 0)
    return (signed.groupBy(*keys).agg(F.sum("_side").alias("surplus"), *gaps, *nulls).where(off)
            .drop(*[f"_null_{m}" for m in measures]))


class _Unpruned(Period):
    """The same instants without the predicate on partition columns."""

    def partitions(self):
        return F.lit(True)


def check_pruning(df: DataFrame, period: Period,
                  operator: Callable[[DataFrame, Period], DataFrame]) -> DataFrame:
    """Does an operator give the same rows with and without partition predicates, from fewer files?

    A difference means rows whose partition and usage month disagree. Amounts are equal
    within a cent. ``observed`` of the first finding is the number of keys that differ, of the second the
    files that were read with the predicates. Reading fewer is expected unless the table has
    no files or no other partitions than those of the period. Both sides run once, in one job, when the check is called, as the
    files are those that Spark has counted.
    """
    pruned = operator(df, period)
    unpruned = operator(df, _Unpruned(period.months, period.start, period.end))
    diff = differing_keys(pruned, unpruned).agg(F.count("*").alias("rows"))
    with whole_plans(df.sparkSession):
        keys = diff.collect()[0]["rows"]
    few, all_ = scanned_by_side(diff)
    fewer = few.files < all_.files or all_.files == 0 or 0 < few.partitions == all_.partitions
    return spread(df.sparkSession.range(1), [
        finding("pruning", "error", F.lit(keys == 0), F.lit("result keys"), F.lit(keys),
                F.lit("keys that differ without pruning")),
        finding("pruning_files", "warning", F.lit(fewer), F.lit("files read"), F.lit(few.files),
                F.lit(f"of {all_.files} files without pruning"))])
