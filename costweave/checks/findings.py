"""The common shape of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS = ["check_id", "severity", "ok", "subject", "observed", "detail"]


def finding(check_id: str, severity: str, ok: Column, subject: Column, observed: Column,
            detail: Column) -> Column:
    """One finding as a struct column."""
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"),
                    ok.alias("ok"), subject.alias("subject"),
                    observed.cast("double").alias("observed"), detail.alias("detail"))


def per_row(df: DataFrame, check_id: str, severity: str, ok: Column, subject: Column,
            observed: Column, detail: Column) -> DataFrame:
    """One finding per row of ``df``."""
    return df.select(finding(check_id, severity, ok, subject, observed, detail).alias("f")
                     ).select("f.*")


def spread(one_row: DataFrame, findings: list[Column]) -> DataFrame:
    """Several findings out of a one-row frame of aggregates."""
    return one_row.select(F.inline(F.array(*findings)))
