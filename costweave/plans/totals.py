"""Grand totals of grouped frames without a second scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def totals_struct(grouped: DataFrame, measures: list[str]) -> Column:
    """One-row totals of all ``measures`` as a scalar subquery returning a struct.

    Read single totals with ``totals_struct(...)["name"]``. Summing every additive measure
    keeps the subquery's partial aggregation identical to the one of ``grouped``, so Spark
    reuses that shuffle: the source is scanned once, no window pulls all groups into one
    partition, and nothing is joined.
    """
    one_row = grouped.agg(F.struct(*[F.sum(m).alias(m) for m in measures]).alias("totals"))
    return one_row.scalar()


def with_share(grouped: DataFrame, part: str, measures: list[str], share: str,
               digits: int = 2) -> DataFrame:
    """Add ``share``: the percentage each group holds of the grand total of ``part``."""
    total = totals_struct(grouped, measures)[part]
    return grouped.withColumn(
        share, F.round(100.0 * F.col(part) / F.nullif(total, F.lit(0.0)), digits))


def pack(grouped: DataFrame, measures: list[str], into: str = "measures") -> DataFrame:
    """All ``measures`` as one map column of doubles, the other columns unchanged.

    For reports whose rows and totals use different measures: reading one entry of the map
    keeps all of them alive, so rows and totals still share one aggregation and one scan.
    """
    keys = [c for c in grouped.columns if c not in measures]
    values = F.array(*[F.col(m).cast("double") for m in measures])
    return grouped.select(*keys, F.map_from_arrays(
        F.array(*[F.lit(m) for m in measures]), values).alias(into))
