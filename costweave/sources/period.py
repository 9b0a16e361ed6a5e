"""Billing periods: which months to read and which timestamps to keep."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from costweave.functions.calendar import USAGE_START

Month = tuple[int, int]


def _next(month: Month) -> Month:
    year, mon = month
    return (year + 1, 1) if mon == 12 else (year, mon + 1)


def _first(month: Month) -> datetime:
    return datetime(month[0], month[1], 1)


@dataclass(frozen=True)
class Period:
    """A set of whole months, optionally narrowed to ``[start, end)`` timestamps.

    Partition predicates are exact (year, month) pairs, so a December-January span neither
    loses rows nor reads other months, and months are zero-padded as the folders are.
    """

    months: tuple[Month, ...]
    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        if not self.months:
            raise ValueError("a period needs at least one month")
        for year, mon in self.months:
            if not (1000 <= year <= 9999 and 1 <= mon <= 12):
                raise ValueError(f"not a month: {(year, mon)}")
        object.__setattr__(self, "months", tuple(sorted(set(self.months))))

    @classmethod
    def month(cls, year: int, month: int) -> Period:
        return cls(((year, month),))

    @classmethod
    def span(cls, first: Month, last: Month) -> Period:
        """Every month from ``first`` to ``last``, both included."""
        if last < first:
            raise ValueError(f"{last} is before {first}")
        months = [first]
        while months[-1] < last:
            months.append(_next(months[-1]))
        return cls(tuple(months))

    @classmethod
    def range(cls, start: datetime, end: datetime) -> Period:
        """The half-open timestamp range ``[start, end)`` and the months it touches."""
        if end <= start:
            raise ValueError("the end of a period is exclusive and must be after its start")
        last = end - timedelta(microseconds=1)
        whole = cls.span((start.year, start.month), (last.year, last.month))
        return cls(whole.months, start, end)

    def runs(self) -> list[tuple[datetime, datetime]]:
        """Contiguous ``[start, end)`` stretches of the months, clipped to start and end."""
        stretches: list[list[Month]] = []
        for month in self.months:
            if stretches and _next(stretches[-1][1]) == month:
                stretches[-1][1] = month
            else:
                stretches.append([month, month])
        runs = []
        for first, last in stretches:
            lo, hi = _first(first), _first(_next(last))
            lo = max(lo, self.start) if self.start else lo
            hi = min(hi, self.end) if self.end else hi
            if lo < hi:
                runs.append((lo, hi))
        return runs

    def shifted(self, hours: int) -> Period:
        """The same stretch of local days as UTC instants, where local time is UTC plus ``hours``.

        Only for one contiguous stretch; it may touch one month more than the local days do.
        """
        stretches = self.runs()
        if len(stretches) != 1:
            raise ValueError("a shifted day needs months that follow each other")
        lo, hi = stretches[0]
        return Period.range(lo - timedelta(hours=hours), hi - timedelta(hours=hours))

    @property
    def first_instant(self) -> datetime:
        return self.runs()[0][0]

    @property
    def last_day(self) -> datetime:
        return self.runs()[-1][1] - timedelta(microseconds=1)

    def partitions(self) -> Column:
        """Literal predicate on the partition columns, exact for the months."""
        by_year: dict[int, list[int]] = {}
        for year, mon in self.months:
            by_year.setdefault(year, []).append(mon)
        full = [f"{y:04d}" for y, ms in by_year.items() if len(ms) == 12]
        parts = [F.col("year").isin(*full)] if full else []
        for year, mons in by_year.items():
            if len(mons) == 12:
                continue
            labels = [f"{m:02d}" for m in mons]
            match = F.col("month") == labels[0] if len(labels) == 1 else F.col("month").isin(*labels)
            parts.append((F.col("year") == f"{year:04d}") & match)
        return reduce(lambda a, b: a | b, parts)

    def instants(self, df: DataFrame, column: str = USAGE_START) -> Column:
        """Half-open range on the timestamp, in the column's own type so it is pushed down."""
        kind = df.schema[column].dataType
        ts = F.col(column)

        def bound(moment: datetime) -> Column:
            return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)

        return reduce(lambda a, b: a | b,
                      [(ts >= bound(lo)) & (ts < bound(hi)) for lo, hi in self.runs()])

    def scope(self, df: DataFrame, column: str = USAGE_START) -> DataFrame:
        """The rows of the period: range of ``column`` and partition pairs together."""
        return df.where(self.instants(df, column) & self.partitions())

    def paths(self, root: str) -> list[str]:
        """The month folders under ``root``."""
        return [f"{root.rstrip('/')}/year={y:04d}/month={m:02d}" for y, m in self.months]
