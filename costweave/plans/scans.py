"""What the scans of an executed query read: files, partitions, bytes and rows, from Spark's own metrics."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_EXCLUDED = "spark.sql.adaptive.optimizer.excludedRules"
_DROPS_EMPTY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@dataclass(frozen=True)
class Scanned:
    """Sums over scans. ``partitions`` is zero where the source has no partition folders."""

    files: int = 0
    partitions: int = 0
    bytes: int = 0
    rows: int = 0

    def __add__(self, other: Scanned) -> Scanned:
        return Scanned(self.files + other.files, self.partitions + other.partitions,
                       self.bytes + other.bytes, self.rows + other.rows)


@contextlib.contextmanager
def whole_plans(spark: SparkSession) -> Iterator[None]:
    """Queries run within keep the parts of their plan that turn out to give no rows, and so their scans."""
    before = spark.conf.get(_EXCLUDED, None)
    spark.conf.set(_EXCLUDED, f"{before},{_DROPS_EMPTY}" if before else _DROPS_EMPTY)
    try:
        yield
    finally:
        spark.conf.set(_EXCLUDED, before) if before else spark.conf.unset(_EXCLUDED)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _below(node) -> list:
    """The plans under a node: of adaptive plans and finished stages the one that ran, of a reused exchange the original."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return [node.child()]
    return [*_items(node.children()), *_items(node.subqueries())]


def _walk(node) -> Iterator:
    yield node
    for child in _below(node):
        yield from _walk(child)


def _read_by(node) -> Scanned:
    total = Scanned()
    for scan in _walk(node):
        if scan.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = scan.metrics()
            one = lambda name: metrics.apply(name).value() if metrics.contains(name) else 0
            total += Scanned(one("numFiles"), one("numPartitions"), one("filesSize"), one("numOutputRows"))
    return total


def scanned(df: DataFrame) -> Scanned:
    """What all scans of ``df`` read; ``df`` itself must have run (``collect`` and not ``count``)."""
    return _read_by(df._jdf.queryExecution().executedPlan())


def shuffled(df: DataFrame) -> int:
    """The bytes that the shuffles of ``df`` wrote; ``df`` itself must have run."""
    total = 0
    for node in _walk(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleBytesWritten").value()
    return total


def scanned_by_side(df: DataFrame) -> list[Scanned]:
    """What each side of the outermost union of ``df`` read; ``df`` itself must have run."""
    for node in _walk(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "UnionExec":
            return [_read_by(side) for side in _items(node.children())]
    raise ValueError("there is no union in this plan")
