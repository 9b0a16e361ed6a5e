"""Session settings the jobs are meant to run with."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
RECOMMENDED = {
    # Billing timestamps are UTC; days and months are cut in this zone.
    "spark.sql.session.timeZone": "UTC",
    # Coalesces small shuffle partitions, splits skewed ones and lets REBALANCE work.
    "spark.sql.adaptive.enabled": "true",
    # Wide projections (80 columns) compile to methods the JVM will not optimise; beyond this
    # size Spark switches to smaller generated functions, several times faster.
    HUGE_METHOD: "8000",
    # Skips recording a Python call site for each column expression while plans are built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with the recommended settings; later ``config`` calls still win."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """The recommended code-size limit while wide rows are written, whatever the session's own is."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, RECOMMENDED[HUGE_METHOD])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD)
        else:
            spark.conf.set(HUGE_METHOD, before)
