"""Slim monthly tables kept beside the billing table, and reports answered from them.

Every rollup keeps ``year`` and ``month`` of its source rows, so refreshing a re-delivered
month replaces exactly that partition. Only measures that merge are stored: sums, and for distinct
counts, which do not add up, sketches, whose counts are approximate. ``month_date`` keeps rows whose usage
lies outside their partition apart, so reports drop them as the direct queries do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.functions.calendar import month_label, month_start, usage_date
from costweave.operators import breakdown as B, commitments as K, trend as T
from costweave.sources.billing_table import deliveries, read_billing, write_partitioned
from costweave.sources.period import Period

MONTH_KEYS = ["year", "month", "month_date"]


def _keys() -> list:
    return [F.col("year"), F.col("month"), month_start().alias("month_date")]


def service_month(df: DataFrame) -> DataFrame:
    """Cost per service and month."""
    return (df.groupBy(*_keys(), F.col(B.PRODUCT).alias("service"))
            .agg(F.sum(C.amortized()).alias("amortized_cost"),
                 F.sum(C.cash()).alias("unblended_cost"), F.count("*").alias("line_items")))


def resource_month(df: DataFrame) -> DataFrame:
    """Cost per account, service, resource and month."""
    return (df.groupBy(*_keys(), C.label_null(B.ACCOUNT, "(blank)").alias("usage_account_id"),
                       F.col(B.PRODUCT).alias("service"),
                       C.label_blank(B.RESOURCE, "(no resource id)").alias("resource_id"))
            .agg(F.sum(C.amortized()).alias("amortized_cost"),
                 F.sum(B.AMOUNT).alias("usage_amount"), F.count("*").alias("line_items")))


def service_day(df: DataFrame) -> DataFrame:
    """Cost, usage and rows per service and day."""
    return (df.groupBy(*_keys(), F.col(B.PRODUCT).alias("service"),
                       usage_date().alias("usage_date"))
            .agg(F.sum(C.amortized()).alias("amortized_cost"),
                 F.sum(B.AMOUNT).alias("usage_amount"), F.count("*").alias("row_count")))


def commitment_month(df: DataFrame) -> DataFrame:
    """Commitment measures per commitment and month."""
    keyed = df.withColumn("month_date", month_start())
    return K.commitment_groups(keyed, None, MONTH_KEYS)


#: Bits of the sketches' size: 4096 registers, a relative error of 1.6 % (two thirds of cases); exact for few values.
SKETCH_BITS = 12


def reconcile_month(df: DataFrame) -> DataFrame:
    """The totals of ``reconcile`` per month, with mergeable sketches in the place of its distinct counts."""
    return (df.groupBy(*_keys())
            .agg(F.sum(C.CASH).alias("cash"), F.sum(C.amortized()).alias("accrued"),
                 C.sum_except(C.AMORTIZED, *S.NON_CONSUMPTION).alias("consumed"),
                 C.sum_for(C.CASH, *S.GROSS_USAGE).alias("gross"), F.count("*").alias("line_items"),
                 F.hll_sketch_agg(B.PRODUCT, SKETCH_BITS).alias("products"),
                 F.hll_sketch_agg(B.ACCOUNT, SKETCH_BITS).alias("accounts"),
                 F.hll_sketch_agg(B.RESOURCE, SKETCH_BITS).alias("resources")))


ROLLUPS = {"reconcile_month": reconcile_month, "service_month": service_month, "resource_month": resource_month,
           "service_day": service_day, "commitment_month": commitment_month}
SORT_KEYS = {"reconcile_month": [], "service_month": ["service"], "resource_month": ["service", "usage_account_id"],
             "service_day": ["service", "usage_date"], "commitment_month": ["commitment_id"]}


def _store(spark: SparkSession, folder: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _files(spark: SparkSession, folder: str) -> set[str]:
    """Names of the files in a folder, none if there is no such folder."""
    store, place = _store(spark, folder)
    if not store.exists(place):
        return set()
    return {f.getPath().getName() for f in store.listStatus(place)}


def refresh(df: DataFrame, name: str, root: str, period: Period | None = None) -> None:
    """Rebuild one rollup under ``root``, for the months of ``period`` or for all.

    Months that are not rebuilt stay as they are. A month of ``period`` that gives no rows any
    more loses its old ones, once the others are written.
    """
    rows = df if period is None else df.where(period.partitions())
    folders = [] if period is None else period.paths(root)
    before = {f: _files(df.sparkSession, f) for f in folders}
    write_partitioned(ROLLUPS[name](rows), root, SORT_KEYS[name])
    for folder, files in before.items():
        if files and _files(df.sparkSession, folder) == files:      # nothing was written there
            _store(df.sparkSession, folder)[0].delete(_store(df.sparkSession, folder)[1], True)


def _sum_back(rollup: DataFrame, period: Period, keys: list[str], sums: list[str]) -> DataFrame:
    inside = rollup.where(period.partitions() & period.instants(rollup, "month_date"))
    return inside.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def mom_trend_from(rollup: DataFrame, period: Period) -> DataFrame:
    """``mom_trend`` answered from ``service_month``."""
    return T.trend_of(_sum_back(rollup, period, ["month_date", "service"], ["amortized_cost"]))


def cost_by_resource_from(rollup: DataFrame, period: Period,
                          limit: int | None = 200) -> DataFrame:
    """``cost_by_resource`` answered from ``resource_month``."""
    groups = _sum_back(rollup, period, ["usage_account_id", "service", "resource_id"],
                       ["amortized_cost", "usage_amount", "line_items"])
    return B.rank_resources(groups, limit)


SKETCHES = ["products", "accounts", "resources"]


def _sketched(rollup: DataFrame, period: Period, *keys) -> DataFrame:
    inside = rollup.where(period.partitions() & period.instants(rollup, "month_date"))
    sums = [F.sum(c).alias(c) for c in ("cash", "accrued", "consumed", "gross", "line_items")]
    return inside.groupBy(*keys).agg(*sums, *[
        F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"distinct_{c}") for c in SKETCHES])


def reconcile_from(rollup: DataFrame, period: Period) -> DataFrame:
    """``reconcile`` answered from ``reconcile_month``; its distinct counts are estimates (see SKETCH_BITS)."""
    money = {"unblended_all_types": "cash", "amortized_all_types": "accrued", "amortized_usage_only": "consumed",
             "gross_usage_only": "gross"}
    return (_sketched(rollup, period, "month_date")
            .select(month_label("month_date").alias("usage_month"),
                    *[C.money(F.col(c)).alias(n) for n, c in money.items()],
                    "line_items", "distinct_products", "distinct_accounts").orderBy("usage_month"))


def distinct_from(rollup: DataFrame, period: Period) -> DataFrame:
    """Estimated products, accounts and resources of all months of a period together, from a row a month."""
    return _sketched(rollup, period).select("line_items", *[f"distinct_{c}" for c in SKETCHES])


def refresh_changed(spark: SparkSession, source: str, name: str, root: str, **reading) -> list[tuple[int, int]]:
    """Rebuild one rollup for the months that were delivered, delivered anew or taken away since the last time.

    What lay there then is kept beside the rollup, a row per month. Only changed months are read. The
    record is written last, so that a run that fails is made up for by the next one. Returns the months.
    """
    listed = deliveries(spark, source).drop("newest_file")
    # A row a month; one look, so that what arrives meanwhile counts as changed the next time.
    now = spark.createDataFrame(listed.collect(), listed.schema)
    seen = f"{root.rstrip('/')}/_seen"
    known = _store(spark, seen)[0].exists(_store(spark, f"{seen}/_SUCCESS")[1])
    before = spark.read.schema(now.schema).parquet(seen) if known else now.limit(0)
    state = ["files", "bytes", "newest"]
    both = now.join(before.select("year", "month", *[F.col(c).alias(f"old_{c}") for c in state]),
                    ["year", "month"], "full_outer")
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    # Other folders than months are not looked at.
    proper = F.col("year").rlike("^[1-9][0-9]{3}$") & F.col("month").rlike("^(0[1-9]|1[0-2])$")
    months = sorted((int(r.year), int(r.month)) for r in both.where(~same & proper).select("year", "month").collect())
    if months:
        refresh(read_billing(spark, source, **reading), name, root, Period(tuple(months)))
        now.coalesce(1).write.mode("overwrite").parquet(seen)
    return months


def anomalies_from(rollup: DataFrame, period: Period, **thresholds) -> DataFrame:
    """``anomalies`` answered from ``service_day``."""
    daily = _sum_back(rollup, period, ["service", "usage_date"],
                      ["amortized_cost", "usage_amount", "row_count"])
    return T.anomalies_of(daily, **thresholds)


def commitment_utilisation_from(rollup: DataFrame, period: Period) -> DataFrame:
    """``commitment_utilisation`` answered from ``commitment_month``."""
    return K.utilisation_of(
        _sum_back(rollup, period, ["commitment_type", "commitment_id"], K.MEASURES))
