"""Sources, sinks and rollups: written once per session to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costweave.checks.contract import check_schema_drift
from costweave.functions import cost as C
from costweave.operators import breakdown as B, trend as T
from costweave.plans import rollups as R, versions as P, window_state as W
from costweave.registry.analysis import (_anomaly_sql, _daily_sql, _pruned_sql, _resource_sql,
                                         _reconcile_sql, _trend_sql, utilisation_sql)
from costweave.registry.entries import Entries
from costweave.registry.sqlbase import FULL, MONTH, STRADDLE, TWO_MONTHS, rows
from costweave.sources import billing_table as L, legacy_csv as V
from costweave.sources.period import Period
from costweave.sources.sample import lineitem_billing, lineitem_placed, lineitem_rows, lineitem_widened
from costweave.sources.scratch import scratch_path

BEFORE_MARCH = Period.span(FULL.months[0], W.before(MONTH.months[0]))
COST = "line_item_unblended_cost"
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf: str, name: str, write) -> str:
    """Path of a table written at most once per application and source directory."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def lake(spark: SparkSession, sf: str) -> str:
    """The sample billing rows as a month-partitioned table."""
    return _written(spark, sf, "billing",
                    lambda path: L.write_billing(lineitem_placed(spark, sf), path, lineitem_widened))


def whole(spark: SparkSession, sf: str) -> DataFrame:
    return L.read_billing(spark, lake(spark, sf), ntz=True)


def months(period):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return L.read_months(spark, lake(spark, sf), period, ntz=True)
    return run


def rollup(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = _written(spark, sf, name, lambda p: R.refresh(whole(spark, sf), name, p))
    schema = R.ROLLUPS[name](whole(spark, sf)).schema
    return spark.read.schema(schema).parquet(path)


def redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """A rollup after a month was delivered again with twice its rows, which nobody named."""
    def write(path: str) -> None:
        source, root = f"{path}/billing", f"{path}/service_month"
        rows_ = lineitem_placed(spark, sf)
        L.write_billing(rows_, source, lineitem_widened)
        R.refresh_changed(spark, source, "service_month", root, ntz=True)
        march = MONTH.scope(rows_)
        L.write_billing(march.unionByName(march), source, lineitem_widened)
        changed = R.refresh_changed(spark, source, "service_month", root, ntz=True)
        if changed != list(MONTH.months) or R.refresh_changed(spark, source, "service_month", root, ntz=True):
            raise AssertionError(f"months taken for changed: {changed}")

    path = _written(spark, sf, "redelivered", write)
    schema = R.service_month(whole(spark, sf)).schema
    return spark.read.schema(schema).parquet(f"{path}/service_month")


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a rollup: the first as delivered, the second after March came with twice its rows."""
    def write(path: str) -> None:
        bills = whole(spark, sf)
        P.publish(bills, "service_month", path)
        P.publish(bills.unionByName(bills), "service_month", path, MONTH)

    path = _written(spark, sf, "published", write)
    schema = R.service_month(whole(spark, sf)).schema
    first, second = (P.published(spark, path, schema, v).withColumn("version", F.lit(v)) for v in (1, 2))
    return first.unionByName(second)


def next_month(spark: SparkSession, sf: str, **windows) -> DataFrame:
    """Anomalies of March from the state at the end of February, not from the days before."""
    days = rollup(spark, sf, "service_day")
    root = scratch_path(spark, "state")
    W.start(days, root, BEFORE_MARCH, **windows)
    return W.anomalies_next(days, root, MONTH.months[0], **windows)


def drifted(spark: SparkSession, sf: str) -> DataFrame:
    """Schema findings over a table whose March has its cost as text and no team tag."""
    def write(path: str) -> None:
        rows_ = lineitem_placed(spark, sf)
        L.write_billing(rows_, path, lineitem_widened)
        L.write_billing(MONTH.scope(rows_), path, lambda placed: lineitem_widened(placed)
                        .withColumn(COST, F.col(COST).cast("string")).drop("resource_tags_user_team"))

    return check_schema_drift(spark, _written(spark, sf, "drifted", write))


def contract_read(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over the written table: partitions as text, absent columns as NULL."""
    return (whole(spark, sf).groupBy("year", "month")
            .agg(F.count("*").alias("line_items"), C.money(F.sum(C.cash())).alias("cash"),
                 F.count("bill_invoice_id").alias("invoices")))


def month_read(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per month when only two month folders are read."""
    return (months(STRADDLE)(spark, sf).groupBy("year", "month")
            .agg(F.count("*").alias("line_items")))


def widened_read(spark: SparkSession, sf: str) -> DataFrame:
    """Reading with optional column groups the report does not have."""
    wide = L.read_billing(spark, lake(spark, sf), ("net", "discount"),
                          {"cost_category_team": "string"}, ntz=True)
    wide = L.widen(wide, {"resource_tags_user_cost_center": "string"})
    return (wide.groupBy(F.col(B.PRODUCT).alias("service"))
            .agg(F.count("*").alias("line_items"),
                 F.count("line_item_net_unblended_cost").alias("net_values"),
                 F.count("cost_category_team").alias("categories"),
                 F.count("resource_tags_user_cost_center").alias("centers")))


# Column names as they stand in a delivered report, for the columns the conversion uses.
HEADERS = {
    "line_item_usage_start_date": "lineItem/UsageStartDate",
    "line_item_product_code": "lineItem/ProductCode",
    "line_item_unblended_cost": "lineItem/UnblendedCost",
    "line_item_usage_amount": "lineItem/UsageAmount",
    "reservation_reservation_a_r_n": "reservation/ReservationARN",
    "reservation_amortized_upfront_fee_for_billing_period":
        "reservation/AmortizedUpfrontFeeForBillingPeriod",
    "reservation_recurring_fee_for_usage": "reservation/RecurringFeeForUsage",
    "savings_plan_savings_plan_a_r_n": "savingsPlan/SavingsPlanARN",
    "resource_tags_user_team": "resourceTags/user:Team",
    "product_instance_type": "product/instanceType",
}


def delivery(spark: SparkSession, sf: str) -> DataFrame:
    """The sample rows as a delivered report: slash headers, all text, some values broken."""
    source = lineitem_rows(spark, sf)
    cols = []
    for name, header in HEADERS.items():
        if name == "line_item_usage_start_date":
            value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        else:
            value = F.col(name).cast("string")
        if name == "line_item_unblended_cost":
            value = F.when(F.col("line_item_usage_amount") == 13, "n/a").otherwise(value)
        cols.append(value.alias(header))
    return source.select(*cols)


def legacy_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Converted rows summed per month and service."""
    rows_ = V.from_legacy(delivery(spark, sf), ntz=True)
    return (rows_.groupBy("year", "month", F.col(B.PRODUCT).alias("service"))
            .agg(F.count("*").alias("line_items"), C.money(F.sum(C.cash())).alias("cash"),
                 C.money(F.sum(C.amortized())).alias("accrued"),
                 F.count("reservation_reservation_a_r_n").alias("reservations"),
                 F.count("resource_tags_user_team").alias("tagged"),
                 F.count("product_instance_type").alias("instances")))


def csv_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Two CSV deliveries with different headers, written, read back and converted.

    The second has its columns in another order and a tag that the first lacks.
    """
    root = scratch_path(spark, "csv")
    rows_ = delivery(spark, sf)
    early = F.col("`lineItem/UsageStartDate`") < "1997"
    cells = lambda names: [F.col(f"`{n}`") for n in names]
    write = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    write(rows_.where(early).select(*cells(rows_.columns)), "first")
    tagged = rows_.where(~early).withColumn("resourceTags/user:cost-center",
                                            F.concat(F.lit("cc-"), F.col("`resourceTags/user:Team`")))
    write(tagged.select(*cells(reversed(tagged.columns))), "second")
    read = V.from_legacy(V.read_legacy_csv(spark, root), ntz=True,
                         extra={"resource_tags_user_cost_center": "string"})
    return (read.groupBy("year", F.col(B.PRODUCT).alias("service"))
            .agg(F.count("*").alias("line_items"), C.money(F.sum(C.cash())).alias("cash"),
                 F.count("resource_tags_user_cost_center").alias("centers"),
                 F.count("product_instance_type").alias("instances")))


def map_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags delivered as a map, flattened to columns and reported as usual."""
    plain = lineitem_billing(spark, sf)
    mapped = plain.withColumn("resource_tags", F.map_filter(
        F.create_map(F.lit("Team"), F.col("resource_tags_user_team"),
                     F.lit("cost-center"), F.col("resource_tags_user_environment")),
        lambda k, v: v.isNotNull())).drop("resource_tags_user_team")
    flat = L.flatten_map(mapped, "resource_tags", ["Team", "cost-center"], "resource_tags_user_")
    return B.cost_by_team_env(flat, FULL, env_column="resource_tags_user_cost_center")


def register(e: Entries) -> None:
    e.add("source_contract_read", contract_read, rows() + """SELECT year, month,
 count(*) AS line_items, round(sum(cash), 2) AS cash, CAST(0 AS BIGINT) AS invoices
FROM b GROUP BY 1, 2""")
    e.add("source_month_read", month_read, rows() + """SELECT year, month,
 count(*) AS line_items FROM b WHERE mon IN ('1997-12', '1998-01') GROUP BY 1, 2""")
    e.add("source_widened_read", widened_read, rows() + """SELECT svc AS service,
 count(*) AS line_items, CAST(0 AS BIGINT) AS net_values, CAST(0 AS BIGINT) AS categories,
 CAST(0 AS BIGINT) AS centers FROM b GROUP BY 1""")
    e.add("source_pruned_query",
          lambda s, sf: B.cost_by_service_pruned(whole(s, sf), MONTH), _pruned_sql(MONTH))
    e.add("source_daily_series",
          lambda s, sf: T.daily_series(whole(s, sf), TWO_MONTHS, "AmazonEC2"),
          _daily_sql(rows(TWO_MONTHS), "AmazonEC2"))
    converted = """, c AS (SELECT *, CASE WHEN amount = 13 THEN NULL ELSE cash END AS money FROM b) """
    e.add("source_legacy_conversion", legacy_conversion, rows() + converted + """
SELECT year, month, svc AS service, count(*) AS line_items, round(sum(money), 2) AS cash,
 round(sum(coalesce(money, 0e0) + accrued - coalesce(cash, 0e0)), 2) AS accrued,
 count(reservation_reservation_a_r_n) AS reservations,
 count(nullif(resource_tags_user_team, '')) AS tagged,
 count(product_instance_type) AS instances FROM c GROUP BY 1, 2, 3""")
    e.add("source_legacy_csv", csv_delivery, rows() + converted + """
SELECT year, svc AS service, count(*) AS line_items, round(sum(money), 2) AS cash,
 count(resource_tags_user_team) FILTER (WHERE year >= '1997') AS centers,
 count(product_instance_type) AS instances FROM c GROUP BY 1, 2""")
    typed = {"line_item_usage_start_date": ("ts", "0"),
             "line_item_unblended_cost": ("coalesce(CASE WHEN amount = 13 THEN 0e0 END, cash)",
                                          "count(*) FILTER (WHERE amount = 13)"),
             "line_item_usage_amount": ("amount", "0"),
             "reservation_amortized_upfront_fee_for_billing_period":
                 ("reservation_amortized_upfront_fee_for_billing_period", "0"),
             "reservation_recurring_fee_for_usage": ("reservation_recurring_fee_for_usage", "0")}
    e.add("source_conversion_report",
          lambda s, sf: V.conversion_report(delivery(s, sf)),
          rows() + "\nUNION ALL ".join(
              f"SELECT '{n}' AS column_name, count({v}) AS filled,"
              f" CAST({bad} AS BIGINT) AS bad_values FROM b" for n, (v, bad) in typed.items()))
    e.add("source_map_tags", map_tags, rows(FULL) + """,
n AS (SELECT *, nullif(resource_tags_user_team, '') AS team,
 nullif(resource_tags_user_environment, '') AS env FROM b)
SELECT coalesce(team, '(no team)') AS team, coalesce(env, '(no env)') AS environment,
 CASE WHEN team IS NULL AND env IS NULL THEN 'unallocated' ELSE 'allocated' END
 AS allocated_vs_unallocated, round(sum(accrued), 2) AS amortized_cost,
 count(DISTINCT acct) AS accounts, count(*) AS line_items,
 round(100.0e0 * sum(accrued) / nullif((SELECT sum(accrued) FROM b), 0), 2)
 AS share_of_period_pct FROM n GROUP BY 1, 2, 3""")

    keys = "year, month, CAST(date_trunc('month', ts) AS DATE) AS month_date"
    e.add("rollup_service_month", lambda s, sf: rollup(s, sf, "service_month"),
          rows() + f"""SELECT {keys}, svc AS service, sum(accrued) AS amortized_cost,
 sum(cash) AS unblended_cost, count(*) AS line_items FROM b GROUP BY ALL""")
    e.add("rollup_resource_month", lambda s, sf: rollup(s, sf, "resource_month"),
          rows() + f"""SELECT {keys}, coalesce(acct, '(blank)') AS usage_account_id,
 svc AS service, coalesce(nullif(line_item_resource_id, ''), '(no resource id)') AS resource_id,
 sum(accrued) AS amortized_cost, sum(amount) AS usage_amount, count(*) AS line_items
FROM b GROUP BY ALL""")
    e.add("rollup_service_day", lambda s, sf: rollup(s, sf, "service_day"),
          rows() + f"""SELECT {keys}, svc AS service, day AS usage_date,
 sum(accrued) AS amortized_cost, sum(amount) AS usage_amount, count(*) AS row_count
FROM b GROUP BY ALL""")
    e.add("rollup_commitment_month",
          lambda s, sf: rollup(s, sf, "commitment_month").select(
              "year", "month", "commitment_type", "commitment_id", "fee_rows", "ri_unused",
              "sp_used", "ri_effective", "sp_list"),
          rows() + """SELECT year, month,
 CASE WHEN kind IN ('RIFee', 'DiscountedUsage') THEN 'ReservedInstance' ELSE 'SavingsPlan' END
 AS commitment_type, coalesce(CASE WHEN kind IN ('RIFee', 'DiscountedUsage')
 THEN reservation_reservation_a_r_n ELSE savings_plan_savings_plan_a_r_n END,
 '(no ARN on row)') AS commitment_id,
 count(*) FILTER (WHERE kind IN ('RIFee', 'SavingsPlanRecurringFee')) AS fee_rows,
 sum(coalesce(reservation_unused_recurring_fee, 0e0)
  + coalesce(reservation_unused_amortized_upfront_fee_for_billing_period, 0e0))
  FILTER (WHERE kind = 'RIFee') AS ri_unused,
 sum(coalesce(savings_plan_used_commitment, 0e0))
  FILTER (WHERE kind = 'SavingsPlanRecurringFee') AS sp_used,
 sum(reservation_effective_cost) FILTER (WHERE kind = 'DiscountedUsage') AS ri_effective,
 sum(listed) FILTER (WHERE kind = 'SavingsPlanCoveredUsage') AS sp_list
FROM b WHERE kind IN ('RIFee', 'DiscountedUsage', 'SavingsPlanRecurringFee',
 'SavingsPlanCoveredUsage') GROUP BY ALL""")
    e.add("rollup_refresh_changed", redelivered,
          rows() + f"""SELECT {keys}, svc AS service, sum(accrued * n) AS amortized_cost,
 sum(cash * n) AS unblended_cost, CAST(sum(n) AS BIGINT) AS line_items
FROM (SELECT *, CASE WHEN mon = '1998-03' THEN 2 ELSE 1 END AS n FROM b) GROUP BY ALL""")
    e.add("rollup_published", published,
          rows() + f"""SELECT version, {keys}, svc AS service, sum(accrued * n) AS amortized_cost,
 sum(cash * n) AS unblended_cost, CAST(sum(n) AS BIGINT) AS line_items
FROM (SELECT *, CASE WHEN mon = '1998-03' AND version = 2 THEN 2 ELSE 1 END AS n
 FROM b, (VALUES (1), (2)) t (version)) GROUP BY ALL""")
    e.add("check_schema_drift", drifted, rows() + """, m AS (SELECT DISTINCT mon FROM b),
f (mon, severity, name, text) AS (VALUES
 ('1998-03', 'error', 'line_item_unblended_cost', 'double became string'),
 ('1998-03', 'error', 'resource_tags_user_team', 'vanished, was string'),
 ('1998-04', 'error', 'line_item_unblended_cost', 'string became double'),
 ('1998-04', 'warning', 'resource_tags_user_team', 'new, string'))
SELECT 'schema_drift' AS check_id, coalesce(severity, 'error') AS severity, text IS NULL AS ok,
 concat_ws(' ', m.mon, name) AS subject, CASE m.mon WHEN '1998-03' THEN 33e0 ELSE 34e0 END AS observed,
 coalesce(text, 'as before') AS detail FROM m LEFT JOIN f ON m.mon = f.mon""")
    e.add("rollup_reconcile",
          lambda s, sf: R.reconcile_from(rollup(s, sf, "reconcile_month"), FULL), _reconcile_sql(FULL))
    e.add("rollup_distinct_months",
          lambda s, sf: R.distinct_from(rollup(s, sf, "reconcile_month"), TWO_MONTHS).select(
              "line_items", "distinct_products", "distinct_accounts"),
          rows(TWO_MONTHS) + """SELECT count(*) AS line_items, count(DISTINCT svc) AS distinct_products,
 count(DISTINCT acct) AS distinct_accounts FROM b""")
    e.add("rollup_mom_trend",
          lambda s, sf: R.mom_trend_from(rollup(s, sf, "service_month"), FULL), _trend_sql(FULL))
    e.add("rollup_cost_by_resource",
          lambda s, sf: R.cost_by_resource_from(rollup(s, sf, "resource_month"), FULL),
          _resource_sql(FULL))
    e.add("rollup_anomalies",
          lambda s, sf: R.anomalies_from(rollup(s, sf, "service_day"), FULL),
          _anomaly_sql(rows(FULL)))
    march = "SELECT * FROM ({}) a WHERE strftime(usage_date, '%Y-%m') = '1998-03'"
    e.add("anomalies_next_month", next_month, march.format(_anomaly_sql(rows(FULL))))
    e.add("anomalies_next_month_weekdays",
          lambda s, sf: next_month(s, sf, window_days=28, same_weekday_rows=4),
          march.format(_anomaly_sql(rows(FULL), 28, weekday=4)))
    e.add("rollup_commitment_utilisation",
          lambda s, sf: R.commitment_utilisation_from(rollup(s, sf, "commitment_month"), FULL),
          utilisation_sql(FULL))
