"""Billing rows and query texts derived from the sample star-schema tables.

Every mapping is a list of (name, expression) whose SQL runs unchanged in Spark and in the
SQL engine the results are checked with. ``{ntz}`` stands for the zone-less timestamp type,
which the two engines spell differently. Costs are whole units so that sums are exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from costweave.sources.billing_table import conform

LINEITEM_T = "(l_partkey * 3 + l_suppkey * 7 + l_linenumber) % 40"
_COST = "CAST(floor(l_extendedprice) AS DOUBLE)"

LINEITEM_MAP = [
    ("line_item_usage_start_date", "l_shipdate"),
    ("year", "CAST(year(l_shipdate) AS STRING)"),
    ("month", "lpad(CAST(month(l_shipdate) AS STRING), 2, '0')"),
    ("line_item_usage_account_id",
     "CASE WHEN l_suppkey % 11 = 0 THEN NULL"
     " ELSE '10000000000' || CAST(l_suppkey % 7 AS STRING) END"),
    ("line_item_product_code",
     "CASE WHEN t = 37 AND l_linenumber % 2 = 0 THEN NULL ELSE CASE l_partkey % 5"
     " WHEN 0 THEN 'AmazonEC2' WHEN 1 THEN 'AmazonS3' WHEN 2 THEN 'AmazonRDS'"
     " WHEN 3 THEN 'AWSLambda' ELSE 'AmazonCloudFront' END END"),
    ("line_item_line_item_type",
     "CASE WHEN t < 20 THEN 'Usage' WHEN t < 24 THEN 'DiscountedUsage'"
     " WHEN t < 28 THEN 'SavingsPlanCoveredUsage' WHEN t < 32 THEN 'SavingsPlanNegation'"
     " WHEN t < 34 THEN 'RIFee' WHEN t < 36 THEN 'SavingsPlanRecurringFee'"
     " WHEN t = 36 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Fee'"
     " ELSE 'SavingsPlanUpfrontFee' END"
     " WHEN t = 37 THEN 'Tax'"
     " WHEN t = 38 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Credit' ELSE 'Refund' END"
     " ELSE CASE l_linenumber % 3 WHEN 0 THEN 'Discount' WHEN 1 THEN 'BundledDiscount'"
     " ELSE NULL END END"),
    ("line_item_usage_type",
     "CASE l_linenumber WHEN 1 THEN 'BoxUsage:m5.xlarge' WHEN 2 THEN 'NatGateway-Bytes'"
     " WHEN 3 THEN 'TimedStorage-ByteHrs' WHEN 4 THEN 'Requests-Tier1'"
     " WHEN 5 THEN 'DataTransfer-Out-Bytes' WHEN 6 THEN 'EarlyDelete-GLACIER'"
     " ELSE 'Select-Returned-Bytes' END"),
    ("line_item_resource_id",
     "CASE WHEN t >= 28 OR l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''"
     " ELSE 'r-' || CAST(l_partkey % 300 AS STRING) END"),
    ("line_item_usage_amount", "l_quantity"),
    ("line_item_unblended_cost",
     f"CASE WHEN t BETWEEN 20 AND 23 THEN 0.0e0 WHEN t BETWEEN 28 AND 31 OR t >= 38 THEN -{_COST}"
     f" WHEN t = 35 THEN NULL ELSE {_COST} END"),
    ("pricing_public_on_demand_cost", f"CASE WHEN t < 28 THEN {_COST} END"),
    ("reservation_amortized_upfront_fee_for_billing_period",
     "CASE WHEN t IN (32,33) THEN l_quantity * 4.0e0 END"),
    ("reservation_unused_amortized_upfront_fee_for_billing_period",
     "CASE WHEN t IN (32,33) THEN l_quantity * 0.25e0 END"),
    ("reservation_unused_recurring_fee", "CASE WHEN t IN (32,33) THEN l_quantity * 0.5e0 END"),
    ("reservation_unused_quantity", "CASE WHEN t IN (32,33) THEN l_quantity END"),
    ("reservation_recurring_fee_for_usage",
     "CASE WHEN t BETWEEN 20 AND 23 OR t = 32 THEN l_quantity * 2.0e0 END"),
    ("reservation_effective_cost", "CASE WHEN t BETWEEN 20 AND 23 THEN l_quantity * 6.0e0 END"),
    ("reservation_reservation_a_r_n",
     "CASE WHEN t BETWEEN 20 AND 23 OR t IN (32,33) THEN CASE WHEN l_suppkey % 13 = 0 THEN NULL"
     " ELSE 'ri-' || CAST(l_suppkey % 5 AS STRING) END END"),
    ("savings_plan_amortized_upfront_commitment_for_billing_period",
     "CASE WHEN t IN (34,35) THEN l_quantity * 3.0e0 END"),
    ("savings_plan_recurring_commitment_for_billing_period",
     "CASE WHEN t IN (34,35) THEN l_quantity * 5.0e0 END"),
    ("savings_plan_used_commitment", "CASE WHEN t IN (34,35) THEN l_quantity * 7.0e0 END"),
    ("savings_plan_savings_plan_effective_cost",
     "CASE WHEN t BETWEEN 24 AND 27 THEN l_quantity * 8.0e0 END"),
    ("savings_plan_savings_plan_a_r_n",
     "CASE WHEN t BETWEEN 24 AND 31 OR t IN (34,35) THEN CASE WHEN l_suppkey % 13 = 0 THEN NULL"
     " ELSE 'sp-' || CAST(l_suppkey % 3 AS STRING) END END"),
    ("product_from_location",
     "CASE WHEN l_linenumber IN (2,5) THEN 'US East (N. Virginia)' WHEN l_linenumber = 7"
     " THEN '' END"),
    ("product_to_location",
     "CASE WHEN l_linenumber = 5 THEN 'External' WHEN l_linenumber = 2 THEN '' END"),
    ("product_from_location_type", "CASE WHEN l_linenumber IN (2,5) THEN 'AWS Region' END"),
    ("product_to_location_type", "CASE WHEN l_linenumber = 5 THEN 'Other' END"),
    ("product_storage_class",
     "CASE WHEN l_linenumber = 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 'STANDARD'"
     " ELSE 'STANDARD_IA' END WHEN l_linenumber = 4 THEN '' END"),
    ("resource_tags_user_team",
     "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'core' WHEN 3 THEN 'data'"
     " WHEN 4 THEN 'Prod' ELSE 'prod' END"),
    ("resource_tags_user_environment",
     "CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'prod' ELSE 'dev' END"),
    # Columns beyond the base mapping, for checks and variants.
    ("identity_line_item_id", "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"),
    ("line_item_currency_code", "CASE WHEN l_suppkey % 97 = 0 THEN 'EUR' ELSE 'USD' END"),
    ("line_item_blended_cost", f"CASE WHEN t < 39 THEN {_COST} * 0.5e0 END"),
    ("bill_billing_period_start_date",
     "CAST(date_trunc('month', l_shipdate - INTERVAL '3' DAY) AS {ntz})"),
    ("product_instance_type", "CASE WHEN l_linenumber < 4 THEN 'm5.xlarge' ELSE 'c5.large' END"),
    ("reservation_amortized_upfront_cost_for_usage",
     "CASE WHEN t BETWEEN 20 AND 23 THEN l_quantity * 4.0e0 END"),
]

EVENT_MAP = [
    ("line_item_usage_start_date", "ts"),
    ("year", "CAST(year(ts) AS STRING)"),
    ("month", "lpad(CAST(month(ts) AS STRING), 2, '0')"),
    ("line_item_usage_account_id", "CAST(user_id % 9 AS STRING)"),
    ("line_item_product_code", "event_type"),
    ("line_item_line_item_type", "'Usage'"),
    ("line_item_usage_amount", "CAST(floor(value) AS DOUBLE)"),
    ("line_item_unblended_cost", "CAST(floor(value * 3.0e0) AS DOUBLE)"),
]

# A query history: one text per order, mixing clean texts with every kind of mistake.
_Q = "chr(39)"
_NL = "chr(10)"
QUERY_LOG_TEXT = f"""
CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE
  '-- QUESTION: what did each service cost' || {_NL} ||
  CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE '-- WHAT IT RETURNS: one row per service' || {_NL} END ||
  CASE WHEN o_orderkey % 5 = 2 THEN '' ELSE '-- BYTES SCANNED: one month' || {_NL} END ||
  '-- TABLE / PARTITION ASSUMPTIONS: year and month, isn' || {_Q} || 't SELECT * from billing'
  || {_NL} || '-- CAVEATS: cash only' || {_NL} END ||
CASE WHEN o_orderkey % 11 = 0 THEN 'WITH m AS (SELECT line_item_product_code AS service FROM lake.billing'
  || ' WHERE year = ' || {_Q} || '1998' || {_Q} || ') ' ELSE '' END ||
'SELECT ' || CASE o_orderkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'b.*' WHEN 2 THEN 'line_item_made_up_' ||
  lower(o_orderstatus) || ' AS x, count(*) AS n' WHEN 3 THEN 'DISTINCT ' || chr(96) ||
  'line_item_product_code' || chr(96) WHEN 4 THEN '2 * b.line_item_unblended_cost AS cost' WHEN 5 THEN
  'line_item_usage_account_id, round(sum(line_item_unblended_cost), 2) AS total' ELSE
  'line_item_product_code AS service, sum(line_item_unblended_cost * 1e0) AS cost' END || {_NL} ||
'FROM ' || CASE WHEN o_orderkey % 3 = 0 THEN 'lake.billing b' WHEN o_orderkey % 3 = 1 THEN 'billing AS b'
  ELSE 'lake.other_table b' END || {_NL} ||
CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'WHERE year = ' || {_Q} ||
  CAST(year(o_orderdate) AS STRING) || {_Q} || ' AND month = ' || {_Q} || '03' || {_Q}
  WHEN 2 THEN 'WHERE b.year = ' || {_Q} || '1998' || {_Q}
  WHEN 3 THEN 'WHERE year = ' || {_Q} || '1998' || {_Q} || ' AND (cast(month AS int) = 3)'
  WHEN 4 THEN 'WHERE date_format(b.line_item_usage_start_date, ' || {_Q} || 'yyyy-MM' || {_Q} || ') = ' ||
  {_Q} || '1998-03' || {_Q} ELSE 'WHERE year IN (' || {_Q} || 'REPLACE_ME_YYYY' || {_Q} ||
  ') AND month BETWEEN ' || {_Q} || '<MONTH>' || {_Q} || ' AND ' || {_Q} || '03' || {_Q} END || {_NL} ||
'/* owner ' || o_orderpriority || ' */' || {_NL} || 'LIMIT ' || CAST(o_custkey AS STRING)
"""


# The sample tables' own columns, stated so that reading them needs no look at the files.
LINEITEM_SCHEMA = ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
                   " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
                   " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ")
EVENT_SCHEMA = ("event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,"
                " value DOUBLE, props STRING")
ORDER_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
                " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


def _select(frame: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    return frame.selectExpr(*[f"{sql.replace('{ntz}', 'TIMESTAMP_NTZ')} AS {name}"
                              for name, sql in mapping])


#: The mapped columns by which billing rows are told apart, dealt out and sorted.
PLACED = ("line_item_usage_start_date", "year", "month", "line_item_product_code")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{sf_dir}/lineitem.parquet")
    return lines.selectExpr("*", f"{LINEITEM_T} AS t")


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing rows with only the mapped columns."""
    return _select(_lines(spark, sf_dir), LINEITEM_MAP)


def lineitem_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's own columns beside those of PLACED: what ``lineitem_widened`` makes ``lineitem_rows`` of."""
    used = [c for c in _lines(spark, sf_dir).columns if any(re.search(rf"\b{c}\b", sql) for _, sql in LINEITEM_MAP)]
    return _select(_lines(spark, sf_dir), [(c, c) for c in used] + [m for m in LINEITEM_MAP if m[0] in PLACED])


def lineitem_widened(placed: DataFrame) -> DataFrame:
    """The rows of ``lineitem_rows``, made of those of ``lineitem_placed`` wherever they lie by then."""
    return _select(placed, [(n, n if n in PLACED else sql) for n, sql in LINEITEM_MAP])


def lineitem_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing rows under the full contract; unmapped columns are NULL and cost nothing."""
    return conform(lineitem_rows(spark, sf_dir))


def event_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday billing rows out of the event stream."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return conform(_select(events, EVENT_MAP))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query history (query_id, sql_text) with one text per order."""
    orders = spark.read.schema(ORDER_SCHEMA).parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr("o_orderkey AS query_id", f"{QUERY_LOG_TEXT} AS sql_text")
