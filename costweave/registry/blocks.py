"""Relational building blocks of the operators, each as a small query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from costweave import schema as S
from costweave.functions import cost as C
from costweave.functions.calendar import month_label, month_start
from costweave.operators import breakdown as B, trend as T
from costweave.plans.spine import left_join_spine
from costweave.plans.totals import totals_struct, with_share
from costweave.registry.entries import Entries
from costweave.registry.sqlbase import FULL, TWO_MONTHS, rows
from costweave.sources.period import Period
from costweave.sources.sample import lineitem_billing

FEB, MAR = (1998, 2), (1998, 3)


def threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    """OR of thresholds on window outputs; a NULL branch does not keep a row."""
    base = T.baselined(T.daily_cost(lineitem_billing(spark, sf), FULL))
    off = F.col("amortized_cost") - F.col("mean")
    return (base.where((F.abs(off / F.nullif(F.col("sd"), F.lit(0.0))) >= 3)
                       | (F.abs(off) >= 1000000.0))
            .select("service", "usage_date", C.money(off).alias("deviation")))


def having(spark: SparkSession, sf: str) -> DataFrame:
    """Filter on an aggregate."""
    return (FULL.scope(lineitem_billing(spark, sf))
            .groupBy(F.col(B.PRODUCT).alias("service"), F.col(T.USAGE_TYPE).alias("usage_type"))
            .agg(F.sum(C.list_cost()).alias("listed"))
            .where(F.col("listed") > 30000000.0)
            .select("service", "usage_type", C.money(F.col("listed")).alias("list_cost")))


def full_outer(null_safe: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return T.joined_drivers(lineitem_billing(spark, sf), FEB, MAR, null_safe)
    return run


def one_row_total(spark: SparkSession, sf: str) -> DataFrame:
    """A one-row aggregate beside every row, as a scalar subquery instead of a cross join."""
    groups = (lineitem_billing(spark, sf).groupBy(F.col(C.TYPE).alias("line_item_type"))
              .agg(F.sum(C.cash()).alias("cash"), F.count("*").alias("n")))
    totals = totals_struct(groups, ["cash", "n"])
    return groups.select("line_item_type", C.money(F.col("cash")).alias("unblended_cost"),
                         C.money(totals["cash"]).alias("total_cost"),
                         totals["n"].alias("total_rows"))


def _per_day(spark: SparkSession, sf: str) -> DataFrame:
    """Cost per day of all products."""
    return (T.daily_cost(lineitem_billing(spark, sf), FULL).groupBy("usage_date")
            .agg(F.sum("amortized_cost").alias("amortized_cost")))


def spine_join(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar spine LEFT JOIN a daily series; absent days show NULL."""
    daily = _per_day(spark, sf).select("usage_date", C.money(F.col("amortized_cost")).alias("amortized_cost"))
    return left_join_spine(daily, "usage_date", FULL.first_instant.date(), FULL.last_day.date(),
                           "day")


def conditional_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sums under a condition; NULL where nothing matches."""
    return (FULL.scope(lineitem_billing(spark, sf))
            .groupBy(F.col(T.USAGE_TYPE).alias("usage_type"), F.col(B.PRODUCT).alias("service"))
            .agg(C.money(C.sum_for(C.CASH, S.TAX)).alias("tax"),
                 C.money(C.sum_for(C.CASH, S.CREDIT, S.REFUND)).alias("given_back"),
                 C.money(C.sum_except(C.CASH, *S.NON_CONSUMPTION)).alias("consumed")))


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Two exact distinct counts in one result, over pre-aggregated key pairs."""
    pairs = (FULL.scope(lineitem_billing(spark, sf))
             .groupBy(F.col(C.TYPE).alias("line_item_type"), B.ACCOUNT, B.PRODUCT)
             .agg(F.count("*").alias("n")))
    return (pairs.groupBy("line_item_type")
            .agg(F.countDistinct(B.ACCOUNT).alias("accounts"),
                 F.countDistinct(B.PRODUCT).alias("products"), F.sum("n").alias("line_items")))


def total_row(spark: SparkSession, sf: str) -> DataFrame:
    """Detail rows and a total row with typed NULLs, from one scan: the total is a grouping set over the detail."""
    detail = (FULL.scope(lineitem_billing(spark, sf))
              .groupBy(F.col(B.PRODUCT).alias("service"))
              .agg(F.sum(C.cash()).alias("cash"), F.max(T.USAGE_TYPE).alias("last_type")))
    both = detail.rollup("service").agg(F.sum("cash").alias("cash"), F.max("last_type").alias("last_type"),
                                        F.grouping("service").alias("total"))
    return both.select(F.when(F.col("total") == 1, "(TOTAL)").otherwise(F.col("service")).alias("service"),
                       C.money(F.col("cash")).alias("cash"),
                       F.when(F.col("total") == 0, F.col("last_type")).alias("last_type"))


def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the grand total without a global window."""
    groups = (FULL.scope(lineitem_billing(spark, sf))
              .groupBy(F.col(T.USAGE_TYPE).alias("usage_type"))
              .agg(F.sum(C.amortized()).alias("v")))
    return with_share(groups, "v", ["v"], "share_pct", 4).select(
        "usage_type", C.money(F.col("v")).alias("amortized_cost"), "share_pct")


def lag_row(spark: SparkSession, sf: str) -> DataFrame:
    """The previous row of each series, whatever the gap."""
    monthly = T.monthly_cost(lineitem_billing(spark, sf), FULL)
    prev = F.lag("amortized_cost").over(Window.partitionBy("service").orderBy("month_date"))
    return monthly.select("service", month_label("month_date").alias("usage_month"),
                          C.money(prev).alias("prev_month_cost"))


def month_subtotal(spark: SparkSession, sf: str) -> DataFrame:
    """A subtotal beside each row of its month."""
    monthly = T.monthly_cost(lineitem_billing(spark, sf), FULL)
    total = F.sum("amortized_cost").over(Window.partitionBy("month_date"))
    return monthly.select("service", month_label("month_date").alias("usage_month"),
                          C.money(total).alias("month_total"))


def trailing_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the seven rows before; NULL on the first."""
    daily = T.daily_cost(lineitem_billing(spark, sf), FULL)
    return daily.select("service", "usage_date", C.money(F.avg("amortized_cost").over(T.trailing(7)))
                        .alias("trailing_mean"))


def named_window(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, sample deviation and count over one per-service frame."""
    base = T.baselined(T.daily_cost(lineitem_billing(spark, sf), FULL))
    return base.select("service", "usage_date", C.money(F.col("mean")).alias("mean"),
                       C.money(F.col("sd")).alias("sd"), "baseline_days")


def top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 biggest (resource, month) pairs with a full tie-break."""
    return (FULL.scope(lineitem_billing(spark, sf))
            .groupBy(C.label_blank(B.RESOURCE, "(no resource id)").alias("resource_id"),
                     month_start().alias("month_date"))
            .agg(C.money(F.sum(C.amortized())).alias("amortized_cost"))
            .select("resource_id", month_label("month_date").alias("usage_month"),
                    "amortized_cost")
            .orderBy(F.desc_nulls_last("amortized_cost"), "resource_id", "usage_month")
            .limit(50))


def partition_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Equality, IN and month pairs on the partition columns, over a year straddle."""
    period = Period(((1996, 12), (1997, 1), (1997, 2), (1998, 6)))
    return (lineitem_billing(spark, sf).where(period.partitions()).groupBy("year", "month")
            .agg(F.count("*").alias("line_items")))


def register(e: Entries) -> None:
    everything = rows(FULL)
    daily = ", daily AS (SELECT svc, day, sum(accrued) AS v FROM b GROUP BY 1, 2)"
    frame = ("(PARTITION BY svc ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
    stats = (f", w AS (SELECT *, avg(v) OVER t AS m, stddev_samp(v) OVER t AS sd,"
             f" count(*) OVER t AS n FROM daily WINDOW t AS {frame})")
    monthly = ", monthly AS (SELECT svc, mon, sum(accrued) AS v FROM b GROUP BY 1, 2)"
    e.add("block_threshold_filter", threshold_filter, everything + daily + stats + """
SELECT svc AS service, day AS usage_date, round(v - m, 2) AS deviation FROM w
WHERE abs((v - m) / nullif(sd, 0)) >= 3 OR abs(v - m) >= 1000000""")
    e.add("block_having", having, everything + """SELECT svc AS service, utype AS usage_type,
 round(sum(listed), 2) AS list_cost FROM b GROUP BY 1, 2 HAVING sum(listed) > 30000000""")
    for name, null_safe, equal in [("block_full_outer", False, "="),
                                   ("block_full_outer_null_safe", True,
                                    "IS NOT DISTINCT FROM")]:
        def part(m: str) -> str:
            return ("(SELECT coalesce(acct, '(blank)') AS a, svc AS s, utype AS u,"
                    f" sum(accrued) AS v FROM b WHERE mon = '{m}' GROUP BY ALL)")
        e.add(name, full_outer(null_safe), rows(TWO_MONTHS) + f"""
SELECT coalesce(c.a, p.a) AS usage_account_id, coalesce(c.s, p.s) AS service,
 coalesce(c.u, p.u) AS usage_type, coalesce(p.v, 0e0) AS prev_cost, coalesce(c.v, 0e0) AS curr_cost
FROM {part('1998-03')} c FULL JOIN {part('1998-02')} p
 ON c.a {equal} p.a AND c.s {equal} p.s AND c.u {equal} p.u""")
    e.add("block_one_row_total", one_row_total, rows() + """SELECT kind AS line_item_type,
 round(sum(cash), 2) AS unblended_cost, round((SELECT sum(cash) FROM b), 2) AS total_cost,
 (SELECT count(*) FROM b) AS total_rows FROM b GROUP BY 1""")
    e.add("block_spine_left_join", spine_join, everything + """SELECT CAST(g.d AS DATE)
 AS usage_date, round(sum(accrued), 2) AS amortized_cost
FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31',
 INTERVAL 1 DAY)) AS d) g LEFT JOIN b ON b.day = CAST(g.d AS DATE)
GROUP BY 1""")
    e.add("block_conditional_sum", conditional_sum, everything + """SELECT utype AS usage_type,
 svc AS service, round(sum(cash) FILTER (WHERE kind = 'Tax'), 2) AS tax,
 round(sum(cash) FILTER (WHERE kind IN ('Credit', 'Refund')), 2) AS given_back,
 round(sum(cash) FILTER (WHERE kind NOT IN ('Tax', 'Credit', 'Refund', 'Discount',
 'BundledDiscount')), 2) AS consumed FROM b GROUP BY 1, 2""")
    e.add("block_distinct_counts", distinct_counts, everything + """SELECT kind AS line_item_type,
 count(DISTINCT acct) AS accounts, count(DISTINCT svc) AS products, count(*) AS line_items
FROM b GROUP BY 1""")
    e.add("block_total_row", total_row, everything + """SELECT svc AS service,
 round(sum(cash), 2) AS cash, max(utype) AS last_type FROM b GROUP BY 1
UNION ALL SELECT '(TOTAL)', round(sum(cash), 2), NULL FROM b""")
    e.add("block_share_of_total", share_of_total, everything + """SELECT utype AS usage_type,
 round(sum(accrued), 2) AS amortized_cost,
 round(100.0e0 * sum(accrued) / nullif(sum(sum(accrued)) OVER (), 0), 4) AS share_pct
FROM b GROUP BY utype""")
    e.add("block_lag", lag_row, everything + monthly + """ SELECT svc AS service,
 mon AS usage_month, round(lag(v) OVER (PARTITION BY svc ORDER BY mon), 2) AS prev_month_cost
FROM monthly""")
    e.add("block_month_subtotal", month_subtotal, everything + monthly + """ SELECT svc AS service,
 mon AS usage_month, round(sum(v) OVER (PARTITION BY mon), 2) AS month_total FROM monthly""")
    e.add("block_trailing_mean", trailing_mean, everything + daily + f""" SELECT svc AS service, day AS usage_date,
 round(avg(v) OVER {frame}, 2) AS trailing_mean FROM daily""")
    e.add("block_named_window", named_window, everything + daily + stats + """
SELECT svc AS service, day AS usage_date, round(m, 2) AS mean, round(sd, 2) AS sd,
 n AS baseline_days FROM w""")
    e.add("block_top_k", top_k, everything + """SELECT
 coalesce(nullif(line_item_resource_id, ''), '(no resource id)') AS resource_id,
 mon AS usage_month, round(sum(accrued), 2) AS amortized_cost FROM b GROUP BY 1, 2
ORDER BY amortized_cost DESC NULLS LAST, resource_id, usage_month LIMIT 50""")
    e.add("block_partition_predicates", partition_predicates, rows() + """SELECT year, month,
 count(*) AS line_items FROM b WHERE mon IN ('1996-12', '1997-01', '1997-02', '1998-06')
GROUP BY 1, 2""")
