"""The analysis operators and their variants, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from costweave.functions import cost as C
from costweave.operators import breakdown as B, commitments as K, reconcile as R
from costweave.operators import trend as T, usage as U
from costweave.registry.entries import Entries
from costweave.registry.sqlbase import FULL, MONTH, STRADDLE, TWO_MONTHS, event_rows, rows, within
from costweave.sources.period import Period
from costweave.sources.sample import event_billing, lineitem_billing

FEB, MAR = (1998, 2), (1998, 3)
DEC, JAN = (1997, 12), (1998, 1)
JANUARY_2024 = Period.month(2024, 1)


def _share(value: str, name: str) -> str:
    return f"round(100.0e0 * sum({value}) / nullif((SELECT sum({value}) FROM b), 0), 2) AS {name}"


def _probe_sql() -> str:
    return rows(MONTH) + """SELECT count(*) AS rows_in_month, min(ts) AS first_usage,
 max(ts) AS last_usage, count(DISTINCT kind) AS distinct_line_item_types,
 round(sum(cash), 2) AS unblended_total FROM b"""


def _service_sql(p: Period) -> str:
    return rows(p) + f"""SELECT acct AS usage_account_id, svc AS service,
 round(sum(cash), 2) AS unblended_cost, round(sum(accrued), 2) AS amortized_cost,
 {_share('accrued', 'share_of_total_pct')}, count(*) AS line_items FROM b GROUP BY acct, svc"""


def _service_basis_sql(p: Period, expr: str) -> str:
    return rows(p) + f""", v AS (SELECT *, {expr} AS val FROM b)
SELECT acct AS usage_account_id, svc AS service, round(sum(cash), 2) AS unblended_cost,
 round(sum(val), 2) AS amortized_cost,
 round(100.0e0 * sum(val) / nullif((SELECT sum(val) FROM v), 0), 2) AS share_of_total_pct,
 count(*) AS line_items FROM v GROUP BY acct, svc"""


ACCRUAL_SQL = """CASE kind
 WHEN 'DiscountedUsage' THEN coalesce(reservation_effective_cost, 0e0)
 WHEN 'RIFee' THEN coalesce(reservation_unused_amortized_upfront_fee_for_billing_period, 0e0)
   + coalesce(reservation_unused_recurring_fee, 0e0)
 WHEN 'SavingsPlanCoveredUsage' THEN coalesce(savings_plan_savings_plan_effective_cost, 0e0)
 WHEN 'SavingsPlanRecurringFee' THEN
   coalesce(savings_plan_amortized_upfront_commitment_for_billing_period, 0e0)
   + coalesce(savings_plan_recurring_commitment_for_billing_period, 0e0)
   - coalesce(savings_plan_used_commitment, 0e0)
 WHEN 'SavingsPlanNegation' THEN 0e0 WHEN 'SavingsPlanUpfrontFee' THEN 0e0
 ELSE CASE WHEN kind = 'Fee' AND reservation_reservation_a_r_n IS NOT NULL THEN 0e0
   ELSE coalesce(cash, 0e0) END END"""


def _account_sql(p: Period) -> str:
    splits = {
        "usage_on_demand": "kind = 'Usage'", "ri_discounted_usage": "kind = 'DiscountedUsage'",
        "sp_covered_usage": "kind = 'SavingsPlanCoveredUsage'",
        "sp_negation": "kind = 'SavingsPlanNegation'", "ri_fee": "kind = 'RIFee'",
        "sp_fee": "kind IN ('SavingsPlanRecurringFee', 'SavingsPlanUpfrontFee')",
        "other_fees": "kind = 'Fee'", "tax": "kind = 'Tax'", "credits": "kind = 'Credit'",
        "refunds": "kind = 'Refund'", "discounts": "kind IN ('Discount', 'BundledDiscount')",
        "consumption_subtotal":
            "kind NOT IN ('Tax', 'Credit', 'Refund', 'Discount', 'BundledDiscount')",
    }
    cells = ",\n ".join(f"round(sum(cash) FILTER (WHERE {c}), 2) AS {n}"
                        for n, c in splits.items())
    return rows(p) + f"""SELECT coalesce(acct, '(blank)') AS usage_account_id, {cells},
 round(sum(cash), 2) AS unblended_total, round(sum(accrued), 2) AS amortized_total,
 count(DISTINCT kind) AS distinct_line_item_types
FROM b GROUP BY coalesce(acct, '(blank)')"""


def _trend_sql(p: Period | None, month: str = "mon", where: str = "true", having: str = "true",
               monthly: str | None = None) -> str:
    monthly = monthly or (f"SELECT {month} AS m, svc, sum(accrued) AS v FROM b WHERE {where}"
                          f" GROUP BY {month}, svc")
    return rows(p) + f""", monthly AS ({monthly}),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY svc ORDER BY m) AS before,
 sum(v) OVER (PARTITION BY m) AS whole FROM monthly)
SELECT m AS usage_month, svc AS service, round(v, 2) AS amortized_cost,
 round(before, 2) AS prev_month_cost, round(v - before, 2) AS mom_delta,
 round(100.0e0 * (v - before) / nullif(before, 0), 1) AS mom_delta_pct,
 round(whole, 2) AS month_total FROM lagged WHERE {having}"""


TREND_SPINE_SQL = """SELECT strftime(g.m, '%Y-%m') AS m, s.svc, coalesce(sum(b.accrued), 0e0) AS v
FROM (SELECT DISTINCT svc FROM b) s
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01',
 INTERVAL 1 MONTH)) AS m) g
LEFT JOIN b ON b.svc IS NOT DISTINCT FROM s.svc AND b.mon = strftime(g.m, '%Y-%m')
GROUP BY g.m, s.svc"""


def _drivers_sql(prev: tuple[int, int], curr: tuple[int, int], equal: str = "IS NOT DISTINCT FROM",
                 show: str = "true", total: bool = True) -> str:
    def part(m: tuple[int, int]) -> str:
        return (f"SELECT coalesce(acct, '(blank)') AS a, svc AS s, utype AS u, sum(accrued) AS v"
                f" FROM b WHERE mon = '{m[0]:04d}-{m[1]:02d}' GROUP BY ALL")
    tail = """
UNION ALL
SELECT '(all accounts)', '(TOTAL CHANGE)', '(all usage types)', NULL, NULL, round(chg, 2), 100.0e0,
 CASE WHEN chg > 0 THEN 'UP' ELSE 'DOWN' END, round(chg, 2) FROM g""" if total else ""
    return rows(Period((prev, curr))) + f""", p AS ({part(prev)}), c AS ({part(curr)}),
j AS (SELECT coalesce(c.a, p.a) AS a, coalesce(c.s, p.s) AS s, coalesce(c.u, p.u) AS u,
 coalesce(p.v, 0e0) AS was, coalesce(c.v, 0e0) AS is_now, coalesce(c.v, 0e0) - coalesce(p.v, 0e0)
 AS d FROM c FULL JOIN p ON c.a {equal} p.a AND c.s {equal} p.s AND c.u {equal} p.u),
g AS (SELECT sum(d) AS chg FROM j)
SELECT a AS usage_account_id, s AS service, u AS usage_type, round(was, 2) AS prev_cost,
 round(is_now, 2) AS curr_cost, round(d, 2) AS delta,
 round(100.0e0 * d / nullif((SELECT chg FROM g), 0), 1) AS pct_of_total_change,
 CASE WHEN was = 0 AND is_now > 0 THEN 'NEW' WHEN is_now = 0 AND was > 0 THEN 'GONE'
  WHEN d > 0 THEN 'UP' ELSE 'DOWN' END AS direction,
 round((SELECT chg FROM g), 2) AS period_total_change FROM j WHERE {show}{tail}"""


def _resource_sql(p: Period, limit: int | None = 200) -> str:
    cut = ("" if limit is None else
           " ORDER BY amortized_cost DESC NULLS LAST, usage_account_id NULLS LAST,"
           f" service NULLS LAST, resource_id NULLS LAST LIMIT {limit}")
    return rows(p) + f"""SELECT coalesce(acct, '(blank)') AS usage_account_id, svc AS service,
 coalesce(nullif(line_item_resource_id, ''), '(no resource id)') AS resource_id,
 round(sum(accrued), 2) AS amortized_cost, round(sum(amount), 4) AS usage_amount,
 count(*) AS line_items, {_share('accrued', 'share_of_period_pct')}
FROM b GROUP BY 1, 2, 3{cut}"""


def _tag_sql(p: Period, tag: str, label: str) -> str:
    return rows(p) + f"""SELECT coalesce(nullif({tag}, ''), '(untagged)') AS {label},
 round(sum(accrued), 2) AS amortized_cost, round(sum(cash), 2) AS unblended_cost,
 count(*) AS line_items, {_share('accrued', 'share_of_period_pct')} FROM b GROUP BY 1"""


def _team_env_sql(p: Period) -> str:
    return rows(p) + f""", n AS (SELECT *, nullif(resource_tags_user_team, '') AS team,
 nullif(resource_tags_user_environment, '') AS env FROM b)
SELECT coalesce(team, '(no team)') AS team, coalesce(env, '(no env)') AS environment,
 CASE WHEN team IS NULL AND env IS NULL THEN 'unallocated' ELSE 'allocated' END
 AS allocated_vs_unallocated, round(sum(accrued), 2) AS amortized_cost,
 count(DISTINCT acct) AS accounts, count(*) AS line_items,
 {_share('accrued', 'share_of_period_pct')} FROM n GROUP BY 1, 2, 3"""


def _daily_sql(base: str, service: str, day: str = "day", daily: str | None = None) -> str:
    daily = daily or (f"SELECT {day} AS d, sum(accrued) AS v, sum(amount) AS q, count(*) AS n"
                      f" FROM b WHERE svc = '{service}' GROUP BY 1")
    return base + f""", daily AS ({daily}),
w AS (SELECT *, avg(v) OVER (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM daily)
SELECT d AS usage_date, round(v, 2) AS amortized_cost, round(q, 4) AS usage_amount,
 n AS row_count, round(m, 2) AS trailing_7d_avg, round(v - m, 2) AS vs_trailing_7d FROM w"""


def _spine_daily(p: Period, service: str) -> str:
    return f"""SELECT CAST(g.d AS DATE) AS d, coalesce(sum(accrued), 0e0) AS v,
 coalesce(sum(amount), 0e0) AS q, count(b.ts) AS n
FROM (SELECT unnest(generate_series(TIMESTAMP '{p.first_instant:%Y-%m-%d}',
 TIMESTAMP '{p.last_day:%Y-%m-%d}', INTERVAL 1 DAY)) AS d) g
LEFT JOIN b ON b.day = CAST(g.d AS DATE) AND b.svc = '{service}' GROUP BY g.d"""


def _anomaly_sql(base: str, days: int = 7, min_days: int = 5, weekday: int = 0,
                 z: str = "3", pct: str = "50") -> str:
    extra_w, extra = "", ""
    if weekday:
        extra_w = (f", avg(v) OVER (PARTITION BY svc, dayofweek(d) ORDER BY d"
                   f" ROWS BETWEEN {weekday} PRECEDING AND 1 PRECEDING) AS wm")
        extra = (", round(wm, 2) AS same_weekday_mean,"
                 " round(100.0e0 * (v - wm) / nullif(wm, 0), 1) AS same_weekday_pct")
    return base + f""", daily AS (SELECT svc, day AS d, sum(accrued) AS v FROM b GROUP BY 1, 2),
w AS (SELECT *, avg(v) OVER t AS m, stddev_samp(v) OVER t AS sd, count(*) OVER t AS n{extra_w}
 FROM daily
 WINDOW t AS (PARTITION BY svc ORDER BY d ROWS BETWEEN {days} PRECEDING AND 1 PRECEDING))
SELECT svc AS service, d AS usage_date, round(v, 2) AS amortized_cost,
 round(m, 2) AS trailing_7d_mean, round(sd, 2) AS trailing_7d_sd, n AS baseline_days,
 round(v - m, 2) AS deviation_abs, round(100.0e0 * (v - m) / nullif(m, 0), 1) AS deviation_pct,
 round((v - m) / nullif(sd, 0), 2) AS z_score,
 CASE WHEN v > m THEN 'SPIKE' ELSE 'DROP' END AS direction{extra}
FROM w WHERE n >= {min_days} AND m >= 1.0e0 AND (abs((v - m) / nullif(sd, 0)) >= {z}
 OR abs(100.0e0 * (v - m) / nullif(m, 0)) >= {pct})"""


def _coverage_sql(p: Period, where: str) -> str:
    def only(kind: str, value: str) -> str:
        return f"round(sum({value}) FILTER (WHERE kind = '{kind}'), 2)"
    return rows(p) + f""", e AS (SELECT *, coalesce(reservation_effective_cost, 0e0)
 + coalesce(savings_plan_savings_plan_effective_cost, 0e0)
 + CASE WHEN kind = 'Usage' THEN coalesce(cash, 0e0) ELSE 0e0 END AS paid FROM b WHERE {where})
SELECT utype AS usage_type, coalesce(acct, '(blank)') AS usage_account_id,
 {only('Usage', 'cash')} AS on_demand_cost,
 {only('DiscountedUsage', 'cash')} AS discounted_usage_cost,
 {only('SavingsPlanCoveredUsage', 'cash')} AS sp_covered_usage,
 {only('SavingsPlanNegation', 'cash')} AS sp_negation,
 {only('DiscountedUsage', 'reservation_effective_cost')} AS ri_effective_cost,
 {only('SavingsPlanCoveredUsage', 'savings_plan_savings_plan_effective_cost')}
 AS sp_effective_cost, round(sum(listed), 2) AS public_on_demand_cost,
 round(sum(paid), 2) AS effective_cost,
 round(100.0e0 * (sum(listed) - sum(paid)) / nullif(sum(listed), 0), 1) AS effective_discount_pct
FROM e GROUP BY 1, 2 HAVING sum(listed) > 0"""


_RI_UNUSED = ("(coalesce(reservation_unused_recurring_fee, 0e0)"
              " + coalesce(reservation_unused_amortized_upfront_fee_for_billing_period, 0e0))")
_RI_PAID = ("(coalesce(reservation_amortized_upfront_fee_for_billing_period, 0e0)"
            " + coalesce(reservation_recurring_fee_for_usage, 0e0))")
_SP_PAID = ("(coalesce(savings_plan_amortized_upfront_commitment_for_billing_period, 0e0)"
            " + coalesce(savings_plan_recurring_commitment_for_billing_period, 0e0))")


def utilisation_sql(p: Period, by: str = "") -> str:
    keep = f", {by}" if by else ""
    return rows(p) + f""", fees AS (
 SELECT 'ReservedInstance' AS ct, coalesce(reservation_reservation_a_r_n, '(no ARN on row)') AS id
  {keep}, sum({_RI_PAID} + {_RI_UNUSED}) AS owed,
  sum(coalesce(reservation_recurring_fee_for_usage, 0e0)) AS used, sum({_RI_UNUSED}) AS lost,
  sum(reservation_unused_quantity) AS hours FROM b WHERE kind = 'RIFee' GROUP BY ALL
 UNION ALL
 SELECT 'SavingsPlan', coalesce(savings_plan_savings_plan_a_r_n, '(no ARN on row)'){keep},
  sum({_SP_PAID}), sum(coalesce(savings_plan_used_commitment, 0e0)),
  sum({_SP_PAID}) - sum(coalesce(savings_plan_used_commitment, 0e0)), NULL
 FROM b WHERE kind = 'SavingsPlanRecurringFee' GROUP BY ALL),
covered AS (
 SELECT 'ReservedInstance' AS ct, sum(reservation_effective_cost) AS eff, sum(listed) AS od
 FROM b WHERE kind = 'DiscountedUsage'
 UNION ALL
 SELECT 'SavingsPlan', sum(savings_plan_savings_plan_effective_cost), sum(listed)
 FROM b WHERE kind = 'SavingsPlanCoveredUsage')
SELECT f.ct AS commitment_type, f.id AS commitment_id{keep}, round(owed, 2)
 AS period_commitment_cost, round(used, 2) AS used_commitment, round(lost, 2) AS unused_commitment,
 round(hours, 2) AS unused_hours, round(100.0e0 * lost / nullif(owed, 0), 1) AS unused_pct,
 round(100.0e0 * used / nullif(owed, 0), 1) AS utilisation_pct, round(eff, 2) AS effective_cost,
 round(od, 2) AS on_demand_equivalent FROM fees f JOIN covered USING (ct)"""


def _arn_sql(p: Period) -> str:
    return rows(p) + f""", r AS (SELECT 'ReservedInstance' AS ct,
  coalesce(reservation_reservation_a_r_n, '(no ARN on row)') AS id,
  coalesce(sum(coalesce(reservation_recurring_fee_for_usage, 0e0)
   + coalesce(reservation_amortized_upfront_cost_for_usage, 0e0))
   FILTER (WHERE kind = 'DiscountedUsage'), 0e0) AS used,
  coalesce(sum({_RI_UNUSED}) FILTER (WHERE kind = 'RIFee'), 0e0) AS lost,
  sum(reservation_unused_quantity) FILTER (WHERE kind = 'RIFee') AS hours,
  sum(reservation_effective_cost) FILTER (WHERE kind = 'DiscountedUsage') AS eff,
  sum(listed) FILTER (WHERE kind = 'DiscountedUsage') AS od
 FROM b WHERE kind IN ('RIFee', 'DiscountedUsage') GROUP BY 1, 2
 UNION ALL
 SELECT 'SavingsPlan', coalesce(savings_plan_savings_plan_a_r_n, '(no ARN on row)'),
  coalesce(sum(savings_plan_used_commitment) FILTER (WHERE kind = 'SavingsPlanRecurringFee'), 0e0),
  coalesce(sum({_SP_PAID}) FILTER (WHERE kind = 'SavingsPlanRecurringFee'), 0e0)
  - coalesce(sum(savings_plan_used_commitment)
    FILTER (WHERE kind = 'SavingsPlanRecurringFee'), 0e0), NULL,
  sum(savings_plan_savings_plan_effective_cost) FILTER (WHERE kind = 'SavingsPlanCoveredUsage'),
  sum(listed) FILTER (WHERE kind = 'SavingsPlanCoveredUsage')
 FROM b WHERE kind IN ('SavingsPlanRecurringFee', 'SavingsPlanCoveredUsage') GROUP BY 1, 2)
SELECT ct AS commitment_type, id AS commitment_id, round(used + lost, 2) AS period_commitment_cost,
 round(used, 2) AS used_commitment, round(lost, 2) AS unused_commitment,
 round(hours, 2) AS unused_hours, round(100.0e0 * lost / nullif(used + lost, 0), 1) AS unused_pct,
 round(100.0e0 * used / nullif(used + lost, 0), 1) AS utilisation_pct,
 round(eff, 2) AS effective_cost, round(od, 2) AS on_demand_equivalent FROM r"""


def _transfer_sql(p: Period, where: str = "true") -> str:
    ends = ", ".join(f"coalesce(nullif(product_{e}, ''), '(none)') AS {e}" for e in (
        "from_location", "to_location", "from_location_type", "to_location_type"))
    return rows(p) + f"""SELECT svc AS service, utype AS usage_type, {ends},
 round(sum(cash), 2) AS unblended_cost, round(sum(amount), 2) AS usage_amount,
 round(sum(listed), 2) AS public_on_demand_cost, count(*) AS line_items
FROM b WHERE contains(utype, 'Bytes') AND {where}
 AND kind IN ('Usage', 'DiscountedUsage', 'SavingsPlanCoveredUsage') GROUP BY 1, 2, 3, 4, 5, 6"""


def _s3_sql(p: Period) -> str:
    return rows(p) + """SELECT CASE WHEN contains(utype, 'TimedStorage') THEN 'Storage'
  WHEN regexp_matches(utype, 'Requests|Select|Inventory|BatchOperations|Replication')
  THEN 'Requests' WHEN contains(utype, 'Bytes') THEN 'Transfer' ELSE 'Other' END AS cost_category,
 utype AS usage_type, coalesce(nullif(product_storage_class, ''), '(none)') AS storage_class,
 acct AS usage_account_id, round(sum(cash), 2) AS unblended_cost,
 round(sum(amount), 2) AS usage_amount, count(*) AS line_items
FROM b WHERE svc = 'AmazonS3' GROUP BY 1, 2, 3, 4"""


def _pruned_sql(p: Period) -> str:
    return rows(p) + """SELECT svc AS service, acct AS usage_account_id,
 round(sum(cash), 2) AS unblended_cost, round(sum(accrued), 2) AS amortized_cost,
 round(sum(amount), 4) AS usage_amount, count(*) AS line_items FROM b GROUP BY 1, 2"""


def _reconcile_sql(p: Period) -> str:
    return rows(p) + """SELECT mon AS usage_month, round(sum(cash), 2) AS unblended_all_types,
 round(sum(accrued), 2) AS amortized_all_types,
 round(sum(accrued) FILTER (WHERE kind NOT IN ('Tax', 'Credit', 'Refund', 'Discount',
  'BundledDiscount')), 2) AS amortized_usage_only,
 round(sum(cash) FILTER (WHERE kind IN ('Usage', 'DiscountedUsage', 'SavingsPlanCoveredUsage',
  'SavingsPlanNegation', 'SavingsPlanRecurringFee', 'SavingsPlanUpfrontFee', 'RIFee', 'Fee')), 2)
 AS gross_usage_only, count(*) AS line_items, count(DISTINCT svc) AS distinct_products,
 count(DISTINCT acct) AS distinct_accounts FROM b GROUP BY 1"""


def _type_sql(p: Period) -> str:
    return rows(p) + """SELECT kind AS line_item_type, count(*) AS line_items,
 round(sum(cash), 2) AS unblended_cost FROM b GROUP BY 1"""


def net_billing(spark, sf: str):
    """The sample rows with the optional column of costs after discounts: a tenth off, in whole units."""
    net = F.floor(F.col(C.CASH) * 9.0 / 10.0).cast("double")
    return lineitem_billing(spark, sf).withColumn("line_item_net_unblended_cost", net)


def register(e: Entries) -> None:
    def on(fn, *args, **kwargs):
        return lambda spark, sf: fn(lineitem_billing(spark, sf), *args, **kwargs)

    def on_events(fn, *args, **kwargs):
        return lambda spark, sf: fn(event_billing(spark, sf), *args, **kwargs)

    # One entry per analysis operator, over the whole history unless it compares months.
    e.add("month_probe", on(B.month_probe, 1998, 3), _probe_sql())
    for name, fn, sql in [
        ("cost_by_service", B.cost_by_service, _service_sql),
        ("cost_by_account", B.cost_by_account, _account_sql),
        ("cost_by_resource", B.cost_by_resource, _resource_sql),
        ("cost_by_tag", B.cost_by_tag,
         lambda p: _tag_sql(p, "resource_tags_user_team", "team")),
        ("cost_by_team_env", B.cost_by_team_env, _team_env_sql),
        ("type_contribution", B.type_contribution, _type_sql),
        ("commitment_coverage", K.commitment_coverage,
         lambda p: _coverage_sql(p, "svc = 'AmazonEC2'")),
        ("commitment_utilisation", K.commitment_utilisation, utilisation_sql),
        ("commitment_utilisation_by_arn", K.commitment_utilisation_by_arn, _arn_sql),
        ("data_transfer", U.data_transfer, _transfer_sql),
        ("s3_categories", U.s3_categories, _s3_sql),
        ("cost_by_service_pruned", B.cost_by_service_pruned, _pruned_sql),
        ("reconcile", R.reconcile, _reconcile_sql),
    ]:
        e.add(name, on(fn, FULL), sql(FULL))
        e.add(f"{name}_one_month", on(fn, MONTH), sql(MONTH))
    e.add("mom_trend", on(T.mom_trend, FULL), _trend_sql(FULL))
    e.add("mom_trend_year_straddle", on(T.mom_trend, STRADDLE), _trend_sql(STRADDLE))
    e.add("top_drivers", on(T.top_drivers, FEB, MAR), _drivers_sql(FEB, MAR))
    e.add("top_drivers_joined", on(T.top_drivers, FEB, MAR, method="join"), _drivers_sql(FEB, MAR))
    e.add("top_drivers_plain_equality", on(T.top_drivers, FEB, MAR, null_safe=False),
          _drivers_sql(FEB, MAR, "="))
    e.add("top_drivers_year_straddle", on(T.top_drivers, DEC, JAN), _drivers_sql(DEC, JAN))
    e.add("daily_series", on(T.daily_series, FULL, "AmazonEC2"),
          _daily_sql(rows(FULL), "AmazonEC2"))
    e.add("daily_series_one_month", on(T.daily_series, MONTH, "AmazonEC2"),
          _daily_sql(rows(MONTH), "AmazonEC2"))
    e.add("anomalies", on(T.anomalies, FULL), _anomaly_sql(rows(FULL)))
    e.add("anomalies_two_months", on(T.anomalies, TWO_MONTHS), _anomaly_sql(rows(TWO_MONTHS)))

    # Documented variants.
    e.add("mom_trend_spine", on(T.mom_trend, FULL, spine=True),
          _trend_sql(FULL, monthly=TREND_SPINE_SQL))
    e.add("mom_trend_billing_period", on(T.mom_trend, FULL, by_billing_period=True),
          _trend_sql(FULL, "strftime(bill_billing_period_start_date, '%Y-%m')",
                     within(FULL, "bill_billing_period_start_date")))
    e.add("mom_trend_products", on(T.mom_trend, FULL, products=["AmazonEC2", "AmazonS3"]),
          _trend_sql(FULL, where="svc IN ('AmazonEC2', 'AmazonS3')"))
    e.add("mom_trend_min_delta", on(T.mom_trend, FULL, min_abs_delta=500000.0),
          _trend_sql(FULL, having="abs(v - before) >= 500000"))
    e.add("top_drivers_min_delta",
          on(T.top_drivers, FEB, MAR, min_abs_delta=100000.0, total_row=False),
          _drivers_sql(FEB, MAR, show="abs(d) >= 100000", total=False))
    e.add("cost_by_tag_folded", on(B.cost_by_tag, FULL, fold_case=True),
          _tag_sql(FULL, "lower(resource_tags_user_team)", "team"))
    e.add("cost_by_environment",
          on(B.cost_by_tag, FULL, "resource_tags_user_environment", "environment"),
          _tag_sql(FULL, "resource_tags_user_environment", "environment"))
    e.add("cost_by_resource_all", on(B.cost_by_resource, FULL, None), _resource_sql(FULL, None))
    e.add("daily_series_spine", on(T.daily_series, FULL, "AmazonEC2", spine=True),
          _daily_sql(rows(FULL), "AmazonEC2", daily=_spine_daily(FULL, "AmazonEC2")))
    e.add("daily_series_intraday", on_events(T.daily_series, JANUARY_2024, "view"),
          _daily_sql(event_rows(JANUARY_2024), "view"))
    e.add("daily_series_shifted_day",
          on_events(T.daily_series, JANUARY_2024, "view", day_shift_hours=-5),
          _daily_sql(event_rows(JANUARY_2024.shifted(-5)), "view",
                     "CAST(ts - INTERVAL 5 HOUR AS DATE)"))
    e.add("anomalies_intraday", on_events(T.anomalies, JANUARY_2024, pct=20.0, z=2.0),
          _anomaly_sql(event_rows(JANUARY_2024), z="2", pct="20"))
    e.add("anomalies_weekly_cycle",
          on(T.anomalies, FULL, window_days=14, min_days=10, same_weekday_rows=4),
          _anomaly_sql(rows(FULL), 14, 10, 4))
    e.add("commitment_coverage_all_products", on(K.commitment_coverage, FULL, None),
          _coverage_sql(FULL, "true"))
    e.add("commitment_utilisation_by_instance",
          on(K.commitment_utilisation, FULL, ("product_instance_type",)),
          utilisation_sql(FULL, "product_instance_type"))
    e.add("data_transfer_products", on(U.data_transfer, FULL, ["AmazonEC2", "AmazonRDS"]),
          _transfer_sql(FULL, "svc IN ('AmazonEC2', 'AmazonRDS')"))
    for basis, expr in [("cash", "cash"), ("blended", "line_item_blended_cost"),
                        ("list", "listed"), ("accrual", ACCRUAL_SQL)]:
        e.add(f"cost_by_service_{basis}_basis", on(B.cost_by_service, FULL, basis),
              _service_basis_sql(FULL, expr))
    e.add("cost_by_service_net_basis", lambda spark, sf: B.cost_by_service(net_billing(spark, sf), FULL, "net"),
          _service_basis_sql(FULL, "floor(cash * 9e0 / 10e0)"))
