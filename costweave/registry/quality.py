"""The data checks over the whole sample table, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from costweave import schema as S
from costweave.checks import compare, contract, quality as Q
from costweave.operators import trend as T
from costweave.registry.analysis import _trend_sql
from costweave.registry.entries import Entries
from costweave.registry.sqlbase import FULL, TWO_MONTHS, rows, within
from costweave.registry.storage import whole
from costweave.sources.period import Period
from costweave.sources.sample import LINEITEM_MAP, lineitem_billing, lineitem_rows

YEAR = Period.span((1998, 1), (1998, 12))
MAPPED = [name for name, _ in LINEITEM_MAP]


def _finding(check: str, severity: str, ok: str, subject: str, observed: str, detail: str) -> str:
    return (f"SELECT '{check}' AS check_id, '{severity}' AS severity, {ok} AS ok,"
            f" {subject} AS subject, CAST({observed} AS DOUBLE) AS observed, {detail} AS detail")


def _contract_sql() -> str:
    kinds = {f.name: f.dataType.simpleString() for f in S.CONTRACT}
    out = []
    for name, kind in kinds.items():
        if name not in MAPPED:
            out.append(_finding("contract", "error", "false", f"'{name}'", "0.0",
                                f"'missing, declared {kind}'"))
        else:
            out.append(_finding(
                "contract", "warning", f"count({name}) > 0", f"'{name}'",
                f"round(count({name})::DOUBLE / count(*), 4)",
                f"CASE WHEN count({name}) = 0 THEN 'declared, NULL everywhere'"
                " ELSE 'declared' END") + " FROM cur")
    return rows() + "\nUNION ALL ".join(out)


def _profile_sql() -> str:
    cells = "\nUNION ALL ".join(
        f"SELECT year, month, count(*) AS rows, '{c}' AS column_name, count({c}) AS filled,"
        f" round(count({c})::DOUBLE / count(*), 4) AS fill_rate FROM cur GROUP BY year, month"
        for c in MAPPED)
    return rows() + cells


def _population_sql() -> str:
    out = []
    for column, kind in S.POPULATED_ON.items():
        n = (f"count({column}) FILTER (WHERE kind IS DISTINCT FROM '{kind}')"
             if column in MAPPED else "0")
        out.append(_finding("population", "warning", f"{n} = 0", f"'{column}'", n,
                            f"'belongs on {kind}'") + (" FROM b" if column in MAPPED else ""))
    return rows() + "\nUNION ALL ".join(out)


def trusted_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly figures of an outside source: right for most months, wrong or absent for some."""
    month = F.date_format("usage", "yyyy-MM")
    cash = (lineitem_rows(spark, sf)
            .groupBy(F.trunc("line_item_usage_start_date", "month").alias("usage"))
            .agg(F.sum("line_item_unblended_cost").alias("cash")))
    return (cash.where(F.month("usage") != 7)
            .select(month.alias("usage_month"),
                    (F.col("cash") + F.when(F.month("usage") == 2, 125.0).otherwise(0.0))
                    .alias("figure")))


def late_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows filed under their billing period, which lags usage by three days."""
    period = F.col("bill_billing_period_start_date")
    return lineitem_billing(spark, sf).withColumns(
        {"year": F.date_format(period, "yyyy"), "month": F.date_format(period, "MM")})


_HEALTH_WRONG = " + ".join(
    f"count({c}) FILTER (WHERE kind IS DISTINCT FROM '{k}')"
    for c, k in S.POPULATED_ON.items() if c in MAPPED)
_KNOWN = "kind IN (" + ", ".join(f"'{t}'" for t in S.LINE_ITEM_TYPES) + ")"
_MISSING = "date_diff('day', max(day), CAST(last_day(max(day)) AS DATE))"


def _pct(column: str) -> str:
    return (f"round(100.0e0 * coalesce(sum(accrued) FILTER (WHERE nullif({column}, '') IS NULL),"
            " 0e0) / nullif(sum(accrued), 0), 2)")


def _attribution_sql(columns: list[str], subject: str = "attribution") -> list[str]:
    return [_finding("attribution", "info", f"coalesce({_pct(c)} <= 50, true)", f"'{c}'", _pct(c),
                     "'percent of cost without a value'") + " FROM b" for c in columns]


def _health_sql() -> str:
    odd = f"count(*) FILTER (WHERE NOT coalesce({_KNOWN}, false))"
    currency = "count(*) FILTER (WHERE line_item_currency_code IS DISTINCT FROM 'USD')"
    out = [
        _finding("rows", "error", "count(*) > 0", "'table'", "count(*)",
                 "'rows in the table'") + " FROM b",
        _finding("partition_dates", "warning", "true", "'table'", "0",
                 "'rows used in another month'"),
        _finding("line_item_types", "warning", f"{odd} = 0", "'table'", odd,
                 "'rows of undocumented type'") + " FROM b",
        _finding("population", "warning", f"{_HEALTH_WRONG} = 0", "'table'", _HEALTH_WRONG,
                 "'values on the wrong type'") + " FROM b",
        _finding("currency", "error", f"{currency} = 0", "'table'", currency,
                 "'rows not in USD'") + " FROM b",
        _finding("last_month", "warning", f"{_MISSING} = 0", "'table'", _MISSING,
                 "'days missing in the newest month'") + " FROM b",
        *_attribution_sql(["line_item_resource_id", "resource_tags_user_team"]),
    ]
    return rows() + "\nUNION ALL ".join(out)


def register(e: Entries) -> None:
    def on(fn, *args, **kwargs):
        return lambda spark, sf: fn(lineitem_billing(spark, sf), *args, **kwargs)

    e.add("check_contract", lambda s, sf: contract.check_contract(lineitem_rows(s, sf)),
          _contract_sql())
    e.add("contract_profile", lambda s, sf: contract.contract_profile(lineitem_rows(s, sf)),
          _profile_sql())
    e.add("check_partitions", on(Q.check_partitions, FULL), rows() + """,
have AS (SELECT year || '-' || month AS m, count(*) AS n FROM cur GROUP BY 1),
asked AS (SELECT strftime(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01',
 INTERVAL 1 MONTH)), '%Y-%m') AS m) """ + _finding(
        "partitions", "error", "h.n IS NOT NULL", "coalesce(h.m, a.m)", "coalesce(h.n, 0)",
        "CASE WHEN h.n IS NULL THEN 'missing' WHEN a.m IS NULL THEN 'outside the period'"
        " ELSE 'present' END") + " FROM have h FULL JOIN asked a USING (m)")
    e.add("check_partition_dates", on(Q.check_partition_dates), rows() + _finding(
        "partition_dates", "warning", "count(*) FILTER (WHERE mon <> year || '-' || month) = 0",
        "year || '-' || month", "count(*) FILTER (WHERE mon <> year || '-' || month)",
        "'of rows ' || CAST(count(*) AS VARCHAR)") + " FROM b GROUP BY year, month")
    e.add("check_line_item_types", on(Q.check_line_item_types), rows() + _finding(
        "line_item_types", "warning", f"coalesce({_KNOWN}, false)", "coalesce(kind, '(null)')",
        "count(*)", "'unblended cost ' || CAST(CAST(coalesce(round(sum(cash), 0), 0)"
        " AS BIGINT) AS VARCHAR)") + " FROM b GROUP BY kind")
    balance = """, s AS (SELECT day, coalesce(savings_plan_savings_plan_a_r_n, '(no ARN on row)') AS id,
 coalesce(sum(cash) FILTER (WHERE kind = 'SavingsPlanCoveredUsage'), 0e0) AS pos,
 coalesce(sum(cash) FILTER (WHERE kind = 'SavingsPlanNegation'), 0e0) AS neg FROM b
 WHERE kind IN ('SavingsPlanCoveredUsage', 'SavingsPlanNegation') GROUP BY 1, 2) """
    e.add("savings_plan_balance", on(Q.savings_plan_balance, FULL), rows(FULL) + balance +
          "SELECT day AS usage_date, id AS commitment_id, pos AS covered, neg AS negated,"
          " round(pos + neg, 2) AS residual FROM s")
    e.add("check_savings_plan_balance", on(Q.check_savings_plan_balance), rows() + balance +
          _finding("savings_plan_balance", "error", "abs(round(pos + neg, 2)) <= 0.01",
                   "strftime(day, '%Y-%m-%d') || ' ' || id", "round(pos + neg, 2)",
                   "'covered plus negation'") + " FROM s")
    e.add("check_population", on(Q.check_population), _population_sql())
    e.add("check_currency", on(Q.check_currency), rows() + _finding(
        "currency", "error", "coalesce(line_item_currency_code = 'USD', false)",
        "coalesce(line_item_currency_code, '(none)')", "count(*)", "'expected USD'")
        + " FROM cur GROUP BY line_item_currency_code")
    e.add("check_last_month", on(Q.check_last_month), rows() + _finding(
        "last_month", "warning", f"{_MISSING} = 0", "strftime(max(day), '%Y-%m')", _MISSING,
        "'last usage ' || strftime(max(day), '%Y-%m-%d')") + " FROM b")
    e.add("check_type_variety", on(Q.check_type_variety), rows() + _finding(
        "type_variety", "warning", "count(DISTINCT kind) > 1", "year || '-' || month",
        "count(DISTINCT kind)", "'distinct line item types'") + " FROM b GROUP BY year, month")
    e.add("check_attribution",
          on(Q.check_attribution, ("resource_tags_user_team", "resource_tags_user_environment")),
          rows() + "\nUNION ALL ".join(_attribution_sql(
              ["line_item_resource_id", "resource_tags_user_team",
               "resource_tags_user_environment"])))
    e.add("check_reconciles", lambda s, sf: compare.check_reconciles(
        lineitem_billing(s, sf), FULL, trusted_figures(s, sf)), rows(FULL) + """,
ours AS (SELECT mon, round(sum(cash), 2) AS v FROM b GROUP BY 1),
figures AS (SELECT mon, sum(cash) + CASE WHEN month = '02' THEN 125.0e0 ELSE 0e0 END AS v
 FROM b WHERE month <> '07' GROUP BY mon, month),
j AS (SELECT mon, o.v AS a, f.v AS z, round(o.v - f.v, 2) AS gap
 FROM ours o FULL JOIN figures f USING (mon)),
k AS (SELECT *, CASE WHEN a IS NULL THEN 'no rows for this month' WHEN z IS NULL
 THEN 'no trusted figure' WHEN abs(gap) <= 0.01 THEN 'agrees' ELSE 'differs' END AS state FROM j)
""" + _finding("reconcile", "error", "state = 'agrees'", "mon", "gap", "state") + " FROM k")
    e.add("check_pruning",
          lambda s, sf: compare.check_pruning(whole(s, sf), YEAR, T.monthly_cost),
          rows(YEAR) + """,
p AS (SELECT mon, svc, sum(accrued) AS v FROM b WHERE year = '1998' GROUP BY 1, 2),
u AS (SELECT mon, svc, sum(accrued) AS v FROM b GROUP BY 1, 2),
d AS (SELECT coalesce(p.mon, u.mon) AS mon FROM p FULL JOIN u ON p.mon = u.mon
 AND p.svc IS NOT DISTINCT FROM u.svc WHERE p.v IS NULL OR u.v IS NULL OR abs(p.v - u.v) > 0.01) """
          + _finding("pruning", "error", "count(*) = 0", "'result keys'", "count(*)",
                     "'keys that differ without pruning'") + " FROM d UNION ALL "
          # A written month is one file.
          + _finding("pruning_files", "warning", "count(DISTINCT mon) FILTER (WHERE year = '1998') < count(DISTINCT mon)",
                     "'files read'", "count(DISTINCT mon) FILTER (WHERE year = '1998')",
                     "'of ' || count(DISTINCT mon) || ' files without pruning'")
          + " FROM (SELECT year, strftime(line_item_usage_start_date, '%Y-%m') AS mon FROM cur)")
    filed = """, f AS (SELECT mon, svc, accrued,
 strftime(bill_billing_period_start_date, '%Y-%m') AS filed FROM b) """
    e.add("check_partition_dates_late",
          lambda s, sf: Q.check_partition_dates(late_partitions(s, sf)),
          rows() + filed + _finding(
              "partition_dates", "warning", "count(*) FILTER (WHERE mon <> filed) = 0", "filed",
              "count(*) FILTER (WHERE mon <> filed)", "'of rows ' || CAST(count(*) AS VARCHAR)")
          + " FROM f GROUP BY filed")
    e.add("check_pruning_late",
          lambda s, sf: compare.check_pruning(late_partitions(s, sf), YEAR, T.monthly_cost),
          rows(YEAR) + filed + """,
p AS (SELECT mon, svc, sum(accrued) AS v FROM f WHERE filed BETWEEN '1998-01' AND '1998-12'
 GROUP BY 1, 2),
u AS (SELECT mon, svc, sum(accrued) AS v FROM f GROUP BY 1, 2),
d AS (SELECT coalesce(p.mon, u.mon) AS mon FROM p FULL JOIN u ON p.mon = u.mon
 AND p.svc IS NOT DISTINCT FROM u.svc WHERE p.v IS NULL OR u.v IS NULL OR abs(p.v - u.v) > 0.01) """
          + _finding("pruning", "error", "count(*) = 0", "'result keys'", "count(*)",
                     "'keys that differ without pruning'") + " FROM d UNION ALL "
          # The table is one file without folders, so there is nothing to prune.
          + _finding("pruning_files", "warning", "false", "'files read'", "1", "'of 1 files without pruning'"))
    e.add("mom_trend_billing_period_two_months",
          lambda s, sf: T.mom_trend(late_partitions(s, sf), TWO_MONTHS, by_billing_period=True),
          _trend_sql(None, "strftime(bill_billing_period_start_date, '%Y-%m')",
                     within(TWO_MONTHS, "bill_billing_period_start_date")))
    duplicates = """, d AS (SELECT year, month, identity_line_item_id AS line_item_id,
 count(*) AS copies, round(sum(cash), 2) AS unblended_cost FROM b
 WHERE identity_line_item_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1) """
    e.add("duplicate_line_items", on(Q.duplicate_line_items), rows() + duplicates
          + "SELECT * FROM d")
    e.add("duplicate_line_items_sifted", on(Q.duplicate_line_items, sift=True), rows() + duplicates
          + "SELECT * FROM d")
    e.add("check_duplicates", on(Q.check_duplicates), rows() + duplicates + _finding(
        "duplicates", "error", "count(*) = 0", "'identity_line_item_id'", "count(*)",
        "'surplus rows ' || CAST(coalesce(sum(copies - 1), 0) AS VARCHAR)") + " FROM d")
    e.add("health_report", on(Q.health_report), _health_sql())
