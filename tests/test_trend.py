from costweave.operators import commitments as K, trend as T
from costweave.sources.period import Period
from rows import billing, dicts

MAR = Period.month(1998, 3)


def days(values, product="AmazonEC2", start=1):
    return [{"at": f"1998-03-{start + i:02d}", "cost": float(v), "product": product}
            for i, v in enumerate(values) if v is not None]


def test_lag_jumps_gaps_unless_filled(spark):
    df = billing(spark, [{"at": "1998-01-05", "cost": 10.0}, {"at": "1998-03-05", "cost": 16.0}])
    period = Period.span((1998, 1), (1998, 4))
    plain = {r["usage_month"]: r["prev_month_cost"] for r in dicts(T.mom_trend(df, period))}
    assert plain == {"1998-01": None, "1998-03": 10.0}
    filled = {r["usage_month"]: (r["amortized_cost"], r["prev_month_cost"])
              for r in dicts(T.mom_trend(df, period, spine=True))}
    assert filled == {"1998-01": (10.0, None), "1998-02": (0.0, 10.0), "1998-03": (16.0, 0.0),
                      "1998-04": (0.0, 16.0)}


def test_trend_across_new_year(spark):
    df = billing(spark, [{"at": "1997-12-05", "cost": 10.0}, {"at": "1998-01-05", "cost": 15.0}])
    rows = dicts(T.mom_trend(df, Period.span((1997, 12), (1998, 1))))
    assert rows[0]["usage_month"] == "1998-01" and rows[0]["mom_delta_pct"] == 50.0


def drivers(df, **kw):
    return {(r["usage_account_id"], r["service"], r["usage_type"]): r
            for r in dicts(T.top_drivers(df, (1998, 2), (1998, 3), **kw))}


MOVES = [{"at": "1998-02-05", "cost": 10.0, "usage_type": "up"},
         {"at": "1998-03-05", "cost": 30.0, "usage_type": "up"},
         {"at": "1998-03-05", "cost": 7.0, "usage_type": "new"},
         {"at": "1998-02-05", "cost": 9.0, "usage_type": "gone"},
         {"at": "1998-02-05", "cost": 5.0, "usage_type": "same"},
         {"at": "1998-03-05", "cost": 5.0, "usage_type": "same"},
         {"at": "1998-03-05", "cost": -4.0, "usage_type": "credit"},
         {"at": "1998-02-05", "cost": 2.0, "usage_type": "tax", "product": None},
         {"at": "1998-03-05", "cost": 3.0, "usage_type": "tax", "product": None}]


def test_driver_directions(spark):
    got = drivers(billing(spark, MOVES))
    kinds = {k[2]: r["direction"] for k, r in got.items()}
    assert kinds == {"up": "UP", "new": "NEW", "gone": "GONE", "same": "DOWN", "credit": "DOWN",
                     "tax": "UP", "(all usage types)": "UP"}
    total = got[("(all accounts)", "(TOTAL CHANGE)", "(all usage types)")]
    assert total["delta"] == 15.0 and total["pct_of_total_change"] == 100.0
    assert total["prev_cost"] is None
    assert sum(r["delta"] for k, r in got.items() if k[1] != "(TOTAL CHANGE)") == 15.0


def test_one_pass_equals_join(spark):
    df = billing(spark, MOVES)
    assert drivers(df) == drivers(df, method="join")


def test_plain_equality_splits_null_keys(spark):
    rows = dicts(T.top_drivers(billing(spark, MOVES), (1998, 2), (1998, 3), null_safe=False))
    taxes = sorted((r["prev_cost"], r["curr_cost"], r["direction"]) for r in rows
                   if r["usage_type"] == "tax")
    assert taxes == [(0.0, 3.0, "NEW"), (2.0, 0.0, "GONE")]


def test_min_delta_hides_rows_but_not_change(spark):
    rows = dicts(T.top_drivers(billing(spark, MOVES), (1998, 2), (1998, 3), min_abs_delta=8.0,
                               total_row=False))
    assert [r["usage_type"] for r in rows] == ["up", "gone"]
    assert {r["period_total_change"] for r in rows} == {15.0}


def test_drivers_backwards_in_time(spark):
    rows = dicts(T.top_drivers(billing(spark, MOVES), (1998, 3), (1998, 2)))
    assert {r["period_total_change"] for r in rows} == {-15.0}


def test_trailing_mean_excludes_today_and_counts_rows(spark):
    df = billing(spark, days([10, 20, None, 60, 1, 1, 1, 1, 1, 1]))
    rows = dicts(T.daily_series(df, MAR, "AmazonEC2"))
    assert rows[0]["trailing_7d_avg"] is None and rows[1]["trailing_7d_avg"] == 10.0
    assert rows[2]["trailing_7d_avg"] == 15.0, "a missing day is not part of the frame"
    assert rows[-1]["trailing_7d_avg"] == round((20 + 60 + 5) / 7, 2)


def test_daily_spine_adds_zero_days(spark):
    df = billing(spark, days([10, None, 30], start=2))
    rows = dicts(T.daily_series(df, MAR, "AmazonEC2", spine=True))
    assert len(rows) == 31
    assert [r["amortized_cost"] for r in rows[:4]] == [0.0, 10.0, 0.0, 30.0]
    assert [r["row_count"] for r in rows[:4]] == [0, 1, 0, 1]


def test_intraday_rows_and_day_shift(spark):
    df = billing(spark, [{"at": "1998-03-02T23:30:00"}, {"at": "1998-03-03T00:30:00"}])
    plain = dicts(T.daily_series(df, MAR, "AmazonEC2"))
    assert [str(r["usage_date"]) for r in plain] == ["1998-03-02", "1998-03-03"]
    moved = dicts(T.daily_series(df, MAR, "AmazonEC2", day_shift_hours=2))
    assert [(str(r["usage_date"]), r["row_count"]) for r in moved] == [("1998-03-03", 2)]


def test_flat_baseline_has_null_z_but_percentage(spark):
    df = billing(spark, days([10] * 7 + [20]))
    (row,) = dicts(T.anomalies(df, MAR))
    assert row["z_score"] is None and row["deviation_pct"] == 100.0
    assert row["direction"] == "SPIKE" and row["baseline_days"] == 7


def test_baseline_needs_days_and_mean(spark):
    assert T.anomalies(billing(spark, days([10] * 4 + [100])), MAR).count() == 0
    assert T.anomalies(billing(spark, days([0.5] * 7 + [100])), MAR).count() == 0
    assert T.anomalies(billing(spark, days([10] * 5 + [100])), MAR).count() == 1


def test_services_have_their_own_baseline(spark):
    df = billing(spark, days([1000] * 8, "AmazonEC2") + days([10] * 7 + [2], "AmazonS3"))
    (row,) = dicts(T.anomalies(df, MAR))
    assert (row["service"], row["direction"]) == ("AmazonS3", "DROP")


def test_same_weekday_columns(spark):
    df = billing(spark, days([10, 20, 30, 40, 50, 60, 70] * 3 + [500]))
    row = dicts(T.anomalies(df, MAR, window_days=14, min_days=10, same_weekday_rows=2))[0]
    assert row["same_weekday_mean"] == 10.0 and row["same_weekday_pct"] == 4900.0


def test_coverage_keeps_committed_cost(spark):
    df = billing(spark, [
        {"cost": 100.0, "listed": 100.0},
        {"type": "DiscountedUsage", "cost": 0.0, "listed": 50.0, "ri_effective": 30.0},
        {"type": "SavingsPlanCoveredUsage", "cost": 40.0, "listed": 40.0, "sp_effective": 20.0},
        {"type": "SavingsPlanNegation", "cost": -40.0},
        {"usage_type": "free", "cost": 1.0, "listed": 0.0}])
    (row,) = dicts(K.commitment_coverage(df, MAR))
    assert row["effective_cost"] == 150.0 and row["public_on_demand_cost"] == 190.0
    assert row["effective_discount_pct"] == 21.1


def test_utilisation_sections(spark):
    df = billing(spark, [
        {"type": "RIFee", "ri": "r1", "ri_upfront": 60.0, "ri_recurring": 20.0,
         "reservation_unused_recurring_fee": 15.0, "reservation_unused_quantity": 9.0,
         "reservation_unused_amortized_upfront_fee_for_billing_period": 5.0},
        {"type": "DiscountedUsage", "ri": "r1", "ri_effective": 70.0, "listed": 120.0},
        {"type": "DiscountedUsage", "ri": "r2", "ri_effective": 1.0, "listed": 2.0},
        {"type": "SavingsPlanRecurringFee", "sp": None,
         "savings_plan_recurring_commitment_for_billing_period": 50.0,
         "savings_plan_used_commitment": 40.0,
         "savings_plan_total_commitment_to_date": 5000.0}])
    rows = {r["commitment_type"]: r for r in dicts(K.commitment_utilisation(df, MAR))}
    ri, sp = rows["ReservedInstance"], rows["SavingsPlan"]
    assert ri["commitment_id"] == "r1" and ri["period_commitment_cost"] == 100.0
    assert (ri["used_commitment"], ri["unused_commitment"], ri["unused_hours"]) == (20.0, 20.0, 9.0)
    assert ri["effective_cost"] == 71.0, "section total, also of reservations without a fee row"
    assert sp["commitment_id"] == "(no ARN on row)"
    assert (sp["unused_pct"], sp["utilisation_pct"], sp["unused_hours"]) == (20.0, 80.0, None)
    assert sp["effective_cost"] is None
    own = {r["commitment_id"]: r for r in dicts(K.commitment_utilisation_by_arn(df, MAR))}
    assert own["r1"]["effective_cost"] == 70.0 and own["r2"]["on_demand_equivalent"] == 2.0
