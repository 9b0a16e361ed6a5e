"""Each check finds the one thing that is wrong, and nothing on clean rows."""

from costweave.checks import compare, contract, quality as Q
from costweave.operators import breakdown as B, trend as T
from costweave.schema import CONTRACT, LINE_ITEM_TYPES
from costweave.sources.billing_table import conform
from costweave.sources.period import Period
from rows import billing, dicts

MAR = Period.month(1998, 3)
CLEAN = [{"at": f"1998-03-{d:02d}", "type": t, "currency": "USD", "id": f"{d}-{t}", "team": "a",
          "resource": "r"} for d in (1, 31) for t in ("Usage", "Fee")]


def bad(df):
    return [r for r in dicts(df) if not r["ok"]]


def test_clean_rows_pass(spark):
    df = billing(spark, CLEAN)
    for found in (Q.check_partitions(df, MAR), Q.check_partition_dates(df),
                  Q.check_line_item_types(df), Q.check_savings_plan_balance(df),
                  Q.check_population(df), Q.check_currency(df), Q.check_last_month(df),
                  Q.check_type_variety(df), Q.check_attribution(df), Q.check_duplicates(df),
                  Q.health_report(df), compare.check_pruning(df, MAR, T.monthly_cost)):
        assert bad(found) == []


def test_contract_states(spark):
    df = (billing(spark, CLEAN).drop("bill_invoice_id").withColumnRenamed(
        "line_item_usage_amount", "line_item_amount")
        .selectExpr("*", "CAST(1 AS INT) AS extra")
        .withColumn("line_item_unblended_cost", B.F.lit("x")))
    found = {r["subject"]: r for r in dicts(contract.check_contract(df))}
    assert found["bill_invoice_id"]["detail"] == "missing, declared string"
    assert found["line_item_usage_amount"]["detail"] == "missing, declared double"
    assert found["line_item_unblended_cost"]["detail"] == "declared double, found string"
    assert found["extra"]["ok"] and found["extra"]["severity"] == "info"
    assert found["resource_tags_user_environment"]["detail"].endswith("NULL everywhere")
    assert found["resource_tags_user_team"]["observed"] == 1.0
    assert len(found) == len(CONTRACT) + 2


def test_contract_of_an_empty_table(spark):
    found = dicts(contract.check_contract(billing(spark, CLEAN).where("false")))
    assert len(found) == 80 and not any(r["ok"] for r in found)


def test_profile_per_month(spark):
    df = billing(spark, CLEAN + [{"at": "1998-04-01"}])
    got = {(r["month"], r["column_name"]): r["fill_rate"] for r in dicts(contract.contract_profile(df))}
    assert got["03", "resource_tags_user_team"] == 1.0
    assert got["04", "resource_tags_user_team"] == 0.0


def test_partition_spelling_and_gaps(spark):
    df = billing(spark, [{"at": "1998-03-05", "month": "3"}, {"at": "1998-01-05"},
                         {"at": "1997-06-05"}, {"at": "1998-02-05", "year": None}])
    found = {r["subject"]: (r["ok"], r["detail"])
             for r in dicts(Q.check_partitions(df, Period.span((1998, 1), (1998, 3))))}
    assert found == {"1998-3": (False, "bad format"), "1998-01": (True, "present"),
                     "1997-06": (True, "outside the period"), "1998-02": (False, "missing"),
                     "1998-03": (False, "missing"), "(null)-02": (False, "bad format")}


def test_strays(spark):
    df = billing(spark, CLEAN + [{"at": "1998-04-01", "month": "03"}, {"at": "1998-03-09", "month": "x"}])
    found = {r["subject"]: r["observed"] for r in bad(Q.check_partition_dates(df))}
    assert found == {"1998-03": 1.0, "1998-x": 1.0}


def test_undocumented_types(spark):
    rows = [{"type": t} for t in LINE_ITEM_TYPES] + [{"type": "EdpDiscount", "cost": 7.0},
                                                     {"type": None}]
    found = {r["subject"]: r["detail"] for r in bad(Q.check_line_item_types(billing(spark, rows)))}
    assert found == {"EdpDiscount": "unblended cost 7", "(null)": "unblended cost 1"}


def test_balance_per_day_and_plan(spark):
    df = billing(spark, [
        {"type": "SavingsPlanCoveredUsage", "sp": "a", "cost": 3.0},
        {"type": "SavingsPlanCoveredUsage", "sp": "a", "cost": 4.0},
        {"type": "SavingsPlanNegation", "sp": "a", "cost": -7.0},
        {"type": "SavingsPlanCoveredUsage", "sp": None, "cost": 2.0}, {"type": "Usage", "cost": 9.0}])
    found = bad(Q.check_savings_plan_balance(df))
    assert [(r["subject"], r["observed"]) for r in found] == [("1998-03-05 (no ARN on row)", 2.0)]
    assert bad(Q.check_savings_plan_balance(df, tolerance=2.0)) == []


def test_population(spark):
    df = billing(spark, [{"type": "Usage", "ri_effective": 1.0}, {"type": None, "ri_effective": 1.0},
                         {"type": "DiscountedUsage", "ri_effective": 1.0},
                         {"type": "RIFee", "ri_recurring": 1.0}])
    found = {r["subject"]: r["observed"] for r in bad(Q.check_population(df))}
    assert found == {"reservation_effective_cost": 2.0, "reservation_recurring_fee_for_usage": 1.0}


def test_currency(spark):
    df = billing(spark, [{"currency": "USD"}, {"currency": "EUR"}, {"currency": None}])
    assert {r["subject"] for r in bad(Q.check_currency(df))} == {"EUR", "(none)"}
    assert {r["subject"] for r in bad(Q.check_currency(df, "EUR"))} == {"USD", "(none)"}


def test_incomplete_month(spark):
    (row,) = bad(Q.check_last_month(billing(spark, [{"at": "1998-02-25T13:00:00"}])))
    assert row["observed"] == 3.0 and row["detail"] == "last usage 1998-02-25"
    assert bad(Q.check_last_month(billing(spark, [{"at": "2000-02-29T23:00:00"}]))) == []


def test_single_type_month(spark):
    df = billing(spark, CLEAN + [{"at": "1998-04-01"}, {"at": "1998-04-02"}])
    assert [r["subject"] for r in bad(Q.check_type_variety(df))] == ["1998-04"]


def test_attribution_ceiling(spark):
    df = billing(spark, [{"resource": "", "cost": 60.0, "team": "a"},
                         {"resource": "r", "cost": 40.0, "team": None}])
    found = {r["subject"]: (r["ok"], r["observed"]) for r in dicts(Q.check_attribution(df))}
    assert found == {"line_item_resource_id": (False, 60.0), "resource_tags_user_team": (True, 40.0)}


def test_duplicates_skip_missing_ids(spark):
    df = billing(spark, [{"id": "a"}, {"id": "a"}, {"id": "a"}, {"id": "b"}, {"id": None}, {"id": None}])
    assert dicts(Q.duplicate_line_items(df)) == [
        {"year": df.first().year, "month": df.first().month, "line_item_id": "a", "copies": 3, "unblended_cost": 3.0}]
    (row,) = dicts(Q.check_duplicates(df))
    assert (row["ok"], row["observed"], row["detail"]) == (False, 1.0, "surplus rows 2")


def test_reconcile_against_figures(spark):
    df = billing(spark, [{"at": "1998-01-05", "cost": 10.0}, {"at": "1998-02-05", "cost": 20.0},
                         {"at": "1998-03-05", "cost": 30.0}])
    figures = spark.createDataFrame([("1998-01", 10.004), ("1998-02", 21.0), ("1998-04", 1.0)],
                                    "usage_month string, figure double")
    found = {r["subject"]: (r["ok"], r["observed"], r["detail"]) for r in dicts(
        compare.check_reconciles(df, Period.span((1998, 1), (1998, 4)), figures))}
    assert found == {"1998-01": (True, 0.0, "agrees"), "1998-02": (False, -1.0, "differs"),
                     "1998-03": (False, None, "no trusted figure"),
                     "1998-04": (False, None, "no rows for this month")}


def test_pruning_difference(spark):
    df = billing(spark, CLEAN + [{"at": "1998-03-09", "month": "04", "cost": 5.0}])
    row, _ = dicts(compare.check_pruning(df, MAR, B.cost_by_service_pruned))
    assert not row["ok"] and row["observed"] == 2.0


def test_multiset_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, v string")
    got = sorted((r["k"], r["surplus"]) for r in dicts(compare.multiset_difference(a, b)))
    assert got == [(1, 1), (3, -1)]


def test_health_report_counts(spark):
    df = billing(spark, CLEAN + [
        {"at": "1998-04-03", "month": "03", "type": "Odd", "currency": "EUR", "resource": "r",
         "team": None, "ri_effective": 1.0, "cost": 96.0}])
    found = {(r["check_id"], r["subject"]): (r["ok"], r["observed"])
             for r in dicts(Q.health_report(df))}
    assert found["rows", "table"] == (True, 5.0)
    assert found["partition_dates", "table"] == (False, 1.0)
    assert found["line_item_types", "table"] == (False, 1.0)
    assert found["population", "table"] == (False, 1.0)
    assert found["currency", "table"] == (False, 1.0)
    assert found["last_month", "table"] == (False, 27.0)
    assert found["attribution", "resource_tags_user_team"] == (False, 96.0)
    assert found["attribution", "line_item_resource_id"] == (True, 0.0)


def test_conform_fills_absent_columns(spark):
    df = conform(billing(spark, CLEAN).select("year", "month", "line_item_unblended_cost"))
    assert df.columns == CONTRACT.names
    assert df.schema["savings_plan_start_time"].dataType.simpleString() == "timestamp"
