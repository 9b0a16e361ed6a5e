"""Known answers on hand-made rows."""

import pytest
from costweave.functions import cost as C
from costweave.operators import breakdown as B, usage as U
from costweave.operators.reconcile import reconcile
from costweave.sources.period import Period
from rows import billing, dicts

MAR = Period.month(1998, 3)


def test_amortized_adds_reservation_money(spark):
    df = billing(spark, [{"cost": None, "ri_upfront": 4.0, "ri_recurring": 2.0, "type": "RIFee"},
                         {"cost": 10.0}])
    (row,) = dicts(B.cost_by_service(df, MAR))
    assert row["unblended_cost"] == 10.0 and row["amortized_cost"] == 16.0
    assert row["share_of_total_pct"] == 100.0 and row["line_items"] == 2


def test_null_service_and_account_stay_rows(spark):
    df = billing(spark, [{"product": None, "account": None, "type": "Tax", "cost": 5.0},
                         {"cost": 15.0}])
    rows = dicts(B.cost_by_service(df, MAR))
    assert [(r["usage_account_id"], r["service"], r["share_of_total_pct"]) for r in rows] == [
        ("1", "AmazonEC2", 75.0), (None, None, 25.0)]


def test_zero_total_gives_null_shares(spark):
    df = billing(spark, [{"cost": 5.0}, {"cost": -5.0, "product": "AmazonS3"}])
    assert {r["share_of_total_pct"] for r in dicts(B.cost_by_service(df, MAR))} == {None}


def test_account_split_by_type(spark):
    kinds = ["Usage", "SavingsPlanCoveredUsage", "SavingsPlanNegation", "RIFee",
             "SavingsPlanRecurringFee", "SavingsPlanUpfrontFee", "Fee", "Tax", "Credit", "Refund",
             "Discount", "BundledDiscount"]
    df = billing(spark, [{"type": k, "cost": float(2 ** i), "account": None}
                         for i, k in enumerate(kinds)] + [{"type": None, "cost": 10000.0,
                                                           "account": None}])
    (row,) = dicts(B.cost_by_account(df, MAR))
    assert row["usage_account_id"] == "(blank)"
    assert row["usage_on_demand"] == 1 and row["sp_fee"] == 16 + 32
    assert row["discounts"] == 1024 + 2048
    assert row["ri_discounted_usage"] is None, "a type that does not occur is NULL, not 0"
    assert row["consumption_subtotal"] == 127.0, "rows of NULL type are not consumption"
    assert row["unblended_total"] == 4095 + 10000
    assert row["distinct_line_item_types"] == 12


def test_split_columns_add_up(spark):
    df = billing(spark, [{"type": k, "cost": float(i * 3 - 7)} for i, k in enumerate(
        ["Usage", "Usage", "DiscountedUsage", "SavingsPlanNegation", "Tax", "Refund", "Discount"])])
    (row,) = dicts(B.cost_by_account(df, MAR))
    parts = ["usage_on_demand", "ri_discounted_usage", "sp_covered_usage", "sp_negation",
             "ri_fee", "sp_fee", "other_fees", "tax", "credits", "refunds", "discounts"]
    assert sum(row[p] or 0 for p in parts) == row["unblended_total"]


def test_resource_bucket_folds_null_and_empty(spark):
    df = billing(spark, [{"resource": None, "cost": 4.0}, {"resource": "", "cost": 4.0},
                         {"resource": "i-1", "cost": 2.0}])
    rows = dicts(B.cost_by_resource(df, MAR))
    assert [(r["resource_id"], r["amortized_cost"], r["share_of_period_pct"]) for r in rows] == [
        ("(no resource id)", 8.0, 80.0), ("i-1", 2.0, 20.0)]


def test_share_is_of_the_period_not_of_the_head(spark):
    df = billing(spark, [{"resource": f"i-{i}", "cost": 1.0} for i in range(10)])
    rows = dicts(B.cost_by_resource(df, MAR, limit=3))
    assert [r["resource_id"] for r in rows] == ["i-0", "i-1", "i-2"], "ties break by key"
    assert {r["share_of_period_pct"] for r in rows} == {10.0}
    assert B.cost_by_resource(df, MAR, limit=None).count() == 10


def test_tags_keep_case_unless_folded(spark):
    df = billing(spark, [{"team": "Prod"}, {"team": "prod"}, {"team": ""}, {"team": None}])
    assert {r["team"] for r in dicts(B.cost_by_tag(df, MAR))} == {"Prod", "prod", "(untagged)"}
    folded = {r["team"]: r["line_items"] for r in dicts(B.cost_by_tag(df, MAR, fold_case=True))}
    assert folded == {"prod": 2, "(untagged)": 2}


def test_team_env_allocation_needs_one_tag(spark):
    df = billing(spark, [{"team": None, "env": ""}, {"team": "a", "env": None},
                         {"team": "", "env": "dev"}, {"team": "(no team)", "env": ""}])
    got = [(r["team"], r["environment"], r["allocated_vs_unallocated"])
           for r in dicts(B.cost_by_team_env(df, MAR))]
    assert sorted(got) == [("(no team)", "(no env)", "allocated"),
                           ("(no team)", "(no env)", "unallocated"),
                           ("(no team)", "dev", "allocated"), ("a", "(no env)", "allocated")]


def test_accounts_are_distinct_and_skip_null(spark):
    df = billing(spark, [{"account": a, "team": "a"} for a in ["1", "1", "2", None]])
    (row,) = dicts(B.cost_by_team_env(df, MAR))
    assert row["accounts"] == 2 and row["line_items"] == 4


def test_probe_of_a_missing_month(spark):
    df = billing(spark, [{}])
    (row,) = dicts(B.month_probe(df, 1998, 4))
    assert row["rows_in_month"] == 0 and row["distinct_line_item_types"] == 0
    assert row["first_usage"] is None and row["unblended_total"] is None


def test_transfer_is_case_sensitive_and_by_type(spark):
    df = billing(spark, [{"usage_type": "X-Bytes"}, {"usage_type": "X-bytes"},
                         {"usage_type": "X-Bytes", "type": "Tax"}, {"usage_type": None},
                         {"usage_type": "X-Bytes", "type": None}])
    (row,) = dicts(U.data_transfer(df, MAR))
    assert row["line_items"] == 1 and row["from_location"] == "(none)"


@pytest.mark.parametrize("usage_type,category", [
    ("TimedStorage-Requests-Bytes", "Storage"), ("Requests-Tier1", "Requests"),
    ("Select-Returned-Bytes", "Requests"), ("Inventory-Objects", "Requests"),
    ("BatchOperations-Jobs", "Requests"), ("Replication-Time", "Requests"),
    ("Out-Bytes", "Transfer"), ("EarlyDelete", "Other"), (None, "Other")])
def test_storage_category_first_word_wins(spark, usage_type, category):
    df = billing(spark, [{"product": "AmazonS3", "usage_type": usage_type}])
    (row,) = dicts(U.s3_categories(df, MAR))
    assert row["cost_category"] == category


def test_reconcile_columns(spark):
    df = billing(spark, [{"cost": 10.0}, {"cost": 3.0, "type": "Tax", "product": None},
                         {"cost": 1.0, "type": "FlatRateSubscription", "account": "2"},
                         {"cost": 5.0, "at": "1998-04-02"}])
    rows = dicts(reconcile(df, Period.span((1998, 3), (1998, 4))))
    assert [r["usage_month"] for r in rows] == ["1998-03", "1998-04"]
    march = rows[0]
    assert march["unblended_all_types"] == 14.0 and march["amortized_usage_only"] == 11.0
    assert march["gross_usage_only"] == 10.0
    assert (march["distinct_products"], march["distinct_accounts"], march["line_items"]) == (1, 2, 3)


def test_accrual_counts_each_commitment_dollar_once(spark):
    df = billing(spark, [
        {"type": "DiscountedUsage", "cost": 0.0, "ri_effective": 8.0, "ri_recurring": 3.0},
        {"type": "RIFee", "cost": 12.0, "reservation_unused_recurring_fee": 4.0},
        {"type": "SavingsPlanCoveredUsage", "cost": 50.0, "sp_effective": 30.0},
        {"type": "SavingsPlanNegation", "cost": -50.0},
        {"type": "SavingsPlanRecurringFee", "cost": 35.0,
         "savings_plan_recurring_commitment_for_billing_period": 35.0,
         "savings_plan_used_commitment": 30.0},
        {"type": "SavingsPlanUpfrontFee", "cost": 900.0}, {"type": "Fee", "cost": 700.0, "ri": "r"},
        {"type": "Fee", "cost": 7.0}])
    (row,) = dicts(B.cost_by_service(df, MAR, basis="accrual"))
    assert row["amortized_cost"] == 8 + 4 + 30 + 5 + 7


def test_unknown_basis():
    with pytest.raises(ValueError, match="unknown cost basis"):
        C.basis("nope")
