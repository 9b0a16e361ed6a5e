"""Relations that must hold between results, on the sample data."""

import pytest
from costweave.operators import breakdown as B, trend as T
from costweave.operators.reconcile import reconcile
from costweave.registry.sqlbase import FULL
from costweave.sources.period import Period
from costweave.sources.sample import lineitem_billing
from pyspark.sql import functions as F
from rows import dicts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def df(spark):
    return lineitem_billing(spark, SF)


@pytest.mark.parametrize("make,share", [
    (lambda d: B.cost_by_service(d, FULL), "share_of_total_pct"),
    (lambda d: B.cost_by_tag(d, FULL), "share_of_period_pct"),
    (lambda d: B.cost_by_team_env(d, FULL), "share_of_period_pct")])
def test_shares_add_to_100(df, make, share):
    rows = dicts(make(df))
    assert abs(sum(r[share] for r in rows) - 100) < 0.01 * len(rows)


def test_drivers_add_to_the_total(df):
    rows = dicts(T.top_drivers(df, (1998, 2), (1998, 3)))
    total = [r for r in rows if r["service"] == "(TOTAL CHANGE)"]
    assert len(total) == 1
    assert sum(r["delta"] for r in rows) == 2 * total[0]["delta"]


def test_months_are_additive(df):
    halves = (Period.span((1995, 1), (1997, 6)), Period.span((1997, 7), (2001, 12)))

    def totals(p):
        rows = dicts(reconcile(df, p))
        return sum(r["unblended_all_types"] for r in rows), sum(r["line_items"] for r in rows)

    parts = [totals(p) for p in halves]
    assert tuple(map(sum, zip(*parts))) == totals(FULL)


def test_breakdowns_agree_on_the_total(df):
    by_service = sum(r["amortized_cost"] for r in dicts(B.cost_by_service(df, FULL)))
    by_account = sum(r["amortized_total"] for r in dicts(B.cost_by_account(df, FULL)))
    by_resource = sum(r["amortized_cost"] for r in dicts(B.cost_by_resource(df, FULL, None)))
    assert by_service == by_account == by_resource


@pytest.mark.parametrize("make", [
    lambda d: B.cost_by_service(d, FULL), lambda d: T.mom_trend(d, FULL),
    lambda d: T.daily_series(d, FULL, "AmazonEC2"), lambda d: reconcile(d, FULL),
    lambda d: T.top_drivers(d, (1998, 2), (1998, 3))])
def test_zoned_timestamps_give_the_same_rows(df, make):
    zoned = df.withColumn("line_item_usage_start_date",
                          F.col("line_item_usage_start_date").cast("timestamp"))
    assert zoned.schema["line_item_usage_start_date"].dataType.simpleString() == "timestamp"
    assert dicts(make(zoned)) == dicts(make(df))


def test_hot_keys_lose_nothing(df):
    """Half of all rows on one resource, account and service: results stay whole."""
    hot = F.col("line_item_usage_amount") > 25
    skewed = df.withColumns({
        "line_item_resource_id": F.when(hot, "hot").otherwise(F.col("line_item_resource_id")),
        "line_item_usage_account_id": F.when(hot, "9").otherwise(F.col("line_item_usage_account_id"))})
    rows = dicts(B.cost_by_resource(skewed, FULL, None))
    assert sum(r["line_items"] for r in rows) == df.count()
    assert sum(r["line_items"] for r in rows if r["resource_id"] == "hot") == df.where(hot).count()
