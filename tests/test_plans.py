"""The plans are the ones meant: one scan, no global window, no nested loop, pruned reads."""

import re

import pytest
from costweave.audit.rules import audit
from costweave.checks import quality as Q
from costweave.operators import breakdown as B, commitments as K, reconcile as R, trend as T, usage as U
from costweave.sources import billing_table as L
from costweave.sources.period import Period
from costweave.sources.sample import lineitem_rows

MAR = Period.month(1998, 3)
SPAN = Period.span((1997, 12), (1998, 3))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    L.write_billing(lineitem_rows(spark, "/root/testdata/sf0.001"), root)
    return L.read_billing(spark, root, ntz=True)


def executed(df):
    """Text of the executed plan; code-generated scans are marked ``*(n) ColumnarToRow``."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """How many table scans really ran, reused ones not counted."""
    return len(re.findall(r"\*\(\d+\) ColumnarToRow", executed(df)))


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


SHARES = [lambda d: B.cost_by_service(d, MAR), lambda d: B.cost_by_resource(d, MAR),
          lambda d: B.cost_by_tag(d, MAR), lambda d: B.cost_by_team_env(d, MAR),
          lambda d: T.top_drivers(d, (1998, 2), (1998, 3)),
          lambda d: K.commitment_utilisation(d, MAR)]


@pytest.mark.parametrize("make", SHARES)
def test_grand_totals_reuse_the_scan(table, make):
    df = make(table)
    assert scans(df) == 1
    plan = executed(df)
    assert "ReusedExchange" in plan and "Window" not in plan


ALL = SHARES + [
    lambda d: B.cost_by_account(d, MAR), lambda d: B.cost_by_service_pruned(d, MAR),
    lambda d: B.type_contribution(d, MAR), lambda d: T.mom_trend(d, SPAN),
    lambda d: T.mom_trend(d, SPAN, spine=True), lambda d: T.anomalies(d, SPAN),
    lambda d: T.daily_series(d, MAR, "AmazonEC2", spine=True),
    lambda d: T.top_drivers(d, (1998, 2), (1998, 3), method="join"),
    lambda d: K.commitment_coverage(d, MAR), lambda d: U.data_transfer(d, MAR),
    lambda d: U.s3_categories(d, MAR), lambda d: R.reconcile(d, SPAN), Q.health_report,
    Q.check_duplicates, Q.check_population]


@pytest.mark.parametrize("make", ALL)
def test_no_cross_join_global_window_or_python(table, make):
    plan = make(table)._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan
    for window in re.findall(r"Window \[.*", plan):
        assert re.search(r"windowspecdefinition\((?!\w+#\d+ (?:ASC|DESC))", window), window


def test_partition_and_row_group_filters(table):
    df = T.daily_cost(table, MAR, "AmazonEC2")
    plan = formatted(df)
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = 1998[^\]]*month#\d+ = 03", plan)
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "line_item_product_code,AmazonEC2" in pushed
    assert "GreaterThanOrEqual(line_item_usage_start_date" in pushed


def test_only_needed_columns_are_read(table):
    df = B.cost_by_service_pruned(table, MAR)
    scan = df._jdf.queryExecution().optimizedPlan().toString()
    plan = df._jdf.queryExecution().executedPlan().toString()
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1).split(",")
    assert len(columns) == 9, (columns, scan)


def test_top_k_is_not_a_full_sort(table):
    plan = executed(B.cost_by_resource(table, MAR))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_transfer_filter_reaches_the_scan(table):
    plan = formatted(U.data_transfer(table, MAR))
    assert "StringContains(line_item_usage_type,Bytes)" in plan


def test_utilisation_scans_once(table):
    assert scans(K.commitment_utilisation(table, MAR)) == 1
    assert scans(K.commitment_utilisation_by_arn(table, MAR)) == 1
    assert scans(Q.health_report(table)) == 1
    assert scans(T.top_drivers(table, (1998, 2), (1998, 3), method="join")) > 1


def test_audit_needs_no_shuffle(spark):
    df = audit(spark.createDataFrame([(1, "SELECT 1")], "query_id int, sql_text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_total_row_needs_one_scan(spark):
    from costweave.registry.blocks import total_row

    assert scans(total_row(spark, "/root/testdata/sf0.001")) == 1
