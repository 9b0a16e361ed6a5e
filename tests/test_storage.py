"""Reading and writing the partitioned table, legacy deliveries, rollups."""

import datetime as dt
import os

import pytest
from costweave.operators import breakdown as B, commitments as K, trend as T
from costweave.plans import rollups as R
from costweave.schema import CONTRACT, contract
from costweave.sources import billing_table as L, legacy_csv as V
from costweave.sources.period import Period
from costweave.sources.scratch import scratch_path
from pyspark.errors import AnalysisException
from rows import billing, dicts

MAR = Period.month(1998, 3)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    rows = [{"at": f"{y}-{m:02d}-{d:02d}", "cost": float(d), "product": p}
            for y in (1997, 1998) for m in range(1, 13) for d in (1, 15)
            for p in ("AmazonEC2", "AmazonS3", None)]
    L.write_billing(billing(spark, rows).drop("bill_invoice_id", "product_region"), root)
    return root


def files_read(df):
    """Number of files the scans of an executed plan opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_partitions_stay_text_and_absent_columns_are_null(spark, lake):
    df = L.read_billing(spark, lake, ntz=True)
    assert df.columns == CONTRACT.names
    assert df.schema["year"].dataType.simpleString() == "string"
    assert df.where("month = '03'").count() == 12
    assert df.where("month = '3'").count() == 0
    assert df.where("bill_invoice_id IS NOT NULL").count() == 0


def test_a_month_reads_one_file(spark, lake):
    df = L.read_billing(spark, lake, ntz=True)
    cost = "line_item_unblended_cost"
    assert files_read(MAR.scope(df).select(cost)) == 1
    assert files_read(df.select(cost)) == 24
    straddle = Period.span((1997, 12), (1998, 1))
    assert files_read(straddle.scope(df).select(cost)) == 2
    assert files_read(df.where(MAR.instants(df)).select(cost)) == 24, "a time range alone prunes nothing"


def test_month_paths(spark, lake):
    df = L.read_months(spark, lake, Period.span((1997, 12), (1998, 1)), ntz=True)
    assert sorted({(r.year, r.month) for r in df.select("year", "month").collect()}) == [
        ("1997", "12"), ("1998", "01")]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        L.read_months(spark, lake, Period.month(1999, 1), ntz=True)


def test_optional_and_extra_columns(spark, lake):
    df = L.read_billing(spark, lake, ("net",), {"cost_category_team": "string"}, ntz=True)
    assert df.schema["line_item_net_unblended_cost"].dataType.simpleString() == "double"
    assert df.columns[-2:] == ["year", "month"]
    wide = L.widen(df, {"resource_tags_user_x": "string", "line_item_unblended_cost": "double"})
    assert len(wide.columns) == len(df.columns) + 1
    assert "line_item_net_unblended_rate" in contract(("net",)).names


def test_redelivered_month_replaces_only_itself(spark, tmp_path):
    root = str(tmp_path / "t")
    L.write_billing(billing(spark, [{"at": "1998-02-05", "cost": 1.0}, {"at": "1998-03-05"}]), root)
    L.write_billing(billing(spark, [{"at": "1998-03-06", "cost": 7.0}]), root)
    df = L.read_billing(spark, root, ntz=True)
    assert sorted((r.month, r.line_item_unblended_cost) for r in df.collect()) == [
        ("02", 1.0), ("03", 7.0)]


def test_a_big_month_is_not_one_file(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = billing(spark, [{}]).crossJoin(spark.range(5000)).drop("id")
    L.write_partitioned(rows, root, max_records_per_file=1000)
    assert len([f for f in os.listdir(f"{root}/year=1998/month=03") if f.endswith(".parquet")]) >= 5


def test_zoned_timestamps_need_utc(spark, lake):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        with pytest.raises(ValueError, match="UTC"):
            L.read_billing(spark, lake)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert L.read_billing(spark, lake).schema["bill_billing_period_end_date"].dataType.simpleString() == "timestamp"


@pytest.mark.parametrize("header,name", [
    ("lineItem/UnblendedCost", "line_item_unblended_cost"),
    ("lineItem/LineItemType", "line_item_line_item_type"),
    ("bill/PayerAccountId", "bill_payer_account_id"),
    ("product/instanceType", "product_instance_type"),
    ("resourceTags/user:Team", "resource_tags_user_team"),
    ("resourceTags/user:cost-center", "resource_tags_user_cost_center"),
    ("resourceTags/user:Cost Center", "resource_tags_user_cost_center"),
    ("reservation/EffectiveCost", "reservation_effective_cost"),
    ("reservation/ReservationARN", "reservation_reservation_a_r_n"),
    ("savingsPlan/SavingsPlanEffectiveCost", "savings_plan_savings_plan_effective_cost"),
    ("pricing/publicOnDemandCost", "pricing_public_on_demand_cost"),
])
def test_header_names(header, name):
    assert V.column_name(header) == name


def test_clashing_headers():
    with pytest.raises(ValueError, match="cost_center"):
        V.column_names(["resourceTags/user:cost-center", "resourceTags/user:cost_center"])


def test_csv_delivery_to_table(spark, tmp_path):
    source, root = tmp_path / "report.csv", str(tmp_path / "t")
    source.write_text(
        "lineItem/UsageStartDate,lineItem/UnblendedCost,lineItem/UsageAmount,resourceTags/user:Team,"
        "lineItem/LineItemDescription,unknown/Thing\n"
        '1998-03-01T00:00:00Z,1.5,2,core,"a, ""quoted"" text",x\n'
        "1998-03-31T23:00:00Z,oops,,,,y\n"
        "1998-04-01T00:00:00Z,3,4,data,,z\n")
    raw = V.read_legacy_csv(spark, str(source))
    report = {r["column_name"]: (r["filled"], r["bad_values"]) for r in dicts(V.conversion_report(raw))}
    assert report == {"line_item_usage_start_date": (3, 0), "line_item_unblended_cost": (3, 1),
                      "line_item_usage_amount": (2, 0)}
    V.convert_legacy_csv(spark, str(source), root)
    df = L.read_billing(spark, root)
    march = sorted(dicts(MAR.scope(df)), key=lambda r: r["line_item_usage_start_date"])
    assert [r["line_item_unblended_cost"] for r in march] == [1.5, None]
    assert march[0]["line_item_line_item_description"] == 'a, "quoted" text'
    assert march[1]["resource_tags_user_team"] is None
    assert df.where("month = '04'").count() == 1


def test_map_typed_tags(spark):
    df = billing(spark, [{}]).selectExpr("*", "map('Team', 'core', 'cost-center', '7') AS tags")
    (row,) = dicts(L.flatten_map(df, "tags", ["Team", "cost-center", "Owner"], "tag_"))
    assert (row["tag_team"], row["tag_cost_center"], row["tag_owner"]) == ("core", "7", None)


ROWS = [{"at": "1998-02-05", "cost": 10.0, "resource": "a"},
        {"at": "1998-03-05", "cost": 30.0, "resource": "a"},
        {"at": "1998-03-06", "cost": 3.0, "resource": None, "product": None},
        {"at": "1998-04-01", "month": "03", "cost": 99.0},
        {"at": "1998-03-07", "type": "RIFee", "ri": "r", "ri_recurring": 4.0,
         "reservation_unused_recurring_fee": 1.0},
        {"at": "1998-03-08", "type": "DiscountedUsage", "ri": "r", "ri_effective": 4.0}]


def test_reports_from_rollups_equal_direct_ones(spark, tmp_path):
    df, period = billing(spark, ROWS), Period.span((1998, 2), (1998, 3))

    def stored(name):
        path = str(tmp_path / name)
        R.refresh(df, name, path)
        return spark.read.schema(R.ROLLUPS[name](df).schema).parquet(path)

    assert dicts(R.mom_trend_from(stored("service_month"), period)) == dicts(T.mom_trend(df, period))
    assert (dicts(R.cost_by_resource_from(stored("resource_month"), MAR))
            == dicts(B.cost_by_resource(df, MAR)))
    loose = dict(min_days=1, min_mean=0.0, pct=0.0)
    assert (dicts(R.anomalies_from(stored("service_day"), period, **loose))
            == dicts(T.anomalies(df, period, **loose)))
    assert (dicts(R.commitment_utilisation_from(stored("commitment_month"), MAR))
            == dicts(K.commitment_utilisation(df, MAR)))


def test_refreshing_one_month_of_a_rollup(spark, tmp_path):
    path = str(tmp_path / "r")
    R.refresh(billing(spark, ROWS), "service_month", path)
    late = billing(spark, ROWS + [{"at": "1998-03-30", "cost": 100.0, "product": "Late"},
                                  {"at": "1998-02-20", "product": "Ignored"}])
    R.refresh(late, "service_month", path, MAR)
    services = {(r["month"], r["service"]) for r in dicts(spark.read.parquet(path).selectExpr(
        "lpad(month, 2, '0') AS month", "service"))}
    assert ("03", "Late") in services and ("02", "AmazonEC2") in services
    assert ("02", "Ignored") not in services


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path.endswith("/x") and (base is None or path.startswith(base.rstrip("/")))
    assert scratch_path(spark, "x") != path


def test_csv_files_of_different_headers(spark, tmp_path):
    """Another column order and another column in the second file; a tag with a dash is kept on request."""
    (tmp_path / "a.csv").write_text("lineItem/UsageStartDate,lineItem/ProductCode,lineItem/UnblendedCost\n"
                                    "2024-03-01T00:00:00Z,Box,1.5\n")
    (tmp_path / "b.csv").write_text("resourceTags/user:cost-center,lineItem/UnblendedCost,lineItem/UsageStartDate,"
                                    "lineItem/ProductCode,own/Thing\nred,2.5,2024-03-02T00:00:00Z,Crate,x\n")
    from costweave.sources import legacy_csv as V

    delivered = V.read_legacy_csv(spark, str(tmp_path))
    kept = {"resource_tags_user_cost_center": "string"}
    rows = V.from_legacy(delivered, extra=kept).orderBy("line_item_product_code").collect()
    assert [(r.line_item_product_code, r.line_item_unblended_cost, r.resource_tags_user_cost_center) for r in rows] == [
        ("Box", 1.5, None), ("Crate", 2.5, "red")]
    assert V.unconverted_headers(delivered, extra=kept) == {"own/Thing": "own_thing"}


def test_refresh_of_a_month_without_rows_any_more(spark, tmp_path):
    from costweave.plans import rollups as R
    from costweave.sources.period import Period
    from rows import billing

    root = str(tmp_path / "commitments")
    fee = {"type": "RIFee", "at": "2024-03-05"}
    first = billing(spark, [fee, fee | {"at": "2024-04-05"}])
    R.refresh(first, "commitment_month", root)
    assert spark.read.parquet(root).count() == 2
    again = billing(spark, [{"type": "Usage", "at": "2024-03-05"}])
    R.refresh(again, "commitment_month", root, Period.month(2024, 3))
    assert [r.month for r in spark.read.parquet(root).select("month").collect()] in (["04"], [4])


def _service_rows(spark, root):
    return sorted((str(r.year), f"{int(r.month):02d}", r.service or "", r.line_items) for r in spark.read.parquet(root).collect())


def test_changed_months_are_found_and_only_they_are_read(spark, tmp_path):
    from costweave.plans import rollups as R

    source, root = f"{tmp_path}/billing", f"{tmp_path}/service_month"
    row = lambda at, n: [{"at": at, "cost": 1.0}] * n
    L.write_billing(billing(spark, row("1998-01-05", 2) + row("1998-02-05", 3) + row("1998-03-05", 4)), source)
    refresh = lambda: R.refresh_changed(spark, source, "service_month", root, ntz=True)
    assert refresh() == [(1998, 1), (1998, 2), (1998, 3)] and refresh() == []
    L.write_billing(billing(spark, row("1998-02-05", 7) + row("1998-04-05", 1)), source)
    # Were another month read, this broken file of it would be noticed; its listing is as it was.
    import glob
    import os
    (january,) = glob.glob(f"{source}/year=1998/month=01/*.parquet")
    state = os.stat(january)
    whole_file = open(january, "rb").read()
    with open(january, "r+b") as f:
        f.write(b"\0" * 8)
    crc = os.path.join(os.path.dirname(january), f".{os.path.basename(january)}.crc")
    if os.path.exists(crc):
        os.unlink(crc)
    os.utime(january, ns=(state.st_atime_ns, state.st_mtime_ns))
    assert refresh() == [(1998, 2), (1998, 4)] and refresh() == []
    assert _service_rows(spark, root) == [("1998", "01", "AmazonEC2", 2), ("1998", "02", "AmazonEC2", 7),
                                          ("1998", "03", "AmazonEC2", 4), ("1998", "04", "AmazonEC2", 1)]
    with open(january, "wb") as f:
        f.write(whole_file)
    assert (1998, 1) in refresh()
    # A month taken away loses its rows.
    for f in glob.glob(f"{source}/year=1998/month=03/*"):
        os.unlink(f)
    assert refresh() == [(1998, 3)]
    assert [r[1] for r in _service_rows(spark, root)] == ["01", "02", "04"]


def test_a_failed_refresh_is_made_up_for(spark, tmp_path, monkeypatch):
    from costweave.plans import rollups as R

    source, root = f"{tmp_path}/billing", f"{tmp_path}/service_month"
    L.write_billing(billing(spark, [{"at": "1998-01-05"}]), source)
    whole_refresh = R.refresh
    monkeypatch.setattr(R, "refresh", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        R.refresh_changed(spark, source, "service_month", root, ntz=True)
    monkeypatch.setattr(R, "refresh", whole_refresh)
    assert R.refresh_changed(spark, source, "service_month", root, ntz=True) == [(1998, 1)]


def test_sketches_merge_within_their_error(spark, tmp_path):
    from costweave.operators.reconcile import reconcile
    from costweave.plans import rollups as R
    from pyspark.sql import functions as F

    months = Period.span((1998, 1), (1998, 2))
    base = billing(spark, [{"at": "1998-01-05"}, {"at": "1998-02-05"}, {"at": "1998-02-05", "account": None}])
    wide = base.crossJoin(spark.range(30_000)).withColumns({
        "line_item_usage_account_id": F.when(F.col("line_item_usage_account_id").isNotNull(),
                                             F.concat("month", F.lit("-"), F.col("id") % 20_000)),
        "line_item_resource_id": (F.col("id") % 7).cast("string")}).drop("id")
    R.refresh(wide, "reconcile_month", f"{tmp_path}/r")
    stored = spark.read.schema(R.reconcile_month(base).schema).parquet(f"{tmp_path}/r")
    exact = {r.usage_month: r for r in reconcile(wide, months).collect()}
    for row in R.reconcile_from(stored, months).collect():
        want = exact[row.usage_month]
        assert abs(row.distinct_accounts / want.distinct_accounts - 1) < 0.05
        assert row.distinct_products == want.distinct_products and row.line_items == want.line_items
        assert row.unblended_all_types == want.unblended_all_types
    (one,) = R.distinct_from(stored, months).collect()
    assert abs(one.distinct_accounts / 40_000 - 1) < 0.05 and one.distinct_resources == 7
    assert stored.count() == 2                                    # a row a month, whatever the number of accounts


def test_billing_rows_are_shuffled_and_sorted_before_they_are_widened(spark, tmp_path):
    from costweave.session import HUGE_METHOD
    from costweave.sources import sample
    from costweave.sources.billing_table import write_billing

    (spark.createDataFrame([(k, 7 * k, 3 * k, 1 + k % 7, float(k), 10.5 * k, 0.0, 0.0, "A", "F",
                             None if k == 5 else dt.datetime(1998, 1 + k % 3, 1 + k % 28)) for k in range(90)],
                           sample.LINEITEM_SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet"))
    rows, placed, plans = sample.lineitem_rows(spark, tmp_path), sample.lineitem_placed(spark, tmp_path), []
    assert sample.lineitem_widened(placed).schema == rows.schema
    assert sorted(map(str, sample.lineitem_widened(placed).collect())) == sorted(map(str, rows.collect()))

    def widened(lying):
        plans.append((lying._jdf.queryExecution().optimizedPlan().toString(), lying.columns))
        return sample.lineitem_widened(lying)

    own = spark.conf.get(HUGE_METHOD)
    write_billing(placed, f"{tmp_path}/narrow", widened)
    write_billing(rows, f"{tmp_path}/wide")
    assert spark.conf.get(HUGE_METHOD) == own
    (plan, columns), = plans
    assert "Sort [" in plan and "RebalancePartitions" in plan and "pricing_public_on_demand_cost" not in columns
    assert len(columns) < len(rows.columns) / 2
    narrow, wide = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("narrow", "wide"))
    assert sorted(narrow.columns) == sorted(wide.columns) == sorted(rows.columns)
    assert sorted(map(str, narrow.select(rows.columns).collect())) == sorted(map(str, wide.select(rows.columns).collect()))
