"""Published rollups, window state, schema drift, sifted duplicates and headers found in one job."""

import pytest
from costweave.checks import contract, quality as Q
from costweave.operators import trend as T
from costweave.plans import rollups as R, versions as P, window_state as W
from costweave.plans.scans import scanned, shuffled, whole_plans
from costweave.sources import billing_table as L, legacy_csv as V
from costweave.sources.period import Period
from pyspark.sql import functions as F
from rows import billing, dicts

FEB, MAR = Period.month(1998, 2), Period.month(1998, 3)
ROWS = [{"at": "1998-02-05", "cost": 10.0}, {"at": "1998-03-05", "cost": 30.0}, {"at": "1998-03-06", "product": None}]


def services(spark, root, version=None, period=None):
    schema = R.service_month(billing(spark, [])).schema
    return sorted((r.month, r.service or "", r.amortized_cost)
                  for r in P.published(spark, root, schema, version, period).collect())


def test_versions_are_whole_and_keep_other_months(spark, tmp_path):
    root = str(tmp_path / "r")
    assert P.versions(spark, root) == [] and services(spark, root) == []
    assert P.publish(billing(spark, ROWS), "service_month", root) == 1
    assert P.publish(billing(spark, [{"at": "1998-03-07", "cost": 5.0}, ROWS[0]]), "service_month", root, MAR) == 2
    assert services(spark, root) == [("02", "AmazonEC2", 10.0), ("03", "AmazonEC2", 5.0)]
    assert services(spark, root, 1) == [("02", "AmazonEC2", 10.0), ("03", "", 1.0), ("03", "AmazonEC2", 30.0)]
    assert services(spark, root, period=FEB) == [("02", "AmazonEC2", 10.0)]
    P.publish(billing(spark, []), "service_month", root, MAR)
    assert services(spark, root) == [("02", "AmazonEC2", 10.0)], "a month without rows any more is gone"
    with pytest.raises(ValueError, match="no finished version 9"):
        services(spark, root, 9)


def test_a_failing_refresh_leaves_the_old_rows(spark, tmp_path):
    root = str(tmp_path / "r")
    P.publish(billing(spark, ROWS), "service_month", root)
    old = services(spark, root)
    cost = "line_item_unblended_cost"
    broken = billing(spark, ROWS).withColumn(
        cost, F.when(F.col(cost) == 30, F.raise_error("torn file").cast("double")).otherwise(7.0))
    with pytest.raises(Exception, match="torn file"):
        P.publish(broken, "service_month", root).real
    assert P.versions(spark, root) == [1] and services(spark, root) == old
    # A listing that was not finished does not count, and its number is not taken again.
    (tmp_path / "r" / "listings" / "2").mkdir()
    assert services(spark, root) == old
    assert P.publish(billing(spark, ROWS[:1]), "service_month", root) == 3


def test_forgotten_versions(spark, tmp_path):
    root = str(tmp_path / "r")
    P.publish(billing(spark, ROWS), "service_month", root)
    for cost in (2.0, 3.0):
        P.publish(billing(spark, [{"at": "1998-03-07", "cost": cost}]), "service_month", root, MAR)
    now, last = services(spark, root), services(spark, root, 2)
    P.forget(spark, root, keep=2)
    assert P.versions(spark, root) == [2, 3]
    assert services(spark, root) == now and services(spark, root, 2) == last
    assert len(P.forget(spark, root, keep=1)) == 2, "a listing and one March"
    assert services(spark, root) == now and P.forget(spark, root, keep=1) == []
    with pytest.raises(ValueError):
        P.forget(spark, root, keep=0)


def days(spark):
    rows = [{"at": f"1998-{m:02d}-{d:02d}", "cost": float(10 + (m * d) % 7 + 90 * (d == 9 and m == 3)), "product": p}
            for m in (1, 2, 3, 4) for d in range(1, 29, 2 if m == 2 else 1) for p in ("AmazonEC2", None)]
    return R.service_day(billing(spark, rows + [{"at": "1998-01-02", "cost": 5.0, "product": "Rare"}]))


@pytest.mark.parametrize("windows", [{}, {"window_days": 14, "same_weekday_rows": 3}])
def test_months_appended_give_what_a_full_run_gives(spark, tmp_path, windows):
    root, daily = str(tmp_path / "s"), days(spark)
    W.start(daily, root, Period.span((1998, 1), (1998, 1)), **windows)
    got = [r for m in (2, 3, 4) for r in W.anomalies_next(daily, root, (1998, m), min_days=3, pct=20.0, **windows).collect()]
    # The same days in the order of the whole, whose sums have the same addends.
    full = T.anomalies_of(daily.groupBy("service", "usage_date").agg(F.sum("amortized_cost").alias("amortized_cost")),
                          min_days=3, pct=20.0, **windows)
    want = [r for r in full.collect() if r.usage_date.month > 1]
    key = lambda r: (r.service or "", r.usage_date)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 5
    with pytest.raises(ValueError, match="no state"):
        W.anomalies_next(daily, root, (1999, 3))


def test_an_appended_month_reads_only_itself(spark, tmp_path):
    root, state = str(tmp_path / "daily"), str(tmp_path / "s")
    daily = days(spark)
    L.write_partitioned(daily, root, ["service"])
    kept = spark.read.schema(daily.schema).parquet(root)
    W.start(kept, state, Period.span((1998, 1), (1998, 2)))
    df = W.anomalies_next(kept, state, (1998, 3))
    df.collect()
    assert scanned(df).partitions == 2, "March, and the state at the end of February"


def test_schema_drift(spark, tmp_path):
    root = str(tmp_path / "t")
    L.write_billing(billing(spark, [{"at": f"1998-{m:02d}-05"} for m in (1, 2, 3)]), root)
    cost = "line_item_unblended_cost"
    L.write_billing(billing(spark, [{"at": "1998-02-05"}]).withColumn(cost, F.col(cost).cast("string"))
                    .drop("resource_tags_user_team").withColumn("own_thing", F.lit(1)), root)
    found = {(r["subject"], r["severity"], r["detail"]) for r in dicts(contract.check_schema_drift(spark, root)) if not r["ok"]}
    assert found == {
        ("1998-02 line_item_unblended_cost", "error", "double became string"),
        ("1998-02 resource_tags_user_team", "error", "vanished, was string"),
        ("1998-02 own_thing", "warning", "new, int"),
        ("1998-03 line_item_unblended_cost", "error", "string became double"),
        ("1998-03 resource_tags_user_team", "warning", "new, string"),
        ("1998-03 own_thing", "warning", "vanished, was int")}
    assert contract.column_states(spark.read.parquet(f"{root}/year=1998/month=01"))[cost][0] == "declared"
    ok = [r["subject"] for r in dicts(contract.check_schema_drift(spark, root)) if r["ok"]]
    assert ok == ["1998-01"]


def test_first_month_is_held_against_the_contract(spark, tmp_path):
    root, cost = str(tmp_path / "t"), "line_item_unblended_cost"
    L.write_billing(billing(spark, [{}]).withColumn(cost, F.col(cost).cast("string")), root)
    (row,) = dicts(contract.check_schema_drift(spark, root))
    assert row["detail"] == "declared double, found string" and not row["ok"]


def test_contract_of_a_period(spark):
    df = billing(spark, [{"at": "1998-02-05", "team": "core"}, {"at": "1998-03-05"}])
    filled = {p: {r["subject"]: r["observed"] for r in dicts(contract.check_contract(df, p))} for p in (None, FEB, MAR)}
    team = "resource_tags_user_team"
    assert [filled[p][team] for p in (None, FEB, MAR)] == [0.5, 1.0, 0.0]


def test_sifted_duplicates_are_the_duplicates(spark):
    rows = [{"id": f"id-{i % 300}" if i < 400 else None, "at": f"1998-{2 + i % 2:02d}-05"} for i in range(420)]
    df = billing(spark, rows + [{"id": "hot"}] * 500)
    for period in (None, MAR):
        plain = sorted(map(str, Q.duplicate_line_items(df, period).collect()))
        for size, sent in ((1, 4_000_000), (10, 4_000_000), (10_000, 4_000_000), (1, 0)):
            assert sorted(map(str, Q.duplicate_line_items(df, period, True, size, sent).collect())) == plain
        assert len(plain) > 40
    assert Q.duplicate_line_items(billing(spark, []), sift=True).collect() == []


def test_sifting_shuffles_under_a_tenth_where_nothing_is_double(spark, tmp_path):
    root = str(tmp_path / "t")
    many = billing(spark, [{}]).drop("identity_line_item_id").crossJoin(spark.range(60_000)).withColumn(
        "identity_line_item_id", F.sha2(F.col("id").cast("string"), 256)).drop("id")
    L.write_billing(many, root)
    df = L.read_billing(spark, root, ntz=True)
    plain, sifted, first = Q.duplicate_line_items(df), Q.duplicate_line_items(df, sift=True), Q.suspected_buckets(df, 6)
    with whole_plans(spark):
        assert plain.collect() == sifted.collect() == [] and first.count() <= 1
        first.collect()
        assert 0 < 10 * (shuffled(first) + shuffled(sifted)) < shuffled(plain)


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    folder = tmp_path / "a delivery, 100%"
    (folder / "inner").mkdir(parents=True)
    for i in range(60):
        names = ["lineItem/ProductCode", "lineItem/UnblendedCost"][::1 if i % 2 else -1]
        cells = ["Box", "1.5"][::1 if i % 2 else -1]
        (folder / ("inner" if i % 3 else ".") / f"part {i}.csv").write_text(
            "\n" * (i % 4) + ",".join(names) + "\n" + (",".join(cells) + "\n") * i)
    (folder / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "")
    try:
        read = V.read_legacy_csv(spark, str(folder))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = read.groupBy("lineItem/ProductCode", "lineItem/UnblendedCost").count().collect()
    assert [tuple(r) for r in rows] == [("Box", "1.5", sum(range(60)))]
    assert len(jobs) <= 6, "one look at all lines, and one at the columns of each of two headers"
    with pytest.raises(ValueError, match="no files with a header"):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.csv").write_text("\n")
        V.read_legacy_csv(spark, str(tmp_path / "none"))
