"""What executed scans read, held against the files that lie there."""

import glob
import os

import pytest
from costweave.checks import compare
from costweave.operators import breakdown as B, commitments as K, trend as T
from costweave.plans.scans import Scanned, scanned, scanned_by_side
from costweave.sources import billing_table as L
from costweave.sources.period import Period
from pyspark.sql import functions as F
from rows import billing, dicts

MAR = Period.month(1998, 3)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scans"))
    rows = [{"at": f"{y}-{m:02d}-{d:02d}", "cost": float(d), "product": p}
            for y in (1997, 1998) for m in range(1, 13) for d in (1, 15) for p in ("AmazonEC2", "AmazonS3", None)]
    L.write_billing(billing(spark, rows), root)
    # One month in several files.
    L.write_partitioned(billing(spark, [r for r in rows if r["at"].startswith("1998-03")]), root,
                        max_records_per_file=2)
    return root


def listed(root, period=None):
    paths = [root] if period is None else period.paths(root)
    files = [f for p in paths for f in glob.glob(f"{p}/**/*.parquet", recursive=True)]
    return len(files), sum(map(os.path.getsize, files))


def test_scans_are_those_of_the_listing(spark, lake):
    df = L.read_billing(spark, lake, ntz=True)
    march = T.daily_cost(df, MAR)
    march.collect()
    files, size = listed(lake, MAR)
    assert files == 3
    assert scanned(march) == Scanned(files, 1, size, 6)
    whole = df.groupBy("line_item_product_code").count()
    whole.collect()
    assert scanned(whole) == Scanned(*listed(lake)[:1], 24, listed(lake)[1], 144)
    nothing = df.where("year = '1900'").select("month")
    nothing.collect()
    assert scanned(nothing) == Scanned()


def test_reused_scans_and_subqueries_are_seen(spark, lake):
    df = B.cost_by_service(L.read_billing(spark, lake, ntz=True), MAR)      # the total reuses the shuffle
    df.collect()
    assert scanned(df).files in (3, 6)
    sides = df.select("service").union(L.read_billing(spark, lake, ntz=True).select(B.PRODUCT))
    sides.collect()
    assert [s.files for s in scanned_by_side(sides)][1] == listed(lake)[0]
    with pytest.raises(ValueError, match="no union"):
        scanned_by_side(spark.range(1))


@pytest.mark.parametrize("operator", [T.monthly_cost, B.cost_by_service_pruned, K.commitment_coverage])
def test_pruned_reads_fewer_files(spark, lake, operator):
    keys, files = dicts(compare.check_pruning(L.read_billing(spark, lake, ntz=True), MAR, operator))
    assert keys["ok"] and keys["observed"] == 0
    assert files["ok"] and files["observed"] == listed(lake, MAR)[0]
    assert files["detail"] == f"of {listed(lake)[0]} files without pruning"


def test_nothing_to_prune(spark, lake, tmp_path):
    both = Period.span((1997, 1), (1998, 12))
    _, files = dicts(compare.check_pruning(L.read_billing(spark, lake, ntz=True), both, T.monthly_cost))
    assert files["ok"] and files["observed"] == listed(lake)[0]
    flat = f"{tmp_path}/flat"
    L.read_billing(spark, lake, ntz=True).coalesce(1).write.parquet(flat)   # year and month are columns, no folders
    _, files = dicts(compare.check_pruning(spark.read.parquet(flat), MAR, T.monthly_cost))
    assert not files["ok"] and files["detail"] == "of 1 files without pruning"


def test_a_filter_on_other_columns_prunes_nothing(spark, lake):
    """An operator that forgets the partition predicate is found out."""
    forgetful = lambda df, period: (df.where(period.instants(df)).groupBy(B.PRODUCT)
                                    .agg(F.sum("line_item_unblended_cost").alias("cost")))
    keys, files = dicts(compare.check_pruning(L.read_billing(spark, lake, ntz=True), MAR, forgetful))
    assert keys["ok"] and files["observed"] == listed(lake)[0]
    keys, files = dicts(compare.check_pruning(L.read_billing(spark, lake, ntz=True), MAR,
                                              lambda df, p: df.where(p.partitions()).groupBy(B.PRODUCT).count()))
    assert not keys["ok"] and files["ok"]


def test_a_missing_amount_is_not_zero(spark):
    left = spark.createDataFrame([("a", 0.0), ("b", None)], "k string, v double")
    right = spark.createDataFrame([("a", None), ("b", None)], "k string, v double")
    assert [r.k for r in compare.differing_keys(left, right).collect()] == ["a"]
