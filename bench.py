"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the sample directory, BENCH_CPUS the local cores. Every query is run to
the end with a sink that discards its rows. The first run of each warms the JVM and is not
counted. ``lake_*`` queries read the same rows from a month-partitioned table that is written
once before timing; its writing time is reported as ``write_lake``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from costweave.checks import quality as Q
from costweave.operators import breakdown as B, commitments as K, reconcile as R, trend as T
from costweave.registry import all_entries
from costweave.registry.sqlbase import FULL, MONTH, TWO_MONTHS
from costweave.registry.storage import lake, whole
from costweave.session import with_settings

HEADLINE = """
month_probe cost_by_service cost_by_account mom_trend top_drivers top_drivers_joined
cost_by_resource cost_by_tag cost_by_team_env daily_series anomalies commitment_coverage
commitment_utilisation data_transfer s3_categories cost_by_service_pruned reconcile
type_contribution health_report check_duplicates check_savings_plan_balance check_contract
audit_summary
""".split()

LAKE = {
    "lake_cost_by_service": lambda d: B.cost_by_service(d, FULL),
    "lake_cost_by_resource": lambda d: B.cost_by_resource(d, FULL),
    "lake_one_month": lambda d: B.cost_by_service_pruned(d, MONTH),
    "lake_anomalies_two_months": lambda d: T.anomalies(d, TWO_MONTHS),
    "lake_utilisation": lambda d: K.commitment_utilisation(d, FULL),
    "lake_reconcile": lambda d: R.reconcile(d, FULL),
    "lake_health_report": Q.health_report,
}


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (with_settings(SparkSession.builder).master(f"local[{cpus}]")
             .appName("costweave-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make) -> float:
    start = time.time()
    frame: DataFrame = make()
    frame.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    queries = all_entries().queries
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        def make(name=name):
            return queries[name](spark, sf_dir)
        timed(make)
        seconds[name] = round(timed(make), 3)
    start = time.time()
    lake(spark, sf_dir)
    seconds["write_lake"] = round(time.time() - start, 3)
    for name, operator in LAKE.items():
        def make(operator=operator):
            return operator(whole(spark, sf_dir))
        timed(make)
        seconds[name] = round(timed(make), 3)
    print(json.dumps({"metric": "billing headline queries, total wall time",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
