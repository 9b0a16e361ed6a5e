"""Rollups that are published whole: readers see the months of one version or of the next, never a mixture.

A refresh writes its months beside those that lie there, under a name of its own, and then a listing that
says for every month which name holds it. A listing counts once Spark has marked it as finished, so a
refresh that fails or is running changes nothing for readers.

    root/data/part=<name>/year=YYYY/month=MM/…    rows
    root/listings/<number>/                       year, month, part of one version
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from costweave.plans.rollups import ROLLUPS, SORT_KEYS, _files, _store
from costweave.sources.billing_table import write_partitioned
from costweave.sources.period import Period

LISTING = "year string, month string, part string"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions, oldest first."""
    names = _files(spark, f"{root}/listings")
    return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in _files(spark, f"{root}/listings/{n}"))


def listing(spark: SparkSession, root: str, version: int | None = None) -> dict[tuple[str, str], str]:
    """(year, month) -> part of a version, the newest if none is named; a row a month."""
    known = versions(spark, root)
    if version is None and not known:
        return {}
    if version is not None and version not in known:
        raise ValueError(f"no finished version {version} under {root}")
    rows = spark.read.schema(LISTING).parquet(f"{root}/listings/{known[-1] if version is None else version}").collect()
    return {(r.year, r.month): r.part for r in rows}


def _months(spark: SparkSession, folder: str) -> set[tuple[str, str]]:
    """The months that a refresh wrote, from the names of its folders."""
    split = lambda names, key: [n.partition("=")[2] for n in names if n.startswith(f"{key}=")]
    return {(y, m) for y in split(_files(spark, folder), "year")
            for m in split(_files(spark, f"{folder}/year={y}"), "month")}


def publish(df: DataFrame, name: str, root: str, period: Period | None = None) -> int:
    """Rebuild one rollup for the months of ``period``, or all, as a new version; returns its number.

    Months outside the period are taken over from the newest version, without reading or copying them.
    A month of the period that gives no rows any more is not in the new version. One writer at a time:
    a number that another writer has taken meanwhile raises, and the old version stays.
    """
    spark = df.sparkSession
    before, part = listing(spark, root), uuid.uuid4().hex
    number = max([0, *(int(n) for n in _files(spark, f"{root}/listings") if n.isdigit())]) + 1
    rows = ROLLUPS[name](df if period is None else df.where(period.partitions()))
    write_partitioned(rows, f"{root}/data/part={part}", SORT_KEYS[name])
    renewed = None if period is None else {(f"{y:04d}", f"{m:02d}") for y, m in period.months}
    kept = {month: p for month, p in before.items() if renewed is not None and month not in renewed}
    now = kept | {month: part for month in _months(spark, f"{root}/data/part={part}")}
    (spark.createDataFrame([(*month, p) for month, p in sorted(now.items())], LISTING)
     .coalesce(1).write.mode("error").parquet(f"{root}/listings/{number}"))
    return number


def published(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None,
              period: Period | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named; of the months of ``period`` only those are listed.

    Paths are fixed here, so that a reader keeps the version it began with while others publish.
    """
    wanted = None if period is None else {(f"{y:04d}", f"{m:02d}") for y, m in period.months}
    folders = [f"{root}/data/part={part}/year={y}/month={m}"
               for (y, m), part in sorted(listing(spark, root, version).items()) if wanted is None or (y, m) in wanted]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*folders).select(*schema.names)


def forget(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes listings older than the newest ``keep`` and the month folders that no kept one names; returns
    the removed folders.

    What a failed refresh left is removed too, so no refresh may be running. Readers of a removed
    version fail.
    """
    if keep < 1:
        raise ValueError("at least one version must stay")
    known = versions(spark, root)
    if not known:
        return []
    held = {(part, *month) for v in known[-keep:] for month, part in listing(spark, root, v).items()}
    gone = [f"{root}/listings/{n}" for n in sorted(_files(spark, f"{root}/listings"))
            if not n.isdigit() or int(n) not in known[-keep:]]
    for name in sorted(_files(spark, f"{root}/data")):
        part, folder = name.partition("=")[2], f"{root}/data/{name}"
        months = _months(spark, folder)
        lost = {(part, *month) for month in months} - held
        if len(lost) == len(months):
            gone.append(folder)
        else:
            gone += [f"{folder}/year={y}/month={m}" for _, y, m in sorted(lost)]
    for folder in gone:
        store, place = _store(spark, folder)
        store.delete(place, True)
    return gone
