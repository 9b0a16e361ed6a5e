"""Reading, widening and writing the month-partitioned billing table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costweave.schema import CONTRACT, PARTITION_COLUMNS, contract
from costweave.session import compiled
from costweave.sources.period import Period


def _require_utc(spark: SparkSession, schema: T.StructType) -> None:
    """Zoned timestamps are cut into days and months by the session zone, so pin it."""
    if any(isinstance(f.dataType, T.TimestampType) for f in schema):
        zone = spark.conf.get("spark.sql.session.timeZone")
        if zone not in ("UTC", "Etc/UTC", "Z", "+00:00", "GMT"):
            raise ValueError(f"billing timestamps are UTC but the session zone is {zone}; "
                             "set spark.sql.session.timeZone=UTC")


def read_billing(spark: SparkSession, root: str, optional: tuple[str, ...] = (),
                 extra: dict[str, str] | None = None, ntz: bool = False) -> DataFrame:
    """Read the whole table under the declared contract.

    Declared columns that the files lack read as NULL and undeclared ones are not read.
    ``year`` and ``month`` stay strings because the schema says so, so ``month = '03'``
    works as the folders are spelled and nothing is inferred from the data.
    """
    schema = contract(optional, extra, ntz)
    _require_utc(spark, schema)
    return spark.read.schema(schema).parquet(root)


def read_months(spark: SparkSession, root: str, period: Period, optional: tuple[str, ...] = (),
                extra: dict[str, str] | None = None, ntz: bool = False) -> DataFrame:
    """Read exactly the month folders of ``period``, without listing any other.

    A folder that does not exist raises, instead of silently returning no rows.
    """
    schema = contract(optional, extra, ntz)
    _require_utc(spark, schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*period.paths(root))


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """year, month, files, bytes, newest (change of a file) and newest_file of each month folder, from
    the listing alone."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime"))
    folder = lambda key: F.regexp_extract("path", rf"/{key}=([^/]*)/", 1).alias(key)
    return (files.groupBy(folder("year"), folder("month"))
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"),
                 F.max_by("path", F.struct("modificationTime", "path")).alias("newest_file")))


def widen(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add typed NULL columns for those of ``columns`` (name -> type) the frame lacks."""
    missing = {n: F.lit(None).cast(k) for n, k in columns.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Contract columns in contract order, absent ones as typed NULL.

    Timestamps keep their own flavour; columns outside the contract are dropped unless
    named in ``extra``.
    """
    have = set(df.columns)
    return df.selectExpr(
        *[f.name if f.name in have else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}"
          for f in CONTRACT], *extra)


def flatten_map(df: DataFrame, map_column: str, keys: Iterable[str], prefix: str) -> DataFrame:
    """One column per key out of a MAP-typed column, e.g. tags delivered as a map.

    Keys are stated by the caller, so no pass over the data is needed to find them.
    """
    from costweave.sources.legacy_csv import snake

    return df.withColumns({f"{prefix}{snake(k)}": F.col(map_column).getItem(k) for k in keys})


def write_partitioned(df: DataFrame, root: str, sort_by: Iterable[str] = (),
                      max_records_per_file: int = 20_000_000,
                      widened: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write ``year=/month=`` Parquet, replacing only the months present in ``df``.

    Re-delivering a month is idempotent. The REBALANCE hint lets AQE split a month that
    holds most of the rows over many writers and merge small ones, so one big month is
    never one task. Sorting inside each task makes row-group statistics useful for later
    filters on the sort columns. ``widened`` works out further columns of rows that already lie in
    their place, so that only what it works them out from is shuffled and sorted; it keeps rows,
    their order and the partition columns.
    """
    out = df.hint("rebalance", *[F.col(c) for c in PARTITION_COLUMNS])
    out = out.sortWithinPartitions(*PARTITION_COLUMNS, *sort_by)
    if widened is not None:
        out = widened(out)
    with compiled(df.sparkSession):
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy(*PARTITION_COLUMNS).parquet(root))


def write_billing(df: DataFrame, root: str, widened: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write billing rows, clustered by product and time inside each month."""
    write_partitioned(df, root, ("line_item_product_code", "line_item_usage_start_date"), widened=widened)
