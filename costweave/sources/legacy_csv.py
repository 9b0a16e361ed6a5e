"""Converting legacy CSV deliveries with slash headers to the contract."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from costweave.schema import CONTRACT, PARTITION_COLUMNS, contract
from costweave.sources.billing_table import conform, widen, write_billing


def snake(word: str) -> str:
    """``UnblendedCost`` -> ``unblended_cost``; every capital starts a word (``ARN`` -> ``a_r_n``).

    Runs of other characters become one underscore.
    """
    spaced = re.sub(r"(?<!^)(?=[A-Z])", "_", word)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def column_name(header: str) -> str:
    """Table column name of a report header such as ``lineItem/UnblendedCost``."""
    return "_".join(snake(part) for part in re.split(r"[/:]", header) if part)


def column_names(headers: list[str]) -> list[str]:
    """Table names for all headers; two headers must not fall on one name."""
    names = [column_name(h) for h in headers]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"headers fall on the same column name: {clashes}")
    return names


def _cast(name: str, kind: T.DataType) -> Column:
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    if isinstance(kind, T.StringType):
        return F.nullif(F.col(name), F.lit(""))
    return text.try_cast(kind)


def _kinds(optional: tuple[str, ...], extra: dict[str, str] | None) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in contract(optional, extra) if f.name not in PARTITION_COLUMNS}


def unconverted_headers(df: DataFrame, optional: tuple[str, ...] = (),
                        extra: dict[str, str] | None = None) -> dict[str, str]:
    """Headers that ``from_legacy`` would leave out, each with the column name it would have."""
    kinds = _kinds(optional, extra)
    return {h: n for h, n in zip(df.columns, column_names(df.columns)) if n not in kinds}


def from_legacy(df: DataFrame, ntz: bool = False, optional: tuple[str, ...] = (),
                extra: dict[str, str] | None = None) -> DataFrame:
    """Contract rows out of all-string rows with slash headers, with the named optional column
    groups and ``extra`` columns (name to type); ``unconverted_headers`` tells what is left out.

    Values that do not parse become NULL; ``conversion_report`` counts them. Partition
    columns are taken from the usage start, as delivered files carry none.
    """
    named = df.toDF(*column_names(df.columns))
    kinds = _kinds(optional, extra)
    cols = []
    for name in named.columns:
        kind = kinds.get(name)
        if kind is None:
            continue
        if ntz and isinstance(kind, T.TimestampType):
            kind = T.TimestampNTZType()
        cols.append(_cast(name, kind).alias(name))
    typed = named.select(*cols)
    start = F.col("line_item_usage_start_date")
    added = [n for n in kinds if n not in CONTRACT.names]
    wide = widen(typed, {n: kinds[n].simpleString() for n in added})
    return conform(wide.withColumns({"year": F.date_format(start, "yyyy"),
                                     "month": F.date_format(start, "MM")}), added)


def conversion_report(df: DataFrame) -> DataFrame:
    """Per typed column: how many values are filled and how many of those do not parse."""
    named = df.toDF(*column_names(df.columns))
    kinds = {f.name: f.dataType for f in CONTRACT if not isinstance(f.dataType, T.StringType)}
    typed = [n for n in named.columns if n in kinds]
    filled = {n: F.nullif(F.trim(F.col(n)), F.lit("")).isNotNull() for n in typed}
    counts = named.agg(*[
        F.struct(F.count_if(filled[n]).alias("filled"),
                 F.count_if(filled[n] & F.trim(F.col(n)).try_cast(kinds[n]).isNull())
                 .alias("bad_values")).alias(n)
        for n in typed])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n)["filled"].alias("filled"),
                              F.col(n)["bad_values"].alias("bad_values")) for n in typed])
    return counts.select(F.inline(rows))


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and header (its first line that is not blank) of every file that has one, from one job.

    Lines are numbered in the order of a task's input, and the blocks that begin a file come first
    by their place in it, so the smallest (place, number) is the file's first line.
    """
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place")))
    return (lines.where("trim(value) <> ''").groupBy("file")
            .agg(F.min_by("value", "place").alias("header")))


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """The delivered CSV files (plain or gzip), every value as text.

    The columns of a report change between deliveries. Files are grouped by their own header,
    found for all files in one pass over the lines; each group is read under its header, and columns
    that a group lacks are NULL. Files without a line give no rows. What comes to the driver is the
    file names, which Spark's listing holds there anyway, once for each header.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    groups = sorted(sorted(g.files) for g in first_lines(spark, path).groupBy("header")
                    .agg(F.collect_list("file").alias("files")).collect())
    if not groups:
        raise ValueError(f"no files with a header under {path}")
    # Paths in the metadata are URIs; a reader takes them as they are named.
    parts = [reader.csv([unquote(f) for f in files]) for files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def convert_legacy_csv(spark: SparkSession, source: str, root: str, optional: tuple[str, ...] = (),
                       extra: dict[str, str] | None = None) -> dict[str, str]:
    """Convert a CSV delivery to the month-partitioned Parquet table; returns what was left out."""
    delivered = read_legacy_csv(spark, source)
    write_billing(from_legacy(delivered, optional=optional, extra=extra), root)
    return unconverted_headers(delivered, optional, extra)
