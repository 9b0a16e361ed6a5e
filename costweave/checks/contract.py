"""Does the table match its contract, and are its columns filled?"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from costweave.checks.findings import COLUMNS
from costweave.schema import CONTRACT, PARTITION_COLUMNS
from costweave.sources.billing_table import deliveries
from costweave.sources.period import Period

_STAMPS = (T.TimestampType, T.TimestampNTZType)


def _same(actual: T.DataType, declared: T.DataType) -> bool:
    return actual == declared or (isinstance(actual, _STAMPS) and isinstance(declared, _STAMPS))


def column_states(df: DataFrame) -> dict[str, tuple[str, str, str]]:
    """Column name -> (state, declared type, actual type), from the schema alone."""
    declared = {f.name: f.dataType for f in CONTRACT}
    actual = {f.name: f.dataType for f in df.schema}
    states = {}
    for name in [*declared, *[n for n in actual if n not in declared]]:
        want, have = declared.get(name), actual.get(name)
        if have is None:
            state = "missing"
        elif want is None:
            state = "unknown"
        else:
            state = "declared" if _same(have, want) else "wrong type"
        states[name] = (state, want.simpleString() if want else "-",
                        have.simpleString() if have else "-")
    return states


def _texts(values: list[str]) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def _fills(columns: list[str]) -> str:
    """Filled values of each column as one array; an empty name stands for an absent column."""
    return "array(" + ", ".join(f"count(`{c}`)" if c else "0L" for c in columns) + ")"


def contract_profile(df: DataFrame) -> DataFrame:
    """Filled values per month and column, from one pass over all columns."""
    counts = df.groupBy("year", "month").agg(
        F.count("*").alias("rows"), F.expr(_fills(df.columns)).alias("filled"))
    return (counts.withColumn("column_name", F.expr(_texts(df.columns)))
            .selectExpr("year", "month", "rows", "inline(arrays_zip(column_name, filled))")
            .withColumn("fill_rate", F.round(F.col("filled") / F.col("rows"), 4)))


def check_contract(df: DataFrame, period: Period | None = None) -> DataFrame:
    """One finding per column: missing, unknown, wrong type, NULL everywhere (in the months of
    ``period``, else in all), or fine.

    ``observed`` is the share of filled values. A declared column that is NULL everywhere
    is what a misspelt tag name looks like.
    """
    states = column_states(df)
    df = df if period is None else df.where(period.partitions())
    severity = {"missing": "error", "wrong type": "error", "declared": "warning",
                "unknown": "info"}
    text = {"missing": "missing, declared {0}", "wrong type": "declared {0}, found {1}",
            "declared": "declared", "unknown": "not in the contract, {1}"}
    counts = df.agg(
        F.count("*").alias("rows"),
        F.expr(_fills([n if s[0] != "missing" else "" for n, s in states.items()]))
        .alias("filled"))
    rows = counts.withColumns({
        "subject": F.expr(_texts(list(states))),
        "state": F.expr(_texts([s for s, _, _ in states.values()])),
        "severity": F.expr(_texts([severity[s] for s, _, _ in states.values()])),
        "text": F.expr(_texts([text[s].format(w, h) for s, w, h in states.values()])),
    }).selectExpr("rows", "inline(arrays_zip(subject, state, severity, text, filled))")
    return rows.selectExpr(
        "'contract' AS check_id", "severity",
        "state IN ('declared', 'unknown') AND filled > 0 AS ok", "subject",
        "round(coalesce(filled / nullif(rows, 0), 0D), 4) AS observed",
        "CASE WHEN filled = 0 AND state <> 'missing' THEN text || ', NULL everywhere'"
        " ELSE text END AS detail")


def month_schemas(spark: SparkSession, root: str) -> dict[str, T.StructType]:
    """Month ("YYYY-MM", as the folders say) -> schema of its newest file, from one footer a month."""
    newest = deliveries(spark, root).select("year", "month", "newest_file").orderBy("year", "month").collect()
    with ThreadPoolExecutor(16) as side_by_side:
        schemas = side_by_side.map(lambda r: spark.read.parquet(r.newest_file).schema, newest)
        return {f"{r.year}-{r.month}": schema for r, schema in zip(newest, schemas)}


def check_schema_drift(spark: SparkSession, root: str) -> DataFrame:
    """Do the month folders of a table hold the same columns? A table is read under one schema, which
    hides that a month was delivered with another.

    One finding per month and column that changes type, vanishes or appears against the month
    before it, or has another type than declared; one that is fine for each month without any. ``subject`` is the
    month and the column, ``observed`` the number of columns of the month. A table without files gives no
    findings.
    """
    declared = {f.name: f.dataType for f in CONTRACT}
    found, before = [], None
    for month, schema in month_schemas(spark, root).items():
        own = {f.name: f.dataType for f in schema if f.name not in PARTITION_COLUMNS}
        notes = []
        for name in sorted({*own, *(before or {})}):
            have, had, want = own.get(name), (before or {}).get(name), declared.get(name)
            if have is None:
                notes.append(("error" if want else "warning", name, f"vanished, was {had.simpleString()}"))
            elif had is not None and not _same(have, had):
                notes.append(("error", name, f"{had.simpleString()} became {have.simpleString()}"))
            elif want is not None and not _same(have, want):
                notes.append(("error", name, f"declared {want.simpleString()}, found {have.simpleString()}"))
            elif had is None and before is not None:
                notes.append(("warning", name, f"new, {have.simpleString()}"))
        found += [("schema_drift", severity, False, f"{month} {name}", float(len(own)), text)
                  for severity, name, text in notes]
        if not notes:
            found.append(("schema_drift", "error", True, month, float(len(own)), "as before"))
        before = own
    kinds = ["string", "string", "boolean", "string", "double", "string"]
    return spark.createDataFrame(found, ", ".join(f"{n} {k}" for n, k in zip(COLUMNS, kinds)))
