"""Checks on rows: partitions, types, balances, population, currency, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from costweave import schema as S
from costweave.checks.findings import finding, per_row, spread
from costweave.functions import cost as C
from costweave.functions.calendar import USAGE_START, month_start, usage_date
from costweave.operators.breakdown import RESOURCE
from costweave.operators.commitments import NO_ARN, SP_ARN
from costweave.plans.spine import calendar_spine
from costweave.sources.period import Period
from costweave.sources.scratch import scratch_path

CURRENCY = "line_item_currency_code"
LINE_ID = "identity_line_item_id"
TEAM = "resource_tags_user_team"


def _partition() -> Column:
    return F.concat_ws("-", F.coalesce(F.col("year"), F.lit("(null)")),
                       F.coalesce(F.col("month"), F.lit("(null)")))


def _partition_date() -> Column:
    """First day of a well-formed partition, NULL for any other spelling."""
    shape = F.col("year").rlike("^[0-9]{4}$") & F.col("month").rlike("^(0[1-9]|1[0-2])$")
    return F.when(shape, F.concat_ws("-", "year", "month", F.lit("01"))).try_cast("date")


def check_partitions(df: DataFrame, period: Period) -> DataFrame:
    """Are the folders spelled YYYY / MM, and is every month of the period there?

    One finding per partition or absent month; ``observed`` is its row count. The span of
    months is laid out from the period, so gaps show without another pass.
    """
    have = (df.groupBy("year", "month").agg(F.count("*").alias("rows"))
            .withColumn("month_date", _partition_date()))
    spine = calendar_spine(df.sparkSession, "month_date",
                           Period.month(*period.months[0]).first_instant.date(),
                           Period.month(*period.months[-1]).first_instant.date(), "month")
    wanted = spine.where(F.date_format("month_date", "yyyy-MM").isin(
        *[f"{y:04d}-{m:02d}" for y, m in period.months])).withColumn("asked", F.lit(True))
    both = have.join(wanted, "month_date", "full_outer")
    state = (F.when(F.col("rows").isNull(), "missing")
             .when(F.col("month_date").isNull(), "bad format")
             .when(F.col("asked").isNull(), "outside the period").otherwise("present"))
    subject = F.when(F.col("rows").isNull(), F.date_format("month_date", "yyyy-MM")
                     ).otherwise(_partition())
    return per_row(both.withColumn("state", state), "partitions", "error",
                   F.col("state").isin("present", "outside the period"), subject,
                   F.coalesce(F.col("rows"), F.lit(0)), F.col("state"))


def check_partition_dates(df: DataFrame) -> DataFrame:
    """Rows per partition whose usage start lies in another month (or is NULL)."""
    by_month = (df.groupBy("year", "month", month_start().alias("used"))
                .agg(F.count("*").alias("rows")))
    stray = F.when(~F.col("used").eqNullSafe(_partition_date()), F.col("rows")).otherwise(0)
    parts = by_month.groupBy("year", "month").agg(F.sum(stray).alias("strays"),
                                                  F.sum("rows").alias("rows"))
    return per_row(parts, "partition_dates", "warning", F.col("strays") == 0, _partition(),
                   F.col("strays"), F.concat(F.lit("of rows "), F.col("rows").cast("string")))


def check_line_item_types(df: DataFrame) -> DataFrame:
    """Every line item type with its rows; undocumented and NULL types are not ok."""
    types = df.groupBy(C.TYPE).agg(F.count("*").alias("rows"), F.sum(C.cash()).alias("cash"))
    known = F.coalesce(F.col(C.TYPE).isin(*S.LINE_ITEM_TYPES), F.lit(False))
    dollars = F.coalesce(F.round("cash", 0), F.lit(0.0)).cast("bigint").cast("string")
    return per_row(types, "line_item_types", "warning", known,
                   C.label_null(C.TYPE, "(null)"), F.col("rows"),
                   F.concat(F.lit("unblended cost "), dollars))


def savings_plan_balance(df: DataFrame, period: Period | None = None) -> DataFrame:
    """Covered usage, negation and what is left per day and Savings Plan."""
    rows = df if period is None else period.scope(df)
    rows = rows.where(F.col(C.TYPE).isin(S.SP_COVERED, S.SP_NEGATION))
    return (rows.groupBy(usage_date().alias("usage_date"),
                         C.label_null(SP_ARN, NO_ARN).alias("commitment_id"))
            .agg(F.coalesce(C.sum_for(C.CASH, S.SP_COVERED), F.lit(0.0)).alias("covered"),
                 F.coalesce(C.sum_for(C.CASH, S.SP_NEGATION), F.lit(0.0)).alias("negated"))
            .withColumn("residual", F.round(F.col("covered") + F.col("negated"), 2)))


def check_savings_plan_balance(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Covered usage must be cancelled by negation, per day and Savings Plan."""
    left = savings_plan_balance(df)
    return per_row(left, "savings_plan_balance", "error",
                   F.abs("residual") <= tolerance,
                   F.concat_ws(" ", F.date_format("usage_date", "yyyy-MM-dd"), "commitment_id"),
                   F.col("residual"), F.lit("covered plus negation"))


def check_population(df: DataFrame) -> DataFrame:
    """Commitment columns filled on a line item type that never carries them.

    Fills are counted per type; the wrong types are summed afterwards.
    """
    rules = S.POPULATED_ON
    by_type = df.groupBy(C.TYPE).agg(*[F.count(c).alias(c) for c in rules])
    wrong = by_type.agg(*[
        F.expr(f"coalesce(sum(CASE WHEN {C.TYPE} <=> '{t}' THEN 0 ELSE {c} END), 0) AS {c}")
        for c, t in rules.items()])
    cells = ", ".join(f"struct('{c}' AS subject, {c} AS wrong, '{t}' AS home)"
                      for c, t in rules.items())
    return per_row(wrong.selectExpr(f"inline(array({cells}))"), "population", "warning",
                   F.col("wrong") == 0, F.col("subject"), F.col("wrong"),
                   F.expr("'belongs on ' || home"))


def check_currency(df: DataFrame, expected: str = "USD") -> DataFrame:
    """Rows per currency; anything but the expected one is not ok."""
    by_code = df.groupBy(CURRENCY).agg(F.count("*").alias("rows"))
    return per_row(by_code, "currency", "error",
                   F.coalesce(F.col(CURRENCY) == expected, F.lit(False)),
                   C.label_null(CURRENCY, "(none)"), F.col("rows"),
                   F.lit(f"expected {expected}"))


def check_last_month(df: DataFrame, period: Period | None = None) -> DataFrame:
    """Is the newest month delivered to its last day? ``observed`` is the days missing.

    The newest month is the newest partition; only its rows are looked at, and those of
    ``period`` (its newest month) if one is given, so that no other partition is read.
    """
    if period is not None:
        df = df.where(Period.month(*period.months[-1]).partitions())
    last = df.agg(F.max(F.struct("year", "month")).alias("last"))
    newest = df.where(F.struct("year", "month") == last.scalar()).agg(F.to_date(F.max(USAGE_START)).alias("day"))
    short = F.date_diff(F.last_day("day"), F.col("day"))
    return per_row(newest, "last_month", "warning", F.coalesce(short == 0, F.lit(False)),
                   F.date_format("day", "yyyy-MM"), short,
                   F.concat(F.lit("last usage "), F.date_format("day", "yyyy-MM-dd")))


def check_type_variety(df: DataFrame) -> DataFrame:
    """Months that hold a single line item type; totals of such a report mislead."""
    types = df.groupBy("year", "month", C.TYPE).agg(F.lit(1).alias("one"))
    months = types.groupBy("year", "month").agg(F.count(C.TYPE).alias("types"))
    return per_row(months, "type_variety", "warning", F.col("types") > 1, _partition(),
                   F.col("types"), F.lit("distinct line item types"))


def check_attribution(df: DataFrame, tags: Sequence[str] = (TEAM,),
                      max_pct: float = 50.0) -> DataFrame:
    """Share of cost without a resource id or without a tag: the ceiling of attribution."""
    cost = C.amortized()
    columns = [RESOURCE, *tags]

    def blank(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).isNull()

    sums = df.agg(F.sum(cost).alias("total"),
                  *[F.sum(F.when(blank(c), cost)).alias(c) for c in columns])
    found = []
    for c in columns:
        pct = F.round(100.0 * F.coalesce(F.col(c), F.lit(0.0))
                      / F.nullif(F.col("total"), F.lit(0.0)), 2)
        found.append(finding("attribution", "info", F.coalesce(pct <= max_pct, F.lit(True)),
                             F.lit(c), pct, F.lit("percent of cost without a value")))
    return spread(sums, found)


#: Ids of a bucket when duplicates are sifted, about so many in the largest month: two of 10,000 share their
#: 32-bit remainder by chance in one bucket of a hundred.
BUCKET_IDS = 10_000
#: Suspected buckets that are sent to every executor, 16 bytes each.
SENT_BUCKETS = 4_000_000


def _bucket(buckets: int) -> Column:
    return F.xxhash64("year", "month", F.pmod(F.xxhash64(LINE_ID), F.lit(buckets)))


def suspected_buckets(ids: DataFrame, buckets: int) -> DataFrame:
    """The buckets of ids, ``buckets`` a month, that may hold a copy.

    The rows of a bucket are held against its distinct 32-bit remainders: four bytes an id in the
    shuffle in place of three texts. Equal numbers prove that there is no copy. An id with very many
    copies is one number per task.
    """
    rest = F.shiftright(F.xxhash64(LINE_ID), 32).cast("int")
    return (ids.select(_bucket(buckets).alias("bucket"), rest.alias("rest")).groupBy("bucket")
            .agg(F.count("*").alias("n"), F.size(F.collect_set("rest")).alias("distinct"))
            .where("n > distinct").select("bucket"))


def _suspected(rows: DataFrame, period: Period | None, bucket_ids: int, sent: int) -> DataFrame:
    """The rows with an id whose bucket may hold a copy; all rows with an id where that are more
    than ``sent`` buckets, which would not save anything.

    The number of buckets follows from the largest month, whose rows are counted without reading a
    column. The buckets are written to the scratch folder, to be counted before they are sent.
    """
    spark = rows.sparkSession
    months = (rows if period is None else rows.where(period.partitions())).groupBy("year", "month").count()
    buckets = -(-(months.agg(F.max("count")).first()[0] or 1) // bucket_ids)
    ids = (rows if period is None else period.scope(rows)).where(F.col(LINE_ID).isNotNull())
    path = scratch_path(spark, "suspected")
    suspected_buckets(ids, buckets).write.parquet(path)
    found = spark.read.schema("bucket long").parquet(path)
    if found.count() > sent:
        return ids
    return ids.withColumn("bucket", _bucket(buckets)).join(F.broadcast(found), "bucket", "left_semi")


def duplicate_line_items(df: DataFrame, period: Period | None = None, sift: bool = False,
                         bucket_ids: int = BUCKET_IDS, sent: int = SENT_BUCKETS) -> DataFrame:
    """Line item ids that occur more than once in a month's delivery, with their cost.

    The same id in another month is not a copy: ids are unique within a period only.

    Copies are counted map-side first, so one id with very many copies is still one small
    row per task in the shuffle. Rows without an id are not compared. ``sift`` gives the same rows
    and is for tables that are expected to be clean: it reads the ids twice, and shuffles some
    bytes of each id in the place of the id, the month and the cost.
    """
    if sift:
        rows = _suspected(df, period, bucket_ids, sent)
    else:
        rows = (df if period is None else period.scope(df)).where(F.col(LINE_ID).isNotNull())
    return (rows.groupBy("year", "month", LINE_ID)
            .agg(F.count("*").alias("copies"), F.sum(C.cash()).alias("cash"))
            .where(F.col("copies") > 1)
            .select("year", "month", F.col(LINE_ID).alias("line_item_id"), "copies",
                    C.money(F.col("cash")).alias("unblended_cost")))


def check_duplicates(df: DataFrame, period: Period | None = None, sift: bool = False) -> DataFrame:
    """How many line item ids are delivered more than once, and the surplus rows."""
    one = duplicate_line_items(df, period, sift).agg(
        F.count("*").alias("ids"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra"))
    return spread(one, [
        finding("duplicates", "error", F.col("ids") == 0, F.lit(LINE_ID), F.col("ids"),
                F.concat(F.lit("surplus rows "), F.col("extra").cast("string")))])


def health_report(df: DataFrame, expected_currency: str = "USD", max_pct: float = 50.0,
                  tag: str = TEAM) -> DataFrame:
    """Headline findings of the row checks above from ONE scan of the table.

    Rows are summed per (partition, usage month, type, currency), a few thousand groups at
    any data size; every headline is then a conditional sum over those groups.
    """
    cost = C.amortized()
    rules = S.POPULATED_ON

    def blank(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).isNull()

    facts = (df.groupBy("year", "month", month_start().alias("used"), C.TYPE, CURRENCY)
             .agg(F.count("*").alias("rows"), F.max(USAGE_START).alias("newest"),
                  F.sum(cost).alias("cost"), F.sum(F.when(blank(RESOURCE), cost)).alias("bare"),
                  F.sum(F.when(blank(tag), cost)).alias("untagged"),
                  *[F.count(c).alias(c) for c in rules]))
    wrong = F.expr(" + ".join(f"CASE WHEN {C.TYPE} <=> '{t}' THEN 0 ELSE {c} END"
                              for c, t in rules.items()))
    known = F.coalesce(F.col(C.TYPE).isin(*S.LINE_ITEM_TYPES), F.lit(False))
    usd = F.coalesce(F.col(CURRENCY) == expected_currency, F.lit(False))
    stray = ~F.col("used").eqNullSafe(_partition_date())

    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))

    head = facts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), rows_where(stray).alias("strays"),
        rows_where(~known).alias("odd_types"), rows_where(~usd).alias("odd_currency"),
        F.coalesce(F.sum(wrong), F.lit(0)).alias("misplaced"),
        F.to_date(F.max("newest")).alias("day"), F.sum("cost").alias("cost"),
        F.coalesce(F.sum("bare"), F.lit(0.0)).alias("bare"),
        F.coalesce(F.sum("untagged"), F.lit(0.0)).alias("untagged"))
    short = F.date_diff(F.last_day("day"), F.col("day"))

    def pct(name: str) -> Column:
        return F.round(100.0 * F.col(name) / F.nullif(F.col("cost"), F.lit(0.0)), 2)

    def count_of(check_id: str, severity: str, name: str, text: str) -> Column:
        return finding(check_id, severity, F.col(name) == 0, F.lit("table"), F.col(name),
                       F.lit(text))

    return spread(head, [
        finding("rows", "error", F.col("rows") > 0, F.lit("table"), F.col("rows"),
                F.lit("rows in the table")),
        count_of("partition_dates", "warning", "strays", "rows used in another month"),
        count_of("line_item_types", "warning", "odd_types", "rows of undocumented type"),
        count_of("population", "warning", "misplaced", "values on the wrong type"),
        count_of("currency", "error", "odd_currency", f"rows not in {expected_currency}"),
        finding("last_month", "warning", F.coalesce(short == 0, F.lit(False)), F.lit("table"),
                short, F.lit("days missing in the newest month")),
        finding("attribution", "info", F.coalesce(pct("bare") <= max_pct, F.lit(True)),
                F.lit(RESOURCE), pct("bare"), F.lit("percent of cost without a value")),
        finding("attribution", "info", F.coalesce(pct("untagged") <= max_pct, F.lit(True)),
                F.lit(tag), pct("untagged"), F.lit("percent of cost without a value"))])
