"""Texts with one mistake each."""

import pytest
from costweave.audit.rules import RULES, audit, audit_summary

GOOD = """-- QUESTION: spend per service in one month
-- RETURNS: a row per service, biggest first
-- BYTES SCANNED: the folders of one month only
-- TABLE / PARTITION ASSUMPTIONS: folders by year and month
-- CAVEATS: cash basis, so covered usage looks free
SELECT b.line_item_product_code AS service, COUNT(*) AS n,
       2 * sum(line_item_unblended_cost) AS double_cost
FROM lake.billing b
WHERE b.year = '2026' AND month IN ('01', '02')
GROUP BY b.line_item_product_code
ORDER BY double_cost DESC
"""


def found(spark, *texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, sql_text string")
    return {(r.query_id, r.rule): r for r in audit(df, **kw).collect()}


def only(spark, text, **kw):
    return {rule: r for (_, rule), r in found(spark, text, **kw).items()}


def test_good_text_is_clean(spark):
    assert found(spark, GOOD) == {}


@pytest.mark.parametrize("old,new,rule", [
    ("b.line_item_product_code AS service, COUNT(*) AS n,", "*,", "star"),
    ("b.line_item_product_code AS service", "b.*", "star"),
    ("SELECT b.line_item_product_code", "SELECT DISTINCT *, b.line_item_product_code", "star"),
    ("WHERE b.year = '2026' AND month IN ('01', '02')\n", "", "partition_filter"),
    ("AND month IN ('01', '02')", "", "partition_filter"),
    ("b.year = '2026' AND", "", "partition_filter"),
    ("month IN", "cast(month AS int) IN", "wrapped_partition"),
    ("b.year =", "concat(b.year, '') =", "wrapped_partition"),
    ("line_item_unblended_cost", "line_item_invented_cost", "unknown_column"),
    ("month IN ('01', '02')",
     "month = '01' AND date_trunc('month', line_item_usage_start_date) = x.service",
     "timestamp_filter"),
    ("-- QUESTION:", "-- ABOUT:", "header"),
    ("-- CAVEATS:", "-- NOTE:", "header"),
    ("2026", "REPLACE_ME_YYYY", "placeholder"),
    ("2026", "<YYYY>", "placeholder"),
    ("2026", "<YYYY-MM-DDT00:00:00Z", "placeholder"),
])
def test_one_mistake_one_finding(spark, old, new, rule):
    text = GOOD.replace(old, new, 1)
    assert text != GOOD
    rules = set(only(spark, text)) - ({"wrapped_partition"} if rule == "partition_filter" else set())
    assert rules == {rule}


def test_missing_bytes_warning_is_also_a_header_gap(spark):
    assert set(only(spark, GOOD.replace("BYTES SCANNED", "BYTES"))) == {"header", "bytes_warning"}


def test_multiplication_and_count_are_no_star(spark):
    text = GOOD.replace("2 * sum", "line_item_usage_amount * 2, b.line_item_usage_amount * sum")
    assert "star" not in only(spark, text)


def test_comments_and_literals_are_not_read(spark):
    text = GOOD.replace("-- CAVEATS", "-- isn't: SELECT * FROM billing\n/* SELECT *\nFROM billing */\n-- CAVEATS")
    text = text.replace("'2026'", "'2026', 'SELECT * FROM billing -- ''x'''").replace("b.year =", "b.year IN")
    assert only(spark, text) == {}


def test_every_read_needs_its_predicates(spark):
    text = GOOD + "UNION ALL SELECT 'x', 1, 2 FROM billing WHERE line_item_usage_amount > 1\n"
    row = only(spark, text)["partition_filter"]
    assert row.observed == 1 and row.detail == "table reads 2, year 1, month 1"


def test_other_tables_are_free(spark):
    text = GOOD.replace("WHERE b.year = '2026' AND month IN ('01', '02')\n", "").replace(
        "lake.billing", "lake.other")
    assert "partition_filter" not in only(spark, text)
    assert "partition_filter" in only(spark, text, table="other")


def test_cte_names_aliases_and_quotes(spark):
    text = GOOD.replace("SELECT b.", 'WITH w AS (SELECT "line_item_usage_type" AS kind FROM '
                        "`lake`.`billing` WHERE year = '1' AND month = '2') SELECT w.kind, b.", 1)
    assert only(spark, text) == {}


def test_named_windows_are_introduced(spark):
    text = GOOD.replace("COUNT(*) AS n", "avg(line_item_usage_amount) OVER w AS n").replace(
        "ORDER BY", "WINDOW w AS (PARTITION BY line_item_usage_type)\nORDER BY")
    assert only(spark, text) == {}


def test_extra_columns_extend_the_contract(spark):
    text = GOOD.replace("line_item_unblended_cost", "cost_category_team")
    assert only(spark, text)["unknown_column"].detail == "cost_category_team"
    assert only(spark, text, extra_columns=["cost_category_team"]) == {}


def test_unreadable_and_short_texts(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfeSELECT 1")), (2, bytearray(b"SELECT 1")),
                                (3, None), (4, bytearray(GOOD.encode()))],
                               "query_id int, sql_text binary")
    tiny = {r.query_id: r.detail for r in audit(df, rules=["tiny_text"]).collect()}
    assert tiny == {1: "unreadable", 2: "short", 3: "unreadable"}
    assert {r.rule for r in audit(df).where("query_id = 1").collect()} == {"tiny_text"}


def test_whole_text_is_read(spark):
    long = GOOD.replace("\nFROM", "\n" + "-- filler\n" * 20000 + "FROM").replace(
        "ORDER BY double_cost DESC", "LIMIT 1; SELECT * FROM elsewhere")  # the text reads the table further up
    assert set(only(spark, long)) == {"star"}


def test_summary_and_rule_choice(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "SELECT * FROM billing")], "query_id int, sql_text string")
    got = {r.rule: r.queries for r in audit_summary(audit(df)).collect()}
    assert got == {"star": 1, "partition_filter": 1, "header": 1, "bytes_warning": 1, "tiny_text": 1}
    with pytest.raises(ValueError, match="unknown rule"):
        audit(df, rules=["nope"])
    assert set(got) <= set(RULES)


def _rules_of(spark, text, **more):
    df = spark.createDataFrame([(1, text)], "query_id int, sql_text string")
    found = audit(df, rules=["star", "partition_filter", "unknown_column"], **more)
    return {r.rule: r.detail for r in found.collect()}


@pytest.mark.parametrize("text", [
    "SELECT CASE WHEN year = '2024' AND month = '03' THEN 1 END FROM billing",
    "SELECT a.x FROM other a, billing b",
    "SELECT 1 FROM m JOIN billing b ON b.year = m.year AND b.month = m.month",
    "WITH a AS (SELECT 1 FROM billing WHERE year = '2024' AND year > '1' AND month = '03' AND month > '0')"
    " SELECT 1 FROM billing",
])
def test_reads_without_their_own_partition_filter(spark, text):
    assert "partition_filter" in _rules_of(spark, text)


@pytest.mark.parametrize("text", [
    'SELECT line_item_unblended_cost AS "Total Cost" FROM billing WHERE year = \'2024\' AND month = \'03\'',
    "SELECT t.n FROM (SELECT count(*) AS n FROM billing WHERE year = '2024' AND month = '03') t",
    "SELECT current_timestamp FROM billing TABLESAMPLE (5 PERCENT) WHERE year = '2024' AND month = '03'"
    " AND line_item_product_code ILIKE 'x' QUALIFY 1 = 1 FETCH FIRST 5 ROWS ONLY",
    "SELECT clicks, region, user_name FROM web_logs",
    "SELECT * FROM web_logs",
])
def test_no_false_alarms(spark, text):
    assert _rules_of(spark, text) == {}


MONTH = "year = '2024' AND month = '03'"


@pytest.mark.parametrize("text", [
    f"SELECT line_item_product_code FROM billing WHERE line_item_product_code IN (SELECT code FROM other) AND {MONTH}",
    f"SELECT a.code, b.line_item_product_code FROM other a, billing b WHERE a.code = b.line_item_product_code AND {MONTH}",
    f"SELECT line_item_unblended_cost spend, sum(line_item_usage_amount) used FROM billing WHERE {MONTH}"
    " GROUP BY spend ORDER BY used",
    f"SELECT o.owner, code, b.line_item_product_code FROM lake.billing b JOIN owners o ON o.code = b.line_item_product_code"
    f" WHERE {MONTH}",
    f"SELECT code FROM other WHERE EXISTS (SELECT 1 FROM billing b WHERE b.line_item_product_code = other.code AND {MONTH})",
    f"SELECT t.spend FROM (SELECT sum(line_item_unblended_cost) spend FROM billing WHERE {MONTH}) t JOIN dates d"
    " ON d.day = t.spend WHERE d.label = 'x'",
    f"SELECT extract(day from line_item_usage_start_date) AS d, trim(both from line_item_usage_type) AS t FROM billing"
    f" WHERE {MONTH}",
    f"SELECT line_item_product_code FROM billing WHERE line_item_product_code IS DISTINCT FROM line_item_usage_type"
    f" AND {MONTH}",
    f"SELECT (line_item_unblended_cost + (line_item_usage_amount)) * 2 AS n FROM billing WHERE ((year = '2024') AND (month ="
    " '03')) AND line_item_usage_type IN ('a', 'b')",
    f"SELECT 1 FROM billing x, billing y WHERE x.line_item_usage_type = y.line_item_usage_type AND x.{MONTH} AND y.{MONTH}",
    f"WITH a AS (SELECT line_item_product_code AS code FROM billing WHERE {MONTH}), b AS (SELECT a.code, o.owner FROM a"
    " JOIN owners o ON o.code = a.code) SELECT code, owner FROM b UNION ALL SELECT code, note FROM notes",
    f"SELECT * FROM (SELECT line_item_product_code FROM billing WHERE {MONTH} LIMIT 5".replace("*", "1") + ") z))",
])
def test_scopes_and_names_of_tables(spark, text):
    assert _rules_of(spark, text) == {}


@pytest.mark.parametrize("text,rule,detail", [
    (f"SELECT 1 FROM other WHERE {MONTH} AND code IN (SELECT line_item_product_code FROM billing)", "partition_filter",
     "table reads 1, year 0, month 0"),
    (f"SELECT 1 FROM billing WHERE line_item_product_code IN (SELECT code FROM other WHERE {MONTH})", "partition_filter",
     "table reads 1, year 0, month 0"),
    (f"WITH a AS (SELECT 1 FROM billing WHERE {MONTH}), b AS (SELECT 1 FROM billing WHERE year = '2024') SELECT 1 FROM a",
     "partition_filter", "table reads 2, year 2, month 1"),
    (f"WITH a AS (SELECT 1 FROM billing WHERE {MONTH}) SELECT 1 FROM billing", "partition_filter",
     "table reads 2, year 1, month 1"),
    (f"SELECT b.invented FROM other a, billing b WHERE a.code = 'x' AND {MONTH}", "unknown_column", "invented"),
    (f"SELECT code FROM other WHERE EXISTS (SELECT 1 FROM billing b WHERE b.wrong = other.code AND {MONTH})",
     "unknown_column", "wrong"),
    (f"SELECT line_item_product_code, (SELECT max(o.x) FROM other o WHERE o.k = b.made_up) FROM billing b WHERE {MONTH}",
     "unknown_column", "made_up"),
    (f"SELECT DISTINCT invented FROM billing WHERE {MONTH}", "unknown_column", "invented"),
    (f"SELECT count(invented) total, line_item_usage_type kind FROM billing WHERE {MONTH} AND (odd = 1)",
     "unknown_column", "invented, odd"),
    (f"SELECT lake.billing.nothing, billing.year FROM lake.billing WHERE {MONTH}", "unknown_column", "nothing"),
])
def test_scopes_and_names_of_tables_find(spark, text, rule, detail):
    assert _rules_of(spark, text) == {rule: detail}


def test_scopes_of_a_text(spark):
    from costweave.audit.rules import scopes_of
    from pyspark.sql import functions as F

    text = "with a as (select f(x) from t where x in (1, 2)) select y from (select z from a) q union select 3"
    (row,) = spark.createDataFrame([(text,)], "t string").select(scopes_of(F.col("t")).alias("s")).collect()
    assert [" ".join(s.split()) for s in row.s] == [
        "with a as ()", "f(x) from t where x in (1, 2)", "y from () q union", "z from a", "3"]


def test_other_tables_on_request_and_odd_characters(spark):
    assert "star" in _rules_of(spark, "SELECT * FROM web_logs", readers_only=False)
    assert set(_rules_of(spark, "-- caf�\nSELECT * FROM billing")) == {"star", "partition_filter"}


def test_patterns_look_for_words_before_boundaries(spark):
    """The patterns that take the most time begin with a sign, not a word boundary, and find what plain ones do."""
    from pyspark.sql import functions as F
    from costweave.audit import rules as R

    ends = r"(?:\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|\bunion\b|;|\z)"
    pairs = [(R.WHERE_PART, rf"(?s)\bwhere\b(.*?){ends}", 1),
             (R.FROM_LIST, rf"(?s)\bfrom\b(.*?)(?:\b(?:{R.CLAUSE})\b|;|\z)", 1),
             (R.table_reference("t"), r"\b(?:from|join)\s+t\b|,\s*t\s+(?:as\s+)?[a-z_][a-z0-9_]*+", 0)]
    texts = ["select a from t where x = 1 group  by y having z", "nowhere where ghost where;limit1 where a limit 1",
             "éwhere b union select wherex from t, t as u;", "where", "from", "a from t", "where x\nunion", "where x orders",
             "from s, t b join t on x fromé where_ y where z union_ all"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for new, plain, group in pairs:
        assert not new.removeprefix("(?s)").startswith(r"\b")
        both = df.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(group)) for p in (new, plain)]).collect()
        assert all(a == b for a, b in both), new


def test_names_are_looked_for_where_a_word_needs_one(spark):
    df = spark.createDataFrame([(1, "SELECT 1")], "query_id long, sql_text string")
    plan = audit(df, rules=["unknown_column"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_introduced" not in plan
