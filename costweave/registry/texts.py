"""The query-text audit over a derived query history, each rule with the findings that its texts must give.

The texts are made of a key by known steps (``QUERY_LOG_TEXT``), so what each rule has to find follows from the
key alone. None of the patterns and word lists of the rules is used here.
"""

from __future__ import annotations

from costweave.audit import rules as A
from costweave.registry.entries import Entries
from costweave.registry.sqlbase import log_rows
from costweave.sources.sample import query_log

# Rule -> severity, whether key k has a finding, observed and detail. ``reads``: of the outer select (2 of 3 keys)
# and of the common table expression that every eleventh text has, which compares the year only.
READS = "CAST(k % 3 <> 2 AS INT) + CAST(k % 11 = 0 AS INT)"
YEARS = "CAST(k % 3 <> 2 AND k % 6 IN (1, 2, 3, 5) AS INT) + CAST(k % 11 = 0 AS INT)"
MONTHS = "CAST(k % 3 <> 2 AND k % 6 IN (1, 3, 5) AS INT)"
LACKING = "CAST(k % 3 <> 2 AND k % 6 NOT IN (1, 3, 5) AS INT) + CAST(k % 11 = 0 AS INT)"
EXPECTED = {
    "star": ("high", f"k % 7 IN (0, 1) AND {READS} > 0", "1", "''"),
    "partition_filter": ("high", f"{LACKING} > 0", LACKING,
                         f"'table reads ' || ({READS}) || ', year ' || ({YEARS}) || ', month ' || ({MONTHS})"),
    "wrapped_partition": ("low", "k % 6 = 3", "1", "'cast'"),
    # Where the outer select reads another table the column is that table's.
    "unknown_column": ("high", "k % 7 = 2 AND k % 3 <> 2", "1", "'line_item_made_up_' || lower(status)"),
    "timestamp_filter": ("high", "k % 6 = 4", "1", "'date_format'"),
    "header": ("low", "k % 5 IN (0, 1, 2)", "CASE WHEN k % 5 = 0 THEN 5 ELSE 1 END",
               "CASE k % 5 WHEN 0 THEN 'no leading comment, question, returns, bytes scanned, assumptions, caveats'"
               " WHEN 1 THEN 'returns' ELSE 'bytes scanned' END"),
    "bytes_warning": ("low", "k % 5 IN (0, 2)", "0", "''"),
    "placeholder": ("medium", "k % 6 = 5", "2", "'''<MONTH, REPLACE_ME_YYYY'"),
    "tiny_text": ("medium", "strlen(sql_text) < 200", "strlen(sql_text)", "'short'"),
}


def _keys() -> str:
    return log_rows() + """, keys AS (SELECT query_id AS k, o_orderstatus AS status, sql_text
 FROM log JOIN (SELECT DISTINCT o_orderkey, o_orderstatus FROM orders) o ON query_id = o_orderkey)
"""


def _rule_sql(rule: str) -> str:
    severity, hit, observed, detail = EXPECTED[rule]
    return _keys() + (f"SELECT k AS query_id, '{rule}' AS rule, '{severity}' AS severity,"
                      f" CAST({observed} AS BIGINT) AS observed, {detail} AS detail FROM keys WHERE {hit}")


def _all_rules_sql() -> str:
    return _keys() + "\nUNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS queries FROM keys WHERE {hit}"
        " HAVING count(*) > 0" for rule, (severity, hit, *_) in EXPECTED.items())


def register(e: Entries) -> None:
    def found(spark, sf, rules=A.RULES):
        # The sample's history is one file, which is one task.
        return A.audit(query_log(spark, sf), rules=rules, tasks=spark.sparkContext.defaultParallelism)

    def one(rule: str):
        return lambda spark, sf: found(spark, sf, [rule])

    for rule in A.RULES:
        e.add(f"audit_{rule}", one(rule), _rule_sql(rule))
    e.add("audit_summary", lambda spark, sf: A.audit_summary(found(spark, sf)),
          _all_rules_sql())
