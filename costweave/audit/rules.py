"""Audit of a table of SQL texts for patterns that make billing queries costly or wrong.

Input is any frame with a query id and a text, e.g. an exported query history; output is one
finding per (query, rule). The rules are LEXICAL: comments and string literals are blanked
and tokens are tested with regular expressions, entirely in JVM-side column expressions and
without a shuffle.

Brackets are followed with a stack, so every SELECT, nested or not, has a scope: its own words without those of
the SELECTs inside it. A read of the table is held against the WHERE of its own scope. A column with a qualifier
belongs to the table that its scope, or one around it, names so; a column without one is the table's where the
scope reads nothing else, and may be another's where it does. Known limits: names introduced anywhere in a text
(by AS, as the last word of a select item, as a common table expression) are known in all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from costweave.schema import CONTRACT, PARTITION_COLUMNS

# One pass from left to right, so a quote inside a comment and dashes inside a literal are
# both read correctly. A literal becomes ' ', a comment a blank.
BLANK_OUT = r"(?s)(?=['/-])(?:(')[^']*+'|--[^\n]*+|/\*.*?\*/)"

# A quoted name with anything but word characters in it.
QUOTED = r"\"[^\"]*[^a-z0-9_\"][^\"]*\"|`[^`]*[^a-z0-9_`][^`]*`"
# Possessive: a word that does not fit is not tried again letter by letter.
WORD = r"[a-z_][a-z0-9_]*+"
QUALIFIER = rf"(?:{WORD}\s*+\.\s*+)"
STAR = rf"(?:\bselect\s+(?:distinct\s+|all\s+)?|,\s*){QUALIFIER}*\*"
# A plain word first, what stands before it after that: such a word is searched for as a whole, where a word boundary
# would be looked for at every letter. For the same reason a letter is looked at before a boundary or a choice of words.
WHERE_PART = (r"(?s)where(?<=\bwhere)\b(.*?)"
              r"(?![^ghlou;])(?:\b(?:group\s+by|order\s+by|having|limit|union)\b|;|\z)")
COMPARED = r"\b{0}\b(?:\s+as\s+[a-z]+)?[\s)]*(?:=|<|>|!=|\bnot\s+in\b|\bin\b|\bbetween\b|\blike\b)"
FIRST_OF_MANY = rf"\(\s*{QUALIFIER}*{{0}}\s*,"
WRAPPED = rf"\b({WORD})\s*+\(\s*+{QUALIFIER}*(?:{{0}})\b"
INSIDE = rf"\b({WORD})\s*+\([^()]*\b(?:{{0}})\b"
# Words before which a column may stand; what follows any other word without a comma is an alias.
NO_VALUE = ("distinct|all|and|or|not|when|then|else|case|like|ilike|rlike|in|is|between|by|select|from|join|on|using|"
            "where|having|limit|interval|over|union|as")
# What a scope reads: the list after FROM, and each joined table, with its alias.
CLAUSE = (r"where|group|order|having|limit|union|intersect|except|window|qualify|fetch|offset|tablesample|"
          r"join|inner|left|right|full|cross|natural|lateral|on|using|semi|anti|sort|cluster|distribute")
CLAUSE_LETTERS = "".join(sorted({word[0] for word in CLAUSE.split("|")}))
FROM_LIST = rf"(?s)from(?<=\bfrom)\b(.*?)(?![^{CLAUSE_LETTERS};])(?:\b(?:{CLAUSE})\b|;|\z)"
JOINED = rf"join(?<=\bjoin)\s+((?:{QUALIFIER}*{WORD}|\(\s*\))(?:\s+(?:as\s+)?(?!(?:{CLAUSE})\b){WORD})?)"
SOURCE_TABLE = rf"^{QUALIFIER}*({WORD})"
SOURCE_ALIAS = rf"^(?:{QUALIFIER}*{WORD}|\(.*\))\s+(?:as\s+)?({WORD})"
QUALIFIED = rf"\b{QUALIFIER}+{WORD}\b(?!\s*[.(])"
# Words that name functions, qualified columns, tables or table aliases by where they stand.
NO_COLUMN = (rf"(?=[a-z_])\b(?:{QUALIFIER}+(?:{WORD}|\*)|{WORD}\s*\(|(?:from|join)\s+{QUALIFIER}*{WORD}"
             rf"(?:\s+(?:as\s+)?{WORD})?)")
# Names a text introduces itself: aliases, common table expressions and named windows.
INTRODUCED = (rf"as(?<=\bas)\s+({WORD})\b", rf"\)\s*({WORD})\b",
              rf"(?=[w,])(?:\bwith(?:\s+recursive)?|\bwindow|,)\s*({WORD})\s+as\s*\(",
              rf"(?=[a-z_'])(?:\b(?!(?:{NO_VALUE})\b){WORD}|')\s+({WORD})\s*(?:,|\bfrom\b)")
TIME_COLUMNS = ("line_item_usage_start_date", "line_item_usage_end_date",
                "bill_billing_period_start_date", "bill_billing_period_end_date")
# What counts as a left-over placeholder, and below how many bytes a text is tiny.
PLACEHOLDER = r"<[A-Z_]{2,}>|REPLACE_ME_[A-Z_-]+|'<[A-Z][A-Z0-9:-]+"
MIN_BYTES = 200

# The header sections a documented query carries, each with its spellings.
HEADER_SECTIONS = {
    "question": ("QUESTION",),
    "returns": ("RETURNS",),
    "bytes scanned": ("BYTES SCANNED",),
    "assumptions": ("REQUIRED TABLE", "TABLE / PARTITION", "TABLE/PARTITION"),
    "caveats": ("CAVEAT",),
}

# Words of SQL that may stand before an opening bracket without being a function.
CLAUSE_WORDS = ("and", "or", "not", "where", "in", "on", "when", "then", "else", "having", "by",
                "select", "from", "exists", "any", "all", "case", "between", "as")

# The reserved words of Spark SQL, as sql_keywords() lists them under
# spark.sql.ansi.enforceReservedKeywords.
RESERVED_WORDS = """
all and any as authorization both call case cast check collate collation column constraint create
cross current_date current_time current_timestamp current_user distinct else end escape except
execute false fetch filter for foreign from full grant group having in inner intersect into is join
lateral leading left natural not null offset on only or order outer overlaps primary recursive
references right select session_user some sql table then time to trailing union unique unknown user
using when where with within
""".split()
# Words that Spark does not reserve but that these rules meet in clauses, frames and casts.
OPEN_WORDS = ("asc between by cube current day desc exists first following grouping hour if ilike "
              "interval last like limit minute month next nulls over partition percent preceding qualify "
              "range rlike rollup row rows second sets tablesample ties true unbounded unnest values window "
              "year zone at "
              "bigint boolean date decimal double float int integer real smallint string timestamp varchar").split()
SQL_WORDS = tuple(dict.fromkeys([*RESERVED_WORDS, *OPEN_WORDS]))

SEVERITY = {"star": "high", "partition_filter": "high", "wrapped_partition": "low",
            "unknown_column": "high", "timestamp_filter": "high", "header": "low",
            "bytes_warning": "low", "placeholder": "medium", "tiny_text": "medium"}
RULES = tuple(SEVERITY)


def _words(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _literals(words: Iterable[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def table_reference(table: str) -> str:
    """The table after FROM or JOIN, or after a comma with an alias or clause behind it."""
    name = rf"{QUALIFIER}*{re.escape(table.lower())}"
    return rf"(?=[fj,])(?:\b(?:from|join)\s+{name}\b|,\s*{name}\s+(?:as\s+)?{WORD})"


def predicate(column: str) -> str:
    """A comparison of a partition column, bare or inside a function."""
    return COMPARED.format(column) + "|" + FIRST_OF_MANY.format(column)


def readable(queries: DataFrame, text: str) -> DataFrame:
    """Adds ``_raw`` (NULL when not UTF-8) and ``_bare``: lower case, comments, literals and
    quoted names that are no plain words blanked."""
    value = F.col(text).cast("string")
    raw = F.when(F.is_valid_utf8(value), value)
    bare = F.lower(F.regexp_replace("_raw", BLANK_OUT, "$1 $1"))
    quotes = F.contains("_bare", F.lit('"')) | F.contains("_bare", F.lit("`"))
    plain = F.translate(F.regexp_replace("_bare", QUOTED, " "), '"`', "")
    return (queries.withColumn("_raw", raw).withColumn("_bare", bare)
            .withColumn("_bare", F.when(quotes, plain).otherwise(F.col("_bare"))))


SCOPE = ("struct<reads: int, years: int, months: int, mine: array<string>,"
         " quals: array<struct<q: string, c: string>>, words: array<string>>")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once: within lambdas nothing else shares what it reads."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scopes_of(bare: Column) -> Column:
    """The words of each SELECT of a text, without those of SELECTs inside it; first what stands before them all.

    The text is cut at brackets and SELECTs, and a stack holds the scope of each open bracket: an even number
    names the scope number times two, an odd one tells that a bracket was opened in it. FROM inside such a
    bracket is a function's and made a comma.
    """
    compared = F.when(F.contains(bare, F.lit("distinct")), F.regexp_replace(bare, r"\bdistinct\s+from\b", "<>"))
    marked = F.regexp_replace(F.coalesce(compared, bare), r"select(?<=\bselect)\b", "\x01")

    def added(scopes: Column, to: Column, text: Column) -> Column:
        return F.transform(scopes, lambda c, k: F.when(k == to, F.concat(c, text)).otherwise(c))

    def step(state: Column, piece: Column) -> Column:
        stack, scopes = state["stack"], state["scopes"]
        top = F.element_at(stack, 1)
        own, rest = F.shiftright(top, 1), F.slice(stack, F.lit(2), F.size(stack))
        closed = F.when(F.size(stack) > 1, rest).otherwise(stack)
        inside = F.when((top % 2 == 1) & F.contains(piece, F.lit("from")),
                        F.regexp_replace(piece, r"\bfrom\b", ",")).otherwise(piece)
        new = lambda s, c: F.struct(s.alias("stack"), c.alias("scopes"))
        return (F.when(piece == "(", new(F.concat(F.array(F.shiftleft(own, 1).bitwiseOR(F.lit(1))), stack),
                                         added(scopes, own, piece)))
                .when(piece == ")", new(closed, added(scopes, F.shiftright(F.element_at(closed, 1), 1), piece)))
                .when(piece == "\x01", new(F.concat(F.array(F.shiftleft(F.size(scopes), 1)), rest),
                                           F.concat(scopes, F.array(F.lit("")))))
                .otherwise(new(stack, added(scopes, own, inside))))

    begin = F.struct(F.array(F.lit(0)).alias("stack"), F.array(F.lit("")).alias("scopes"))

    def cut(marked: Column) -> Column:
        pieces = F.regexp_extract_all(marked, F.lit("[()\x01]|[^()\x01]+"), F.lit(0))
        nested = F.aggregate(pieces, begin, step, lambda state: state["scopes"])
        # Texts of one SELECT and one FROM have nothing to nest.
        plain = (F.size(F.split(marked, "\x01")) <= 2) & (F.size(F.split(marked, "from")) <= 2)
        return F.when(plain, F.split(marked, "\x01")).otherwise(nested)

    return _let(marked, cut)


def parts_of(bare: Column, table: str) -> Column:
    """For each scope of a text: how often it reads the table, how often its WHERE compares year and month, by which
    names it knows the table, its qualified columns but for those of its other tables, and, where it reads
    nothing else, all words that may be columns."""
    name, reference, nothing = table.lower(), table_reference(table), F.lit(None)

    def one(scope: Column) -> Column:
        items = F.concat(F.split(F.regexp_extract(scope, FROM_LIST, 1), ","), _words(scope, JOINED))
        cleaned = F.filter(F.transform(items, lambda x: F.trim(x, F.lit(" \t\n\r"))), lambda x: x != "")
        sources = F.transform(cleaned, lambda item: F.struct(
            F.regexp_extract(item, SOURCE_TABLE, 1).alias("t"), F.regexp_extract(item, SOURCE_ALIAS, 1).alias("a")))
        named = lambda which: F.transform(which, lambda s: F.when(s["a"] == "", s["t"]).otherwise(s["a"]))

        def known(source: Column) -> Column:
            mine = named(F.filter(source, lambda s: s["t"] == name))
            theirs = named(F.filter(source, lambda s: s["t"] != name))
            return _let(F.struct(mine.alias("mine"), theirs.alias("theirs")), told)

        def told(own: Column) -> Column:
            pairs = F.transform(_words(scope, QUALIFIED, 0), lambda x: _let(
                F.split(x, r"\s*\.\s*"), lambda x: F.struct(F.element_at(x, -2).alias("q"), F.element_at(x, -1).alias("c"))))
            free = F.filter(pairs, lambda x: ~F.array_contains(own["theirs"], x["q"]))
            alone = (F.size(own["mine"]) > 0) & (F.size(own["theirs"]) == 0)
            words = _words(F.regexp_replace(scope, NO_COLUMN, " "), rf"\b({WORD})\b")
            return F.struct(own["mine"].alias("mine"), free.alias("quals"), F.when(alone, words).alias("words"))

        def counted(reads: Column) -> Column:
            columns = _let(sources, known)
            where = F.when(reads > 0, F.concat_ws(" ", _words(scope, WHERE_PART)))
            return _let(F.struct(columns.alias("c"), where.alias("w")), lambda x: F.struct(
                reads.alias("reads"), F.coalesce(_times(x["w"], predicate("year")), F.lit(0)).alias("years"),
                F.coalesce(_times(x["w"], predicate("month")), F.lit(0)).alias("months"),
                x["c"]["mine"].alias("mine"), x["c"]["quals"].alias("quals"), x["c"]["words"].alias("words")))

        reads = F.when(F.contains(scope, F.lit(name)), _times(scope, reference)).otherwise(0)
        # Scopes without a single name of the table or a qualified column say nothing.
        return F.when(F.contains(scope, F.lit(name)) | F.contains(scope, F.lit(".")), _let(reads, counted)).otherwise(
            nothing.cast(SCOPE))

    return F.filter(F.transform(scopes_of(bare), one), lambda part: part.isNotNull())


def _measures(table: str, allowed: tuple[str, ...]) -> dict[str, Column]:
    """What the rules look at, one named column each, so that it is worked out once."""
    bare = F.col("_bare")
    clause_words = _literals(CLAUSE_WORDS)
    nothing = F.expr("array()").cast("array<string>")
    # A constant IN list is one hash set for all rows; array_except would build it per row.
    known = ", ".join(f"'{w}'" for w in [*SQL_WORDS, *allowed, table.lower()])
    named = "flatten(transform(_parts, p -> p.mine))"
    words = F.expr(f"""transform(array({named}), mine -> filter(array_distinct(flatten(transform(_parts, p -> concat(
     coalesce(p.words, array()), transform(filter(p.quals, x -> array_contains(mine, x.q)), x -> x.c))))),
     w -> w NOT IN ({known}) AND NOT array_contains(mine, w)))[0]""")

    def if_any(text: Column, parts: Iterable[str], then: Column, otherwise: Column) -> Column:
        """Skips a regular expression where a plain substring test already rules it out."""
        return F.when(_contains_any(text, tuple(parts)), then).otherwise(otherwise)

    def unexplained(found: Column) -> Column:
        """The words that the text does not introduce, which is looked for where there are any."""
        introduced = F.flatten(F.array(*[_words(bare, p) for p in INTRODUCED]))
        return F.when(F.size(found) > 0, F.array_sort(F.array_except(found, introduced))).otherwise(nothing)

    where = F.col("_where")
    wrapped = F.array_except(_words(where, WRAPPED.format("|".join(PARTITION_COLUMNS))),
                             clause_words)
    timed = F.array_except(_words(where, INSIDE.format("|".join(TIME_COLUMNS))), clause_words)
    left = F.array_sort(F.array_distinct(_words(F.col("_raw"), PLACEHOLDER, 0)))
    absent = F.array_compact(F.array(*[
        F.when(~_contains_any(F.col("_raw"), spellings), F.lit(section))
        for section, spellings in HEADER_SECTIONS.items()]))
    return {
        "_reads": F.expr("aggregate(_parts, 0, (n, p) -> n + p.reads)"),
        "_by_year": F.expr("aggregate(_parts, 0, (n, p) -> n + p.years)"),
        "_by_month": F.expr("aggregate(_parts, 0, (n, p) -> n + p.months)"),
        "_lacking": F.expr("aggregate(_parts, 0, (n, p) ->"
                           " n + greatest(p.reads - least(p.years, p.months), 0))"),
        "_stars": if_any(bare, "*", _times(bare, STAR), F.lit(0)),
        "_wrapped": if_any(where, PARTITION_COLUMNS, wrapped, nothing),
        "_timed": if_any(where, TIME_COLUMNS, timed, nothing),
        "_strange": _let(words, unexplained),
        "_absent": absent,
        "_headless": ~F.ltrim("_raw").startswith("--"),
        "_left": if_any(F.col("_raw"), ("<", "REPLACE_ME_"), left, nothing),
        "_size": F.coalesce(F.octet_length("_raw"), F.lit(0)),
        "_unreadable": F.col("_raw").isNull(),
        "_warned": F.contains("_raw", F.lit("BYTES SCANNED")),
    }


def _rules(readers_only: bool) -> dict[str, tuple[Column, Column, Column]]:
    """Rule -> (hit, observed, detail) over the measures."""
    lacking = F.col("_lacking")
    none = F.lit("")
    reader = (F.col("_reads") > 0) if readers_only else F.lit(True)

    def listed(name: str, detail: Column | None = None) -> tuple[Column, Column, Column]:
        return (F.size(name) > 0, F.size(name),
                F.concat_ws(", ", name) if detail is None else detail)

    return {
        "star": (reader & (F.col("_stars") > 0), F.col("_stars"), none),
        "partition_filter": (lacking > 0, lacking,
                             F.concat(F.lit("table reads "), F.col("_reads").cast("string"),
                                      F.lit(", year "), F.col("_by_year").cast("string"),
                                      F.lit(", month "), F.col("_by_month").cast("string"))),
        "wrapped_partition": listed("_wrapped", F.concat_ws(", ", F.array_sort("_wrapped"))),
        "unknown_column": (reader & (F.size("_strange") > 0), *listed("_strange")[1:]),
        "timestamp_filter": listed("_timed", F.concat_ws(", ", F.array_sort("_timed"))),
        "header": ((F.size("_absent") > 0) | F.col("_headless"), F.size("_absent"),
                   F.concat_ws(", ", F.when(F.col("_headless"), F.lit("no leading comment")),
                               "_absent")),
        "bytes_warning": (~F.col("_warned"), F.lit(0), none),
        "placeholder": listed("_left"),
        "tiny_text": (F.col("_unreadable") | (F.col("_size") < MIN_BYTES), F.col("_size"),
                      F.when(F.col("_unreadable"), F.lit("unreadable"))
                      .otherwise(F.lit("short"))),
    }


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def audit(queries: DataFrame, query_id: str = "query_id", text: str = "sql_text",
          table: str = "billing", rules: Iterable[str] = RULES,
          extra_columns: Iterable[str] = (), readers_only: bool = True, tasks: int | None = None) -> DataFrame:
    """Findings (query_id, rule, severity, observed, detail) of the chosen rules.

    ``table`` is the billing table's name without qualifiers; ``extra_columns`` extends the
    contract with columns the table really has. Unknown columns are those asked of the table. Stars are of
    interest in texts that read it; ``readers_only=False`` looks for them in all. Unreadable texts
    only yield ``tiny_text``. Nothing is shuffled; ``tasks`` deals the texts out over so many tasks first, for a
    history that lies in a few large files, as the rules take far longer than a text's way does.
    """
    if tasks is not None:
        queries = queries.select(query_id, text).repartition(tasks)
    allowed = (*[c.lower() for c in CONTRACT.names], *[c.lower() for c in extra_columns])
    known = _rules(readers_only)
    chosen = list(rules)
    for rule in chosen:
        if rule not in known:
            raise ValueError(f"unknown rule {rule!r}; one of {sorted(known)}")
    cells = []
    for rule in chosen:
        hit, observed, detail = known[rule]
        hit = F.coalesce(hit, F.lit(False))
        cells.append(F.struct(
            F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"),
            hit.alias("hit"), observed.cast("bigint").alias("observed"),
            F.when(hit, detail).alias("detail")))
    bare = F.col("_bare")
    # Where the table's name does not occur at all, nothing that depends on reading it is looked for.
    named = F.contains(bare, F.lit(table.lower()))
    texts = (readable(queries, text)
             .withColumns({
                 "_where": F.concat_ws(" ", _words(bare, WHERE_PART)),
                 "_parts": F.when(named, parts_of(bare, table)).otherwise(F.array().cast(f"array<{SCOPE}>"))})
             .select(F.col(query_id).alias("query_id"),
                     *[c.alias(n) for n, c in _measures(table, allowed).items()]))
    # A literal array under inline() keeps Spark from adding a filter that would work the
    # whole array out a second time.
    return (texts.select("query_id", F.inline(F.array(*cells))).where("hit")
            .select("query_id", "rule", "severity", "observed", "detail"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """Flagged queries per rule."""
    return (findings.groupBy("rule", "severity").agg(F.count("*").alias("queries"))
            .orderBy(F.desc("queries"), "rule"))
