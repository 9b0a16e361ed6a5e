"""Keyed pseudonyms of personal values in their own format, by Feistel networks in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from costweave.llm.shared import columns_of, fresh_name

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: Days from this one on, 270 * 271 of them (into the year 2100), are permuted among themselves.
FIRST_DAY, DATE_HALVES = "1900-01-01", (270, 271)

# Java keeps a stack frame for each round of a group that may be given back, and an executor whose stack overflows is
# lost: groups and signs that repeat without limit are possessive (++, *+, {n,}+), which takes the same text in a loop.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
         r"|(?<![\d(+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)")
#: What a sign between digit groups must not stand before: a date or another number that has a form of its own.
FORM = (r"\d{4}-\d{2}-\d{2}(?![\d-])|\d{2}/\d{2}/\d{4}(?![\d/])|\d{3}-\d{2}-\d{4}(?![\d-])"
        r"|(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)")
#: A digit with the sign before it, a space before a further group, and groups tied on by hyphens.
DIGIT, SPACE, TIED = rf"(?:(?:[ -](?!{FORM}))?\d)", rf" (?!{FORM})", rf"(?:-(?!{FORM})\d++)*+"
#: A run of digit groups of any length, up to a number of another form; the cards in it are found by their
#: check digits. A run that a hyphen follows ends before its last space instead.
CARD = (rf"(?<![\d.-])\d(?:{DIGIT}{{12,}}+(?![\d-])"
        rf"|{DIGIT}{{12}}\d*+{TIED}(?={SPACE}\d)(?:{SPACE}\d++{TIED}(?={SPACE}\d))*+)")
SECRET = (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=password=)[^\s\"']{4,}+"
          r"|(?<=token = \")[^\s\"]{8,}+(?=\")|(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])")
#: What only CARD matches, but for passwords, tokens and keys of digits.
RUN = r"^(?!\d{20})\d(?:[ -]?\d){12,}+$"
#: What a number is written with, two digits at least.
NUMBER = r"(?=(?:\D*+\d){2})\+?[\d(][\d ().-]*"
ANY = "|".join((EMAIL, SECRET, DATE, SOCIAL, ADDRESS, PHONE, CARD))
#: Holds for every text with a match of ANY, and is much cheaper to test.
MAYBE = r"[0-9@]|password=|token = \"|AKIA|[a-f]{32}"

#: Groups of a run of digits that are gone through before what they gave is put away.
BLOCK = 256


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and written once into the plan."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _hash(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, kind: str) -> Column:
    """Permutes the pairs (a, b), 0 <= a < m and 0 <= b < n: struct of the new a and b.

    Each round adds a keyed hash of one half to the other, modulo its size, which the same
    hash subtracted would undo.
    """
    def turn(s: Column, i: Column) -> Column:
        other = F.when(i % 2 == 1, s.b).otherwise(s.a)
        added = F.conv(F.substring(_hash(key, kind, i, other), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 1, F.pmod(s.a + F.pmod(added, m), m)).otherwise(s.a).alias("a"),
                        F.when(i % 2 == 0, F.pmod(s.b + F.pmod(added, n), n)).otherwise(s.b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def digits(d: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    left = F.floor(F.length(d) / 2).cast("int")
    right = F.length(d) - left
    size = lambda n: F.pow(F.lit(10.0), n).cast("long")
    # The length is part of what is hashed, as strings of each length are permuted on their own.
    new = feistel(d.substr(F.lit(1), left), d.substr(left + 1, right), size(left), size(right), key, kind)
    joined = F.transform(F.array(new), lambda s: F.concat(F.lpad(s.a.cast("string"), left, F.lit("0")),
                                                          F.lpad(s.b.cast("string"), right, F.lit("0"))))
    return F.element_at(joined, 1)


def letters(text: Column, alphabets: tuple[str, ...], key: str, kind: str) -> Column:
    """A string permuted among those with the same alphabet at each place; signs that are in no
    alphabet stay. Halves of more than 32 signs use their hash again from the start."""
    def shifted(half: Column, digest: Column) -> Column:
        def one(c: Column, j: Column, digest: Column) -> Column:
            by = F.conv(digest.substr(F.pmod(j, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = None
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                new = F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
                out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
            return out.otherwise(c)

        return bound(digest, lambda own: F.array_join(
            F.transform(F.split(half, ""), lambda c, j: one(c, j, own)), ""))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 1, shifted(s.a, _hash(key, kind, i, s.b))).otherwise(s.a).alias("a"),
                        F.when(i % 2 == 0, shifted(s.b, _hash(key, kind, i, s.a))).otherwise(s.b).alias("b"))

    left = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), left).alias("a"),
                     text.substr(left + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s.a, s.b))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def filled(shape: Column, d: Column) -> Column:
    """The shape with its digits replaced by those of ``d``, in order."""
    return F.array_join(F.zip_with(F.split(shape, "[0-9]", -1), F.split(d, ""), lambda gap, c: F.concat(
        gap, F.coalesce(c, F.lit("")))), "")


def check_sum(d: Column) -> Column:
    """Sum of digits, every second from the right, the last not among them, doubled and cast out."""
    def add(total: Column, i: Column) -> Column:
        v = d.substr(F.length(d) - i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def card(value: Column, key: str) -> Column:
    """Keeps the first digit, permutes the others and sets the check digit anew."""
    d = only_digits(value)
    body = F.concat(d.substr(F.lit(1), F.lit(1)),
                    digits(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
    closed = F.concat(body, F.pmod(-check_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(F.pmod(check_sum(d), F.lit(10)) == 0, filled(value, closed)).otherwise(value)


def cards(run: Column, key: str) -> Column:
    """A run of digit groups in parts (old, new), the cards in it replaced.

    From the left, a card is one group of 13 to 19 digits, or several of at least three digits each
    (four of four, or else the most) that have so many together; its check digit must hold. If
    there is none, the run as a whole is tried, however it is grouped.
    """
    return bound(F.struct(F.split(run, "[ -]").alias("groups"), F.split(run, "[0-9]+").alias("gaps")),
                 lambda cut: _cards(run, cut.groups, cut.gaps, key))


def _cards(run: Column, groups: Column, gaps: Column, key: str) -> Column:
    n = F.size(groups)

    def written(i: Column, size: Column) -> Column:
        """Groups i (from 0) and on as they are written, without the sign before them."""
        return F.array_join(F.transform(F.sequence(i, i + size - 1), lambda j: F.concat(
            F.when(j > i, F.get(gaps, j)).otherwise(F.lit("")), F.get(groups, j))), "")

    def is_card(own: Column, d: Column) -> Column:
        formed = (F.size(own) == 1) | F.forall(own, lambda g: F.length(g).between(3, 12))
        return F.when(F.length(d).between(13, 19) & formed, F.pmod(check_sum(d), F.lit(10)) == 0).otherwise(F.lit(False))

    def best(i: Column) -> Column:
        """How many groups from i on are a card, 0 if none are."""
        found = F.filter(F.sequence(F.lit(1), F.least(n - i, F.lit(6))), lambda size: bound(
            F.slice(groups, i + 1, size), lambda own: bound(F.array_join(own, ""), lambda d: is_card(own, d))))
        four = F.forall(F.slice(groups, i + 1, F.lit(4)), lambda g: F.length(g) == 4)
        return bound(found, lambda sizes: F.when(F.array_contains(sizes, 4) & four, F.lit(4)).otherwise(
            F.coalesce(F.array_max(sizes), F.lit(0))))

    def step(s: Column, i: Column) -> Column:
        return F.when(i < s.after, s).otherwise(bound(best(i), lambda size: F.struct(
            (i + F.greatest(size, F.lit(1))).alias("after"),
            F.concat(s.parts, F.array(F.struct(i.alias("at"), size.alias("size")))).alias("parts"))))

    def block(s: Column, first: Column) -> Column:
        """A list that grows is copied with each part, so that of a block stands beside those before it."""
        own = F.struct(s.after.alias("after"), F.array().cast("array<struct<at:int,size:int>>").alias("parts"))
        return bound(F.aggregate(F.sequence(first, F.least(first + BLOCK, n) - 1), own, step), lambda b: F.struct(
            b.after.alias("after"), F.concat(s.blocks, F.array(b.parts)).alias("blocks")))

    start = F.struct(F.lit(0).alias("after"), F.array().cast("array<array<struct<at:int,size:int>>>").alias("blocks"))
    found = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), start, block, lambda s: F.flatten(s.blocks))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.when(F.length(only_digits(run)) <= 19, n).otherwise(0).alias("size")))
    parts = bound(found, lambda x: F.when(F.exists(x, lambda p: p["size"] > 0) | (F.get(whole, 0)["size"] == 0), x)
                  .otherwise(whole))
    texts = F.transform(parts, lambda p: F.struct(
        F.when(p.at > 0, F.get(gaps, p.at)).otherwise(F.lit("")).alias("gap"),
        written(p.at, F.greatest(p["size"], F.lit(1))).alias("old"), (p["size"] > 0).alias("hit")))
    return F.transform(texts, lambda p: F.struct(
        F.concat(p.gap, p.old).alias("old"),
        F.concat(p.gap, F.when(p.hit, card(p.old, key)).otherwise(p.old)).alias("new")))


def phone(value: Column, key: str) -> Column:
    """Keeps all but the last nine digits, so that a number stays linked however it is written."""
    d = only_digits(value)
    kept = F.greatest(F.length(d) - 9, F.lit(0))
    return filled(value, F.concat(d.substr(F.lit(1), kept), digits(d.substr(kept + 1, F.lit(9)), key, "phone")))


def social(value: Column, key: str) -> Column:
    """Permutes the numbers that can be issued: area 1 to 899 but 666, group and serial not zero."""
    part = lambda i: F.split(value, "-").getItem(i).cast("int")
    area = part(0) - F.when(part(0) > 666, 2).otherwise(1)
    new = feistel(area, (part(1) - 1) * 9999 + part(2) - 1, F.lit(898), F.lit(99 * 9999), key, "social")

    def text(s: Column) -> Column:
        back = s.a + F.when(s.a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(back.cast("string"), 3, "0"),
                           F.lpad((F.floor(s.b / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((F.pmod(s.b, F.lit(9999)) + 1).cast("string"), 4, "0"))

    valid = (area >= 0) & (area < 898) & (part(0) != 666) & (part(1) > 0) & (part(2) > 0)
    return F.when(valid, F.element_at(F.transform(F.array(new), text), 1)).otherwise(value)


def address(value: Column, key: str) -> Column:
    part = lambda i: F.split(value, r"\.").getItem(i).cast("int")
    valid = F.forall(F.split(value, r"\."), lambda p: p.cast("int") < 256)
    size = F.lit(65_536)
    new = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), size, size, key, "address")
    text = F.transform(F.array(new), lambda s: F.concat_ws(
        ".", *[F.floor(x / 256).cast("string") if high else F.pmod(x, F.lit(256)).cast("string")
               for x in (s.a, s.b) for high in (True, False)]))
    return F.when(valid, F.element_at(text, 1)).otherwise(value)


def date(value: Column, pattern: str, key: str) -> Column:
    m, n = DATE_HALVES
    day = F.datediff(F.to_date(F.try_to_timestamp(value, F.lit(pattern))), F.lit(FIRST_DAY).cast("date"))
    new = feistel(F.floor(day / n), F.pmod(day, F.lit(n)), F.lit(m), F.lit(n), key, "date")
    text = F.transform(F.array(new), lambda s: F.date_format(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (s.a * n + s.b).cast("int")), pattern))
    return F.when((day >= 0) & (day < m * n), F.element_at(text, 1)).otherwise(value)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ANY but a run of digits (see ``cards``); a value that fails its
    check stays as it is."""
    local = F.substring_index(value, "@", 1)
    is_ = lambda pattern: value.rlike(f"^(?:{pattern})$")
    classes = (DIGITS, LOWER, UPPER)
    return (F.when(F.instr(value, "@") > 0, F.concat(letters(local, classes, key, "mail"),
                                                     value.substr(F.length(local) + 1, F.length(value))))
            .when(is_(r"AKIA[0-9A-Z]{16}"), F.concat(F.lit("AKIA"), letters(
                value.substr(F.lit(5), F.lit(16)), classes, key, "secret")))
            .when(is_(r"\d{4}-\d{2}-\d{2}"), date(value, "yyyy-MM-dd", key))
            .when(is_(r"\d{2}/\d{2}/\d{4}"), date(value, "dd/MM/yyyy", key))
            .when(is_(r"\d{3}-\d{2}-\d{4}"), social(value, key))
            .when(is_(r"(?:\d{1,3}\.){3}\d{1,3}"), address(value, key))
            .when(is_(NUMBER), phone(value, key))
            .when(is_(r"[0-9a-f]+"), letters(value, (HEX,), key, "secret"))
            .otherwise(letters(value, classes, key, "secret")))


def pseudonymised(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """The rows with personal values in ``text`` replaced, and the number of values that changed
    in the column ``count`` if one is named (replacing one of that name).

    Values: mail addresses (their local part), network addresses, phone, card and social security
    numbers, dates from 1900 on, access keys, passwords and tokens. Numbers and dates are checked
    first (check digit, ranges, calendar). Each is permuted within its format under ``key``, so
    the same value gets the same pseudonym in every document, and only the key undoes it.
    A null text stays null; texts without such values, empty texts and other columns stay as they are.
    """
    text = F.col("text")

    def replaced(gap: Column, v: Column) -> Column:
        """A match and what stands before it, the match replaced, and how many values changed; what follows the last
        match stands before none."""
        parts = F.when(v.rlike(RUN) & ~gap.rlike(r"(?:password=|token = \")$"), cards(v, key)).otherwise(
            F.array(F.struct(v.alias("old"), pseudonym(v, key).alias("new"))))
        return F.when(v.isNull(), F.struct(gap.alias("text"), F.lit(0).alias("n"))).otherwise(bound(
            parts, lambda p: F.struct(F.concat(gap, F.array_join(p.new, "")).alias("text"),
                                      F.size(F.filter(p, lambda x: x.old != x.new)).alias("n"))))

    pieces = F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)
    new = fresh_name(docs, "new")
    marked = docs.withColumn(new, F.when(text.rlike(MAYBE), bound(pieces, lambda p: F.struct(
        F.array_join(p.text, "").alias("text"), F.aggregate(p.n, F.lit(0), lambda a, n: a + n).alias("n")))))
    out = {count if count and name.lower() == count.lower() else name: column
           for name, column in zip(docs.columns, columns_of(docs))}
    out["text"] = F.coalesce(F.col(new).text, text)
    if count:
        out[count] = F.coalesce(F.col(new).n, F.lit(0))
    return marked.select(*[column.alias(name) for name, column in out.items()])
