"""Repair of the structure of conversations as a lightest derivation, found with an agenda."""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import slices

SPACE = " \t\n\v\f\r"
ENDS = ".!?"
#: What an edit costs, and what a kept or reroled row without an end adds.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: From what stands so far (nothing, s, u or a last) by the next role initial; u s? (ua)* may go on, "" and a may end.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FINAL = ("", "a")
#: Texts of a conversation above so many bytes wait on disk; shapes of conversations remembered by a worker.
IN_MEMORY, REMEMBERED, SHORT = 16_000_000, 50_000, 64


class Audits:
    """Strings of edits as paths of a trie, compared as text without being written out.

    Equal strings are one node. Every node knows an ancestor further up at a depth that depends on its own depth
    alone, so that two strings are compared in steps that grow with the logarithm of their length.
    """

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.jump = [0], [""], [0], [0]
        self.known: dict[tuple[int, str], int] = {}

    def add(self, node: int, letter: str) -> int:
        """The string ``node`` with ``letter`` behind it."""
        at = self.known.get((node, letter))
        if at is None:
            at = self.known[node, letter] = len(self.parent)
            up = self.jump[node]
            far = self.depth[node] - self.depth[up] == self.depth[up] - self.depth[self.jump[up]]
            self.parent.append(node)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.jump.append(self.jump[up] if far and node else node)
        return at

    def cut(self, node: int, depth: int) -> int:
        """The first ``depth`` letters."""
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def less(self, a: int, b: int) -> bool:
        x, y = self.cut(a, self.depth[b]), self.cut(b, self.depth[a])
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = ((self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y]
                    else (self.parent[x], self.parent[y]))
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Value:
    """(cost, audit), the order in which items are popped."""

    __slots__ = ("cost", "audit", "audits")

    def __init__(self, cost: int, audit: int, audits: Audits) -> None:
        self.cost, self.audit, self.audits = cost, audit, audits

    def __lt__(self, other: Value) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        return self.audit != other.audit and self.audits.less(self.audit, other.audit)


def edits(initial: str, fault: str) -> list[tuple[str, str, int]]:
    """(letter, role initial put out, cost) of what may become of a row; ``fault`` is x for rows that must go,
    t for those without an end."""
    out = [("D", "", DELETE)]
    if fault != "x":
        more = UNFINISHED if fault == "t" else 0
        out += [("K", initial, KEEP + more)] if initial else []
        out += [("R", r, REROLE + more) for r in ROLES]
    return out


def lightest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The least (cost, audit) that turns rows of (role initial, fault) into ``(s?(ua)+)?``.

    Items are prefixes (i, last) - the first i rows are dealt with and the role last put out is known - and the edits
    at row i. A prefix and an edit derive a prefix: the costs are added, the edit's letter follows the
    prefix's audit. Values are (cost, audit); an edit at row i counts as (its cost, i times K and its letter),
    as if all before it had been kept. So a derived value is never below that of either tail: where the prefix costs
    nothing, its audit is i times K, and where it costs something, the sum is above the edit's. The
    function also keeps the order of its arguments, as audits of one item and one cost never begin with one another
    (each further letter of one item is an insertion, which costs). With such superior functions the first
    pop of an item has its least value, and the search ends when the goal is popped.
    """
    audits, n = Audits(), len(rows)
    kept = [0]                                    # i times K
    best: dict[tuple, Value] = {}                 # finalised prefixes
    at_row: dict[int, list[tuple]] = {}           # finalised edits of a row: (letter, role, cost)
    ready: dict[int, list[str]] = {}              # what the finalised prefixes of a row put out last
    agenda: list[tuple[Value, int, tuple]] = []
    count = 0

    def push(cost: int, audit: int, item: tuple) -> None:
        nonlocal count
        count += 1
        heapq.heappush(agenda, (Value(cost, audit, audits), count, item))

    def derive(i: int, last: str, edit: tuple[str, str, int]) -> None:
        letter, role, cost = edit
        then = last if letter == "D" else NEXT.get((last, role))
        if then is not None:
            value = best[i, last]
            item = (i if letter == "I" else i + 1, then)
            if item not in best:
                push(value.cost + cost, audits.add(value.audit, letter), ("prefix", *item))

    push(0, 0, ("prefix", 0, ""))
    while agenda:
        value, _, (kind, i, what) = heapq.heappop(agenda)
        if kind == "goal":
            return value.cost, audits.text(value.audit)
        if kind == "edit":
            at_row[i].append(what)
            for last in ready[i]:
                derive(i, last, what)
            continue
        if (i, what) in best:
            continue
        best[i, what] = value
        if i not in at_row:                       # the row is reached: its edits are axioms
            at_row[i], ready[i] = [], []
            while len(kept) <= i:
                kept.append(audits.add(kept[-1], "K"))
            own = [("I", r, INSERT) for r in ROLES] + (edits(*rows[i]) if i < n else [])
            for edit in own:
                push(edit[2], audits.add(kept[i], edit[0]), ("edit", i, edit))
        ready[i].append(what)
        for edit in at_row[i]:
            derive(i, what, edit)
        if i == n and what in FINAL:
            push(value.cost, value.audit, ("goal", n, what))
    raise AssertionError("every conversation can be deleted")


class Conversation:
    """What is kept of the rows of one conversation while they stream by, in order of turn."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.roles, self.faults, self.sizes = conv_id, [], [], []
        self.seen: set[bytes] = set()
        self.first = self.last = None
        self.turns = 0
        self.texts = tempfile.SpooledTemporaryFile(IN_MEMORY)

    def add(self, turn: int | None, role: str | None, text: str | None) -> None:
        role, text = " " if role is None else role, " " if text is None else text
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        body = text.encode("utf-8")
        mark = xxhash.xxh3_128_digest(len(role).to_bytes(8, "big") + role.encode("utf-8") + body)
        shown = text.rstrip(SPACE)
        fault = ("blank" if not shown else "duplicate" if mark in self.seen
                 else "truncated" if shown[-1] not in ENDS else "")
        self.seen.add(mark)
        self.roles.append(role)
        self.faults.append(fault)
        self.sizes.append(len(body))
        self.texts.write(body)

    def shape(self) -> tuple[tuple[str, str], ...]:
        short = {"blank": "x", "duplicate": "x", "truncated": "t", "": ""}
        return tuple((r[:1] if r[:1] in ("s", "u", "a") else "", short[f]) for r, f in zip(self.roles, self.faults))

    def illegal(self) -> int:
        initials = [r[:1] for r in self.roles]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def repaired(self, audit: str) -> Iterator[tuple[str, bytes]]:
        """(role, text) of the repaired rows; the audit tells all, as the next role is u or a by what stands."""
        self.texts.seek(0)
        i, last = 0, ""
        for letter in audit:
            if letter == "I":
                body, role = b"", ROLES["a" if last == "u" else "u"]
            else:
                body, role = self.texts.read(self.sizes[i]), self.roles[i]
                i += 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = ROLES["a" if last == "u" else "u"]
            last = role[:1]
            yield role, body


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, int, str]]:
    """Each conversation of rows sorted by conversation and turn, with its cost and audit."""
    known: dict[tuple, tuple[int, str]] = {}

    def judged(one: Conversation) -> tuple[Conversation, int, str]:
        shape = one.shape()
        if len(shape) > SHORT:
            return one, *lightest(list(shape))
        if shape not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[shape] = lightest(list(shape))
        return one, *known[shape]

    now = None
    for batch in slices(batches):
        for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield judged(now)
                    now.texts.close()
                now = Conversation(conv_id)
            now.add(turn, role, text)
    if now is not None:
        yield judged(now)
        now.texts.close()


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"),
                                F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repairs(conversations: DataFrame) -> DataFrame:
    """A row per conversation: what is wrong with it and the cheapest repair.

    conv_id, n_rows, gaps (turns missing between first and last), blank, duplicate, truncated (rows by their first
    fault: nothing but white space; role and text seen before; last visible character none of . ! ?), illegal
    (neighbouring role initials other than su, ua, au), cost and audit of the repair, and repaired_sha256 of
    its ``role:text`` lines. Edits are Keep (0), Rerole to user or assistant (2), Delete (3; rows blank or
    duplicate must go) and Insert of an empty user or assistant turn (2); a row without an end that stays
    costs 1 more. The repaired role initials read ``(s?(ua)+)?``. The audit is the first letters of the edits, of
    equally cheap ones the least as text.

    Rows are taken by turn, those without one first, then by role and text. Null roles and texts count as one
    space; a role that begins with none of s, u, a cannot be kept. Rows of a null conv_id are one conversation.
    Repeated rows are duplicates; an empty table gives no rows; other columns are ignored, whatever their names.
    A conversation is repaired in one task, of which memory holds some 100 bytes a row: longer texts wait on disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for one, cost, audit in _conversations(batches):
            digest = hashlib.sha256()
            for k, (role, body) in enumerate(one.repaired(audit)):
                digest.update(b"\n" * (k > 0) + role.encode("utf-8") + b":")
                digest.update(body)
            counts = [one.faults.count(f) for f in ("blank", "duplicate", "truncated")]
            out.append((one.conv_id, len(one.roles), one.gaps(), *counts, one.illegal(), cost, audit,
                        digest.hexdigest()))
            if len(out) == 4096:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    names = ["n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    kind = conversations.schema["conv_id"].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int64()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * (len(names) + 1)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [id_type, *kinds])],
                               names=["conv_id", *names])

    id_sql = "string" if kind.simpleString() == "string" else "long"
    frame = _sorted(conversations.withColumn("conv_id", F.col("conv_id").cast(id_sql)))
    return frame.mapInArrow(run, f"conv_id {id_sql}, n_rows long, gaps long, blank long, duplicate long, "
                                 "truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role and text. Rules are those of ``repairs``."""
    id_sql = "string" if conversations.schema["conv_id"].dataType.simpleString() == "string" else "long"
    id_type = pa.string() if id_sql == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for one, _, audit in _conversations(batches):
            for k, (role, body) in enumerate(one.repaired(audit)):
                rows.append((one.conv_id, k, role, body.decode("utf-8")))
                held += len(body) + 50
                if held > IN_MEMORY // 4:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in
                                zip(zip(*rows), (id_type, pa.int64(), pa.string(), pa.string()))],
                               names=["conv_id", "position", "role", "text"])

    frame = _sorted(conversations.withColumn("conv_id", F.col("conv_id").cast(id_sql)))
    return frame.mapInArrow(run, f"conv_id {id_sql}, position long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fifth of the rows spoilt, by the crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 takes out its . ! ?, 3 repeats it, 4 sets its role to user. Nulls count as
    one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                                kind.alias("damage")).where("damage <> 0")
    text = (F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ENDS, ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
