"""Repairs of conversations against all strings of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from costweave.llm import queries, repair

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def by_brute_force(rows, most=3):
    """The least (cost, audit) over every string of edits with up to ``most`` insertions."""
    best = None
    for places in itertools.product(*[[0, 1, 2]] * (len(rows) + 1)):
        if sum(places) > most:
            continue
        steps = []
        for i in range(len(rows) + 1):
            steps += [[("I", "u", 2), ("I", "a", 2)]] * places[i]
            if i < len(rows):
                initial, fault = rows[i]
                more = fault == "t"
                own = [("D", "", 3)]
                if fault != "x":
                    own += [("R", "u", 2 + more), ("R", "a", 2 + more)]
                    own += [("K", initial, 0 + more)] if initial else []
                steps.append(own)
        for way in itertools.product(*steps):
            if GOOD.match("".join(w[1] for w in way)):
                value = (sum(w[2] for w in way), "".join(w[0] for w in way))
                best = value if best is None or value < best else best
    return best


def by_layers(rows):
    """The same for longer ones: the least value of each state, row by row, audits written out."""
    def inserted(states):
        for _ in range(3):
            for last, (c, a) in list(states.items()):
                for r in "ua":
                    if (then := repair.NEXT.get((last, r))) is not None:
                        new = (c + 2, a + "I")
                        if then not in states or new < states[then]:
                            states[then] = new
        return states

    now = inserted({"": (0, "")})
    for initial, fault in rows:
        out = {}
        for last, (c, a) in now.items():
            ways = [("D", last, 3)]
            if fault != "x":
                more = fault == "t"
                ways += [("K", repair.NEXT.get((last, initial)), more)] if initial else []
                ways += [("R", repair.NEXT.get((last, r)), 2 + more) for r in "ua"]
            for letter, then, cost in ways:
                if then is not None:
                    new = (c + cost, a + letter)
                    if then not in out or new < out[then]:
                        out[then] = new
        now = inserted(out)
    return min(now[s] for s in ("", "a") if s in now)


ROW = [(i, f) for i in ("s", "u", "a", "") for f in ("", "t", "x")]


def test_every_short_conversation():
    for n in range(3):
        for rows in itertools.product(ROW, repeat=n):
            assert repair.lightest(list(rows)) == by_brute_force(rows), rows
    draw = random.Random(5)
    for _ in range(60):
        rows = [draw.choice(ROW) for _ in range(3)]
        assert repair.lightest(rows) == by_brute_force(rows), rows


def test_longer_conversations():
    draw = random.Random(6)
    for _ in range(400):
        rows = [draw.choice(ROW) for _ in range(draw.randrange(4, 25))]
        assert repair.lightest(rows) == by_layers(rows), rows


def test_a_very_long_conversation():
    draw = random.Random(7)
    rows = [draw.choice(ROW) for _ in range(3_000)]
    assert repair.lightest(rows) == by_layers(rows)


def test_audits_compare_as_text():
    draw, audits = random.Random(8), repair.Audits()
    texts = ["".join(draw.choice("DK") for _ in range(draw.randrange(40))) for _ in range(120)]
    nodes = []
    for t in texts:
        node = 0
        for letter in t:
            node = audits.add(node, letter)
        nodes.append(node)
    for (a, x), (b, y) in itertools.product(zip(texts, nodes), repeat=2):
        assert audits.text(x) == a and audits.less(x, y) == (a < b)


def plain(rows):
    """The query's columns for (turn, role, text) rows of one conversation, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(repair.SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                      else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    shape = [(r[:1] if r[:1] in ("s", "u", "a") else "", {"": "", "truncated": "t"}.get(f, "x"))
             for (_, r, _), f in zip(rows, faults)]
    cost, audit = by_layers(shape)
    out, left, last = [], list(rows), ""
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else left.pop(0)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def spoilt(rows):
    out = []
    for conv_id, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        role, text = one(role), one(text)
        kind = zlib.crc32(f"{one(conv_id)}:{one(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    left = {c: [] for c, *_ in rows}
    for c, *row in spoilt(rows):
        left[c].append(tuple(row))
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert got == {c: plain(r) for c, r in left.items()}


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "tool", "x"), (1, None, "", "y."),
            (1, 5, "system", "s."), (1, 9, "user", "?"), (1, 9, "user", "?"), (2, 1, "assistant", "  \n"),
            (2, 2, "user", "word " * 50_000)]
    rows += [(100 + c, t, "user", "a.") for c in range(60) for t in range(1)]      # some lose their only row
    schema = "conv_id long, turn long, role string, text string, audit int, `a.b` int"
    spark.createDataFrame([(*r, 1, 2) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    left = {c: [] for c, *_ in rows}
    for c, *row in spoilt(rows):
        left[c].append(tuple(row))
    assert any(not r for r in left.values())
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain(r) for c, r in left.items()}
    assert got[next(c for c, r in left.items() if not r)] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], schema)
    assert repair.repairs(empty).count() == 0 and repair.repaired_rows(empty).count() == 0


def test_repaired_rows_are_well_formed(spark, monkeypatch):
    rows = repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    digest = {r.conv_id: r.repaired_sha256 for r in repair.repairs(rows).collect()}
    out = {}
    for r in repair.repaired_rows(rows).orderBy("conv_id", "position").collect():
        out.setdefault(r.conv_id, []).append(r)
    for c, own in out.items():
        assert GOOD.match("".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest[c]


def test_conversation_ids_of_text(spark):
    df = spark.createDataFrame([("x", 0, "user", "a."), ("x", 1, "user", "b."), ("y", 0, "assistant", "c.")],
                               "conv_id string, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repairs(df).collect()}
    # K K needs an answer after each question; an assistant's turn needs a question before.
    assert got == {"x": (2, "KR"), "y": (2, "IK")}
