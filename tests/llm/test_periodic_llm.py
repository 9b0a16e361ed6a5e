"""Periodic runs against all pairs of words, and the digests of the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from costweave.llm import periodic, queries
from hypothesis import given, settings, strategies as st

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(words):
    """(start, length, period) by comparing every word with every later one."""
    n, found = len(words), {}
    for d in range(1, n // 2 + 1):
        at = 0
        while at < n - d:
            end = at
            while end < n - d and words[end] == words[end + d]:
                end += 1
            if end > at and end + d - at >= max(12, 2 * d):
                found.setdefault((at, end + d), d)
            at = end + 1
    return sorted(((a, b - a, d) for (a, b), d in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def ours(*texts):
    return [[tuple(map(int, r)) for r in rows] for rows in periodic.text_runs(list(texts))]


def repetitive(seed):
    draw = random.Random(seed)
    words = [draw.randrange(draw.choice([1, 2, 3, 5, 30])) for _ in range(draw.choice([0, 11, 12, 13, 30, 90, 160]))]
    for _ in range(draw.randrange(4)):
        if len(words) > 14:
            a = draw.randrange(len(words))
            p = draw.randrange(1, max(2, (len(words) - a) // 2 + 1))
            for i in range(a, min(len(words), a + p * draw.randrange(1, 6))):
                words[i] = words[a + (i - a) % p]
    return [b"%d" % w for w in words]


def test_runs_equal_those_of_all_pairs():
    texts = [repetitive(s) for s in range(400)]
    for at in range(0, 400, 40):       # several texts share a row of codes
        assert ours(*texts[at:at + 40]) == [plain(t) for t in texts[at:at + 40]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=70))
def test_runs_of_two_words(words):
    assert ours(words)[0] == plain(words)


def test_blocks_of_a_longest_size(monkeypatch):
    monkeypatch.setattr(periodic, "LONGEST", 4)
    monkeypatch.setattr(periodic, "AT_ONCE", 64)
    for seed in range(60):
        assert ours(repetitive(seed))[0] == plain(repetitive(seed))


def test_transform_multiplies_exactly():
    draw = np.random.default_rng(3)
    a, b = (draw.integers(0, periodic.PRIME, (3, 32)).astype(np.uint64) for _ in range(2))
    got = periodic.inverse_ntt(periodic.ntt(a) * periodic.ntt(b) % np.uint64(periodic.PRIME))
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
        want = [sum(x[i] * y[(k - i) % 32] for i in range(32)) % periodic.PRIME for k in range(32)]
        assert z == want


def test_long_texts_take_linear_time():
    assert ours([b"w"] * 60_000)[0] == [(0, 60_000, 1)]
    unit = [b"%d" % i for i in range(9_000)]
    assert ours(unit * 3 + unit[:50])[0] == [(0, 27_050, 9_000)]


def test_operator_on_odd_texts(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    clash = odd_docs.withColumns({"runs": F.lit(1), "n_words": F.lit("x"), "a.b": F.lit(2)})
    rows = periodic.periodic_runs(clash).collect()
    assert len(rows) == odd_docs.count() and periodic.periodic_runs(no_docs).count() == 0
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for row in rows:
        words = WORD.findall((texts[row.doc_id] or "").encode())
        if len(words) > 1000:
            assert [tuple(r) for r in row.runs] == [(0, len(words), 1)] and row.collapsed == "word"
            continue
        assert row.n_words == len(words) and [tuple(r) for r in row.runs] == plain(words)
        assert row.collapsed.encode() == b" ".join(kept(words, plain(words)))


def digest(doc_id, text):
    """The query's row in plain Python."""
    words = WORD.findall((text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    seen = {}
    words = [seen.setdefault(w, w) for w in words]
    runs = plain([id(w) for w in words]) if n < 4000 else [
        tuple(map(int, r)) for r in periodic.text_runs([words])[0]]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest())


def test_query_equals_plain_python(spark, docs):
    short = docs.where("length(text) < 9000 OR text IS NULL").limit(150)
    want = {r.doc_id: digest(r.doc_id, r.text) for r in short.collect()}
    got = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == docs.count() and any(v[1] for v in want.values())
    assert {k: got[k] for k in want} == want


def test_tails_of_odd_documents(spark, odd_docs):
    import zlib as z
    hit = next(i for i in range(10_000) if z.crc32(b"%d" % i) % 10 == 0)
    df = spark.createDataFrame([(hit, t) for t in (None, "", " \n", "one", " one two\tthree ")] + [(None, "a b c")],
                               "doc_id long, text string")
    rows = periodic.with_periodic_tails(df).collect()
    assert [r.text for r in rows][:4] == [None, "", " \n", "one"] and rows[5].text == "a b c"
    assert digest(hit, " one two\tthree ")[1] == 0 and len(rows[4].text.split(" ")) == 3
