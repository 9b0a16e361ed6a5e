"""Near-duplicates by sketches against all pairs of sets."""

import itertools
import random
import re

import numpy as np
import pytest
from costweave.llm import minhash, queries, simhash
from costweave.llm.shared import with_maybe
from costweave.plans.scans import shuffled
from pyspark.sql import functions as F

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_set(text, width):
    words = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def plain_rows(rows, width):
    """doc_id -> (size, component) for unique doc_ids, by all pairs that share a shingle."""
    sets = {r.doc_id: plain_set(r.text, width) for r in rows}
    by, pairs, parent = {}, set(), {d: d for d in sets}
    for d in sorted(sets):
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    for many in by.values():
        pairs.update(itertools.combinations(many, 2))

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def ours(df, **settings):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **settings).collect()}


def family(spark, members=120, words=100, first=0):
    """Texts that change two to twelve words of one, at about the threshold in many pairs, and copies of some."""
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for n in range(members):
        own = list(base)
        for at in draw.choice(words, draw.integers(2, 13), replace=False).tolist():
            own[at] = f"x{draw.integers(30)}"
        rows.append((first + n, " ".join(own)))
    rows += [(first + members + n, rows[n][1].upper()) for n in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width", [2, 5])
def test_components_of_the_sample(spark, docs, width):
    frame = docs.select("doc_id", "text").union(family(spark, first=10**6))
    want = plain_rows(frame.collect(), width)
    assert ours(frame, width=width) == want
    assert len({c for _, c in want.values()}) < len(want) - 15


def test_query(spark, docs):
    rows = queries.op12_minhash(spark, "/root/testdata/sf0.001").collect()
    want = plain_rows(docs.collect(), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
        d: (n, c, d == c) for d, (n, c) in want.items()}


def test_small_sets(spark):
    """Pairs of exactly 4 of 5, and just below, in sets of a few shingles."""
    rows, at = [], 0
    for n in range(300):
        k = 4 + n % 9
        base = [f"a{n}_{i}" for i in range(k + 1)]
        more = {0: [f"z{n}"], 1: [f"z{n}", f"y{n}"], 2: [f"{i}z{n}" for i in range(k // 4)]}[n % 3]
        rows += [(at, " ".join(base)), (at + 1, " ".join(base + more))]
        at += 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_rows(frame.collect(), 2)
    assert ours(frame, width=2) == want
    assert 100 < len({c for _, c in want.values()}) < 600


def test_chains_and_blocks_lose_nothing(spark, monkeypatch):
    frame = family(spark)
    want = plain_rows(frame.collect(), 2)
    monkeypatch.setattr(minhash, "DIRECT", 5)
    monkeypatch.setattr(minhash, "AT_ONCE", 900)
    assert ours(frame, width=2) == want


def test_links_are_no_pairs(spark):
    """A family of n members gives at most n - 1 verified links."""
    frame = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(200)) + f" own{i}") for i in range(150)],
                                  "doc_id long, text string")
    sketched = minhash._sketched(frame, 2, 0.8).cache()
    from pyspark.sql import functions as F
    firsts = sketched.groupBy("digest").agg(F.min("doc_id").alias("first_doc")).withColumn(
        "node", F.col("first_doc")).cache()
    assert minhash.links(frame, firsts, sketched, 0.8, 2).count() == 149


def test_sketches_agree_as_often_as_sets_overlap():
    draw = np.random.default_rng(5)
    for size, overlap in ((3, 2), (20, 16), (300, 240), (5000, 2500)):
        agree = []
        for _ in range(20):
            all_ = draw.integers(0, 2**63, 2 * size - overlap).astype(np.uint64)
            table = minhash.sketches([np.sort(all_[:size]), np.sort(all_[size - overlap:])])
            assert (table != np.uint64(minhash.M64)).all()
            agree.append((table[0] == table[1]).mean())
        assert abs(np.mean(agree) - overlap / (2 * size - overlap)) < 0.04
    assert (minhash.sketches([np.array([7], np.uint64)])[0] >> np.uint64(48)).max() >= 512 - 1   # filled in turn
    assert minhash.n_bands(0.8) == 24 and 400 < minhash.enough_bits(0.8) < 461
    with pytest.raises(ValueError):
        minhash.n_bands(0.1)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, width=2).collect()
    assert len(rows) == odd_docs.count() and minhash.near_duplicates(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert all(by[d].component_id == d and by[d].n_shingles == 0 for d in (0, 1, 2, 3))
    assert by[None].component_id is None and by[None].n_shingles == 3
    assert by[14].component_id == 7 and by[9].n_shingles == 1      # words are the same, spaces are not
    assert [r.component_id for r in rows if r.doc_id == 7] == [7] * 3
    same = {r.doc_id: r.component_id for r in minhash.near_duplicates(odd_docs, empty_alike=True).collect()}
    assert [same[d] for d in (0, 1, 2, 3)] == [0] * 4


@pytest.mark.parametrize("find", [minhash.near_duplicates, simhash.near_duplicates])
def test_one_of_each_decides_by_row(spark, find):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    schema = "doc_id long, text string, `row` int, `a.b` int, Component_id string"

    def kept(*rows):
        df = spark.createDataFrame([(*r, i, i, "x") for i, r in enumerate(rows)], schema)
        out = simhash.one_of_each(df, find)
        assert out.columns == df.columns
        return sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in out.collect())

    want = lambda *rows: sorted((d is not None, d or 0, t) for d, t in rows)
    assert kept((5, a), (5, b)) == want((5, a), (5, b))
    assert kept((3, a), (5, a), (5, b)) == want((3, a), (5, b))
    assert kept((3, a), (3, a), (2, a), (2, a), (None, a), (None, a), (9, c)) == want((2, a), (None, a), (None, a), (9, c))


@pytest.fixture
def many_texts(spark):
    """1,000 texts of some 2 KB, of which every 20th has a copy under another doc_id; joins do not broadcast."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(180)) for _ in range(1000)]
    rows = [*enumerate(texts), *((2000 + i, texts[i]) for i in range(0, 1000, 20)), (None, texts[1])]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    yield spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set(limit, before)


def test_only_texts_that_may_go_are_shuffled(many_texts):
    out = simhash.one_of_each(many_texts)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == list(range(1000))
    assert shuffled(out) < 500_000


def test_texts_that_go_are_not_shuffled(many_texts):
    copies = many_texts.where("doc_id < 1000").withColumn("doc_id", F.col("doc_id") + 5000)
    out = simhash.one_of_each(many_texts.union(copies))
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == list(range(1000))
    assert shuffled(out) < 500_000


@pytest.mark.parametrize("places", [1, 64])
def test_texts_that_the_bitmap_takes_for_others_stay(many_texts, monkeypatch, places):
    monkeypatch.setattr(simhash, "with_maybe", lambda *a: with_maybe(*a, places))
    twice = many_texts.where("doc_id < 3")
    out = simhash.one_of_each(many_texts.union(twice))
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == list(range(1000))
    assert out.where("doc_id IS NULL").count() == 1


def test_batches_are_small_while_texts_are_compared(many_texts):
    limit, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    spark = many_texts.sparkSession
    before = spark.conf.get(limit)

    def find(texts):
        seen.append(spark.conf.get(limit))
        return texts.select("doc_id", F.col("doc_id").alias("component_id"))

    simhash.one_of_each(many_texts, find)
    assert int(seen[0]) <= 2000 and spark.conf.get(limit) == before


def test_only_texts_of_candidates_are_shuffled(many_texts):
    wanted = many_texts.where("doc_id < 40").select(
        F.col("doc_id").alias("first_doc"), F.lit(b"").alias("digest"), F.col("doc_id").alias("node"))
    members = minhash._members(many_texts, 5, wanted)
    members.collect()
    assert shuffled(members) < 500_000


@pytest.mark.parametrize("places", [1, 64, 1 << 26])
def test_no_chosen_key_is_missed(spark, places):
    rows = spark.createDataFrame([(None if i == 7 else i, "x") for i in range(500)], "k long, `bits` string")
    told = with_maybe(rows, "k", rows.where("k % 50 = 0").select("k"), "maybe", places)
    assert told.columns == ["k", "bits", "maybe"]
    found = {r.k for r in told.where("maybe").collect()}
    assert told.count() == 500 and found >= set(range(0, 500, 50)) and (places < 1 << 26 or len(found) == 10)
    assert with_maybe(rows, "k", rows.limit(0), "maybe").where("maybe").isEmpty()
