"""SimHash components, nearest neighbours and decontamination against brute force."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from costweave.llm import decontamination, nearest, simhash
from costweave.llm.components import connected

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_the_sample(docs):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    expected = roots(sorted(fps), ((a, b) for a, b in itertools.combinations(sorted(fps), 2)
                                   if (fps[a] ^ fps[b]).bit_count() <= 4))
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        d: (f"{fp:016x}", expected[d]) for d, fp in fps.items()}
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(expected.values())


def test_odd_documents_keep_their_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == 0
    assert by[None].component_id is None
    assert by[14].component_id == 7
    assert simhash.near_duplicates(no_docs).count() == 0
    once = simhash.one_of_each(odd_docs)
    assert once.columns == odd_docs.columns
    ids = [r.doc_id for r in once.collect()]
    assert len(ids) == len(set(ids))


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2, bits=12)
    for at in itertools.combinations(range(12), 2):
        assert any(all(not m >> i & 1 for i in at) for m in masks)
    wide = simhash.covering_masks(4)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        at = rng.choice(64, 4, replace=False).tolist()
        assert any(all(not m >> i & 1 for i in at) for m in wide)
    assert all(32 <= m.bit_count() <= 34 for m in wide)


def test_a_large_bucket_is_split_without_losing_links(spark, monkeypatch):
    """Thousands of fingerprints around a few centres, more than are compared directly."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)) for b in base for _ in range(700)} | {1, 2**63 + 1})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    expected = roots(fps, ((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4))
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.links(frame).collect()]
    unsigned = lambda x: x % 2**64
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 4 for a, b in found)
    assert roots(fps, ((unsigned(a), unsigned(b)) for a, b in found)) == expected


def test_connected_chain_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def visited_share(monkeypatch, shares):
    """Notes the part of all vectors in the cells that each query visits."""
    own = nearest.traverse

    def noted(first, second, count, enough):
        cells = own(first, second, count, enough)
        shares.append(count[cells].sum() / count.sum())
        return cells

    monkeypatch.setattr(nearest, "traverse", noted)


def test_queries_visit_under_half_of_the_vectors(monkeypatch):
    """The recall below is not that of a full scan, also in a small table."""
    shares = []
    visited_share(monkeypatch, shares)
    rng = np.random.default_rng(3)
    count = rng.integers(0, 3, 64 * 64)
    for _ in range(20):
        nearest.traverse(rng.normal(size=64), rng.normal(size=64), count, int(np.ceil(nearest.MultiIndex().share * count.sum())))
    assert max(shares) < 0.5


def test_scores_of_doubles_are_exact_at_any_length(spark):
    rng = np.random.default_rng(8)
    data = {i: rng.normal(size=6) * 10.0 ** (0 if i < 200 else rng.integers(-60, 60)) for i in range(260)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    rows = nearest.search(table, F.expr("vec_id < 40"), k=5, p=nearest.MultiIndex(share=1.0)).collect()
    assert len(rows) == 200
    for q in range(40):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        exact = {i: float((v * data[q]).sum()) for i, v in data.items() if i != q}
        assert [r.vec_id for r in own] == sorted(exact, key=lambda i: (-exact[i], i))[:5]
        assert all(r.score == pytest.approx(exact[r.vec_id], rel=1e-12) for r in own)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_order(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = nearest.search(table, F.expr("vec_id % 20 = 0")).collect()
    data = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    ids = np.array(sorted(data))
    v = np.stack([data[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(own, own[1:]))
        assert all(abs(r.score - float(data[q] @ data[r.vec_id])) < 1e-9 for r in own)
        exact = v @ data[q]
        exact[ids == q] = -9
        best = set(ids[np.lexsort((ids, -exact))[:20]].tolist())
        hits, total = hits + len(best & {r.vec_id for r in own}), total + 20
    assert hits / total >= 0.9


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [0.5, 0.5], []]
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], "x"), (8, [0.5, 0.5], "y")],
                                  "vec_id long, embedding array<float>, rank string")
    rows = nearest.search(table, F.lit(True), k=3).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
           for q in {r.query_id for r in rows}}
    assert got == {0: [(1, 1.0), (8, 0.5), (8, 0.5)], 1: [(0, 1.0), (8, 0.5), (8, 0.5)], 8: [(0, 0.5), (1, 0.5)]}
    assert nearest.search(table.limit(0), F.lit(True)).count() == 0


def test_cells_come_in_falling_order():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=9)
    cells = nearest.traverse(a, b, np.ones(63, int), 63)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert len(set(cells)) == 63 and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:]))
    assert len(nearest.traverse(a, b, np.ones(63, int), 10)) == 10


def shingles(text, n=5):
    words = SPACE.findall((text or "").lower().encode())
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


def test_items_found_as_by_brute_force(spark, benchmark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = {r.item_id: shingles(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    expected = {(d, i) for d, s in texts.items() for i, x in items.items() if len(x & s) >= 0.8 * len(x)}
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == expected
    kept = {r.doc_id for r in decontamination.without_items(docs, benchmark).collect()}
    assert kept == set(texts) - {d for d, _ in expected}


def test_wand_gives_what_full_scoring_gives(benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for block in (1, 3, 16):
        index = decontamination.Index(items, decontamination.Decontamination(threshold=0.3, block=block))
        rng = np.random.default_rng(3)
        for _ in range(60):
            terms = sorted(rng.choice(len(index.terms), rng.integers(1, 60), replace=False).tolist())
            full = {}
            for t in terms:
                for number, weight in zip(index.numbers[t], index.weights[t]):
                    full[number] = full.get(number, 0.0) + weight
            expected = {n: s for n, s in full.items() if s >= 0.3}
            assert dict(index.retrieve(terms)) == pytest.approx(expected)


def test_odd_items_and_documents(spark, odd_docs, no_docs, benchmark):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (None, "x"), (1, "one two three four"),
                                   (4, "Why so? Because.")], "item_id long, text string")
    rows = decontamination.contaminated(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(None, 1), (7, 1), (14, 1)}
    assert decontamination.contaminated(no_docs, items).count() == 0
    assert decontamination.contaminated(odd_docs, items.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "filler " * 3000 + "Why so? Because. " + "filler " * 3000)], "doc_id long, text string")
    assert [r.item_id for r in decontamination.contaminated(long, items).collect()] == [4]


def plain_sets(rows, width=5):
    own = {}
    for r in rows:
        w = SPACE.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (r.text or "").encode()))
        own[r.doc_id] = {tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    return own


def test_pipeline_stage_links_what_shares_four_fifths_of_five_word_shingles(spark, docs):
    words = [f"w{i}" for i in range(400)]
    rows = [(10**6 + i, " ".join(words[40 * i:] + [f"x{i}_{j}" for j in range(40 * i)])) for i in range(4)]
    rng = np.random.default_rng(1)
    for n in range(60):                # each differs from its own text in words spread over it
        base = [f"b{n}_{i}" for i in range(300)]
        near = list(base)
        for at in range(20, 300, 60 if n % 2 else 50):
            near[at + int(rng.integers(5))] = "other"
        rows += [(2 * 10**6 + n, " ".join(base)), (3 * 10**6 + n, " ".join(near))]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    own = plain_sets(frame.collect())
    by, pairs = {}, set()
    for d, x in own.items():
        for s in x:
            by.setdefault(s, []).append(d)
    for many in by.values():
        pairs.update(itertools.combinations(sorted(set(many)), 2))
    close = [(a, b) for a, b in pairs if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    assert sum(a >= 2 * 10**6 for a, _ in close) == 60
    want = roots(list(own), close)
    kept = {r.doc_id for r in corpus_pipeline.without_copies(spark, frame, None).collect()}
    assert kept == {d for d in own if want[d] == d}


def test_pipeline_stage_links_by_fingerprints_too(spark):
    """Texts of few different shingles: their fingerprints are within 4 bits, their sets below four fifths."""
    common = " ".join(["one"] * 200)
    rows = [(1, f"{common} alpha beta gamma delta"), (2, f"{common} red green blue grey"),
            (3, " ".join(f"q{i}" for i in range(60))), (4, " ".join(f"r{i}" for i in range(60)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    own = plain_sets(frame.collect())
    assert 5 * len(own[1] & own[2]) < 4 * len(own[1] | own[2])
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(frame).collect()}
    assert ((fps[1] ^ fps[2]) % 2**64).bit_count() <= 4
    assert {r.doc_id for r in corpus_pipeline.without_copies(spark, frame, None).collect()} == {1, 3, 4}


def test_components_by_any_link(spark):
    frame = spark.createDataFrame([(i, "") for i in range(1, 8)], "doc_id long, text string")
    given = lambda pairs: lambda docs: spark.createDataFrame(pairs, "doc_id long, component_id long")
    rows = simhash.alike_by_any(frame, given([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7)]),
                                given([(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 5), (7, 7)])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}


def test_pipeline_stage_on_odd_documents(spark, odd_docs, no_docs):
    once = corpus_pipeline.without_copies(spark, odd_docs, None)
    assert once.columns == odd_docs.columns
    ids = [r.doc_id for r in once.collect()]
    assert ids.count(None) == 1 and ids.count(7) == 1 and ids.count(14) == 0 and ids.count(0) == 1
    assert corpus_pipeline.without_copies(spark, no_docs, None).count() == 0


def test_items_without_an_id_are_found_and_parts_change_no_score(spark):
    lines = [f"what number {i} has the colour c{i % 7} and the shape s{i % 5}? it is v{i} of w{i % 3}." for i in range(40)]
    items = spark.createDataFrame([(i if i % 4 else None, t) for i, t in enumerate(lines)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"begin {t} end") for i, t in enumerate(lines)] + [(99, "clean text")],
                                 "doc_id long, text string")
    whole, parts = ({(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, items, item_part=n).collect()}
                    for n in (50_000, 9))
    assert set(whole) == {(i, i if i % 4 else None) for i in range(40)}
    assert parts == pytest.approx(whole)
    assert [r.doc_id for r in decontamination.without_items(docs, items).collect()] == [99]
