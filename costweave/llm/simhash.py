"""Near-duplicates by 64-bit SimHash, with covering masks that miss no close pair."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from costweave.llm.components import connected
from costweave.llm.shared import (columns_of, forget_others, fresh_name, passing_tables, slices, small_batches, with_maybe,
                                  words, written)

#: Fingerprints of one bucket that are compared with each other directly.
DIRECT = 512


def fingerprint(tokens: list[bytes], width: int = 4, seed: int = 42) -> int:
    """The bits set in over half the hashes of the word shingles, repeats included."""
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - width + 1
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:n - 1] + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())),
                         np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            fp = np.array([fingerprint(words(t), width, seed)
                           for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fp.view(np.int64))],
                                  names=["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, fp long"))


def covering_masks(radius: int, bits: int = 64, seed: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` positions are outside one of them all.

    Each position gets a non-zero vector of radius + 1 bits, and mask v takes the positions
    whose vector has odd overlap with v. At most ``radius`` vectors leave a non-zero v that
    overlaps none of them oddly, so two values that differ in those positions agree under v.
    """
    total = (1 << radius + 1) - 1
    order = list(range(bits))
    random.Random(seed).shuffle(order)
    vector = {position: 1 + i % total for i, position in enumerate(order)}
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2)
            for v in range(1, total + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(bucket: Column, fp: Column, masks: list[int]) -> Column:
    """A key for each mask: the bucket, the table and the masked bits, hashed."""
    return F.array(*[F.xxhash64(bucket, F.lit(t), fp.bitwiseAND(F.lit(_signed(m)).cast("long")))
                     for t, m in enumerate(masks)])


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; numpy counts those of the absolute value unless the type is unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) that join all of ``fps`` that are within ``radius``, directly or in steps."""
    near = differing(fps[:, None], fps[None, :]) <= radius
    left = np.ones(len(fps), bool)
    out = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            a = todo.pop()
            found = np.flatnonzero(near[a] & left)
            left[found] = False
            out += [(a, int(b)) for b in found]
            todo += found.tolist()
    return out


def _scan(radius: int):
    """Over rows sorted by (key, fp): links within runs of one key. A run longer than DIRECT is
    given out again, row by row, to be split by further masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large: int | None = None

        def rows(links, hot) -> pa.RecordBatch:
            a = np.concatenate([x for x, _ in links] or [fp[:0]])
            b = np.concatenate([y for _, y in links] or [fp[:0]])
            hot_key = np.concatenate([k for k, _ in hot] or [fp[:0]])
            hot_fp = np.concatenate([x for _, x in hot] or [fp[:0]])
            return pa.record_batch([np.r_[np.zeros(len(a), bool), np.ones(len(hot_key), bool)],
                                    np.r_[a, hot_key], np.r_[b, hot_fp]], names=["hot", "a", "b"])

        def within(k, x):
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            size, links, hot = np.diff(cut), [], []
            two = cut[:-1][size == 2]
            near = two[differing(x[two], x[two + 1]) <= radius]
            links.append((x[near], x[near + 1]))
            for i in np.flatnonzero(size > 2).tolist():
                part = x[cut[i]:cut[i + 1]]
                if len(part) > DIRECT:
                    hot.append((k[cut[i]:cut[i + 1]], part))
                elif pairs := np.array(forest(part, radius), np.int64).reshape(-1, 2).T.tolist():
                    links.append((part[pairs[0]], part[pairs[1]]))
            return rows(links, hot)

        for batch in batches:
            k = batch.column("key").to_numpy()
            x = batch.column("fp").to_numpy()
            if large is not None:      # the run goes on
                n = int(np.searchsorted(k != large, True)) if (k != large).any() else len(k)
                yield rows([], [(k[:n], x[:n])])
                k, x = k[n:], x[n:]
                if not len(k):
                    continue
                large = None
            key, fp = np.r_[key, k], np.r_[fp, x]
            if not len(key):
                continue
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            yield within(key[:last], fp[:last]) if last else rows([], [])
            key, fp = key[last:], fp[last:]
            if len(key) > DIRECT:
                yield rows([], [(key, fp)])
                large = int(key[0])
                key, fp = key[:0], fp[:0]
        if len(key):
            yield within(key, fp)

    return run


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs (a, b) that link the distinct fingerprints ``fp`` as their closeness does.

    Every pair within the radius shares a key of some mask. Small buckets are compared
    directly and give a spanning forest; a large one is dealt out again by other masks, which
    also cover every close pair in it. Each level fixes half the bits left free, so after the
    third a bucket can hold a few hundred fingerprints at most.
    """
    todo = distinct.select(F.lit(0).cast("long").alias("bucket"), "fp")
    found = None
    for level in range(4):
        keys = _keys(F.col("bucket"), F.col("fp"), covering_masks(radius, seed=level))
        scanned = written(todo.select(F.explode(keys).alias("key"), "fp").repartition("key")
                          .sortWithinPartitions("key", "fp")
                          .mapInArrow(_scan(radius), "hot boolean, a long, b long"), f"links{level}")
        own = scanned.where("NOT hot").select("a", "b")
        found = own if found is None else found.union(own)
        todo = scanned.where("hot").select(F.col("a").alias("bucket"), F.col("b").alias("fp"))
        if todo.isEmpty():
            return found.distinct()
    raise RuntimeError("a bucket stayed large under four levels of masks")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; shingles are ``width``
    words. A text of fewer words is one shingle; null and empty texts have fingerprint zero and are
    linked like any other. Rows with a null doc_id get their fingerprint and component_id null
    and link nothing. Repeated doc_ids all come back. An empty table gives no rows; other
    columns are ignored. Equal fingerprints meet as one before pairs are searched, so groups of
    copies cost no more than one document.
    """
    fps = written(fingerprints(docs, width, seed), "fingerprints")
    firsts = written(fps.where("doc_id IS NOT NULL").groupBy("fp")
                     .agg(F.min("doc_id").alias("first_doc")), "firsts")
    roots = connected(links(firsts, radius))
    whole = firsts.join(roots, firsts.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = whole.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = whole.join(smallest, "root").select("fp", "component_id")
    return (fps.join(component, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def alike_by_any(docs: DataFrame, *finds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and component_id by the links of all ``finds`` together, each giving doc_id and component_id.

    A doc_id stands for one text here. A component is linked to its smallest doc_id, so these links join the
    components of one find that share a document in another's.
    """
    spark, found = docs.sparkSession, []
    for find in finds:
        with passing_tables(spark):
            found.append(written(find(docs).select("doc_id", "component_id"), "found", kept=True))
    every = found[0].select("doc_id")
    links = reduce(DataFrame.union, found).where("doc_id <> component_id").toDF("a", "b").distinct()
    with passing_tables(spark):
        roots = written(connected(links), "roots", kept=True)
    return every.join(roots, every.doc_id == roots.node, "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **settings) -> DataFrame:
    """The documents without near-duplicates: of each component that ``find`` gives, the one of
    smallest doc_id.

    Rows are told apart by doc_id and text: a doc_id that is repeated beside other texts stays for each
    text of which it is the smallest. Of rows that repeat both one stays. Rows with a null doc_id all stay.
    """
    row, own, maybe = fresh_name(docs, "row"), F.col("doc_id").cast("long"), fresh_name(docs, "maybe")
    told = docs.withColumn(row, F.when(own.isNotNull(), F.xxhash64(own, F.col("text").cast("string"))))
    real = told.where(F.col(row).isNotNull())
    with passing_tables(docs.sparkSession), small_batches(docs.sparkSession):
        found = find(real.select(F.col(row).alias("doc_id"), "text"), **settings)
        rows = written(found.groupBy(F.col("doc_id").alias(row), "component_id").agg(F.count("*").alias("times"))
                       .join(real.select(row, own.alias("own")).distinct(), row), "rows")
        first = written(rows.groupBy("component_id").agg(F.min(F.struct("own", row, "times")).alias("first"))
                        .select("first.*"), "first")
        dropped = rows.join(first, row, "left_anti").select(row, F.lit(False).alias("again"))
        again = first.where("times > 1").select(row, F.lit(True).alias("again"))
        others = written(dropped.union(again), "others", kept=True)

    # Most documents stay as they are, and those that go are told by their numbers alone. Texts travel only where one of
    # several equal rows stays, or where the bitmap took a row for another.
    told = with_maybe(real, row, others, maybe)
    near = told.where(F.col(maybe)).drop(maybe)
    spared = written(near.select(row).distinct().join(others.select(row), row, "left_anti"), "spared", kept=True)

    def exactly(which: DataFrame) -> DataFrame:
        return (with_maybe(near, row, which, maybe).where(F.col(maybe))
                .join(which.select(row).hint("shuffle_merge"), row, "left_semi"))      # alike at every size

    out = told.where(~F.col(maybe)).select(columns_of(docs))
    if not spared.isEmpty():
        out = out.unionByName(exactly(spared).select(columns_of(docs)))
    again = others.where("again")
    if not again.isEmpty():
        out = out.unionByName(exactly(again).dropDuplicates([row]).select(columns_of(docs)))
    return out.unionByName(docs.where(own.isNull()))
