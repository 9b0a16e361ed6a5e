"""Approximate nearest neighbours by inner product with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from costweave.llm.shared import written

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class MultiIndex:
    """centroids: of each half, so that cells are at most its square. sample: the most vectors
    the centroids are fitted on. share: part of all vectors whose cells a query visits; vectors
    without clusters need a large one for a recall of 0.9. shard: vectors one task compares at
    a time. queries: of one task at a time."""

    centroids: int = 128
    sample: int = 16_384
    rounds: int = 8
    share: float = 0.45
    shard: int = 16_384
    queries: int = 4_096


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec of the vectors that take part: an id, the most common length (of several
    the smallest), and no null, NaN or infinite component, and not all zeros."""
    x = F.col("vec")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    own = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                          F.col(embedding).cast("array<double>").alias("vec"))
           .where("vec_id IS NOT NULL AND vec IS NOT NULL").where(~bad)
           .where(F.exists(x, lambda v: v != 0)))
    length = (own.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("times"))
              .orderBy(F.desc("times"), "n").first())
    return own.where(F.size("vec") == (length.n if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rough(x: np.ndarray) -> np.ndarray:
    """Single precision of about unit length, which is enough to choose cells: the order of a query's cells and
    the cell of a vector do not depend on the query's length, and huge or tiny vectors stay finite."""
    scale = np.abs(x).max(axis=-1, keepdims=True)
    return (x / np.where(scale > 0, scale, 1)).astype(np.float32)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


def fit(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids of the rows; a centroid left without rows keeps its place."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centroid(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        sums = np.zeros(centroids.shape, np.float64)
        np.add.at(sums, own, x)
        centroids[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(np.float32)
    return centroids


def traverse(first: np.ndarray, second: np.ndarray, count: np.ndarray, enough: int) -> list[int]:
    """Cells in falling order of summed scores until they hold ``enough`` vectors.

    ``first`` and ``second`` are a query's scores with each half's centroids. A heap holds
    the frontier of pairs: one is offered when both pairs before it have been taken.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    wide = len(y)
    taken_in_row = [0] * len(x)          # columns taken of each row, always from the left
    heap = [(-(x[0] + y[0]), 0, 0)]
    cells, held = [], 0
    counts = count.tolist()
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * wide + b[j]
        taken_in_row[i] = j + 1
        if counts[cell]:
            cells.append(cell)
            held += counts[cell]
        if i + 1 < len(x) and taken_in_row[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < wide and (i == 0 or taken_in_row[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
    return cells


def best(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest exact inner product, ties to the smaller id, without ``own``."""
    rows = rows[ids[rows] != own]
    near = vectors[rows] @ query
    if len(rows) > k:
        slack = 1e-9 * (1 + float(np.abs(near).max()))
        rows = rows[near >= np.partition(near, len(near) - k)[len(near) - k] - slack]
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows[order]], exact[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, p: MultiIndex = MultiIndex(),
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest of each query found in the cells it visits: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id. Centroids come from a bounded sample, but every
    vector is indexed and may be found. Scores are in double precision on the original vectors. Cells are packed into shards of bounded size, and a
    cell larger than a shard is split over several. Vectors that cannot be compared (see
    ``usable``) take no part. Of a repeated vec_id every row is a candidate, except for the
    query of that id; as a query it counts once, with its smallest vector. An empty table or
    no query gives no rows; other columns are ignored.
    """
    rows = written(usable(vectors, vec_id, embedding), "vectors")
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("vec").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.stack(sample["vec"].to_numpy())
    length = float(np.median(np.abs(x).max(axis=1)))      # one scale for all, so that lengths keep their meaning

    def scaled(v: np.ndarray) -> np.ndarray:
        """What chooses a vector's cell: single precision is enough, and huge components stay finite."""
        return np.clip(v / length, -1e9, 1e9).astype(np.float32)

    x = scaled(x)
    half = x.shape[1] // 2
    c1, c2 = (fit(part, p.centroids, p.rounds, seed)
              for seed, part in enumerate((x[:, :half], x[:, half:])))
    wide, n_cells = len(c2), len(c1) * len(c2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = scaled(matrix(batch.column("vec")))
            cell = nearest_centroid(v[:, :half], c1) * wide + nearest_centroid(v[:, half:], c2)
            yield pa.record_batch([batch.column("vec_id"), pa.array(cell, pa.int32()),
                                   batch.column("vec")], names=["vec_id", "cell", "vec"])

    index = written(rows.mapInArrow(assign, "vec_id long, cell int, vec array<double>"), "cells")
    count = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():   # at most n_cells rows
        count[r.cell] = r.n
    total = int(count.sum())
    shard_of, parts = np.zeros(n_cells, np.int64), np.maximum(1, -(-count // p.shard))
    shard = held = 0
    for cell in range(n_cells):
        if held and held + count[cell] > p.shard:
            shard, held = shard + 1, 0
        shard_of[cell] = shard
        held += int(count[cell])
        if parts[cell] > 1:
            shard, held = shard + int(parts[cell]), 0
    enough = max(math.ceil(p.share * total), k + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            spread = batch.column("spread").to_numpy().astype(np.uint64)
            own = shard_of[cell] + (spread % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.record_batch([pa.array(own), batch.column("vec_id"), batch.column("cell"),
                                   batch.column("vec")], names=["shard", "vec_id", "cell", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            v = matrix(batch.column("vec"))
            for q, r, qid in zip(v, rough(v), batch.column("vec_id").to_pylist()):
                cells = np.array(traverse(c1 @ r[:half], c2 @ r[half:], count, enough))
                cells = np.repeat(cells, parts[cells])
                within = np.r_[True, cells[1:] != cells[:-1]]
                run = np.arange(len(cells)) - np.maximum.accumulate(np.where(within, np.arange(len(cells)), 0))
                own = shard_of[cells] + run
                order = np.argsort(own, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0, True])
                out += [(int(own[order[s]]), qid, q, cells[order[s:e]].astype("<i4").tobytes())
                        for s, e in zip(cut, cut[1:])]
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()),
                                   pa.array([o[1] for o in out], pa.int64()),
                                   pa.array([o[2] for o in out], pa.list_(pa.float64())),
                                   pa.array([o[3] for o in out], pa.binary())],
                                  names=["shard", "query_id", "query", "cells"])

    def compare(vectors: pa.Table, probes: pa.Table) -> pa.Table:
        vectors, found = vectors.combine_chunks(), []
        if len(vectors) and len(probes):
            ids = vectors.column("vec_id").to_numpy()
            cell = vectors.column("cell").to_numpy()
            v = matrix(vectors.column("vec").chunk(0))
            visited = np.zeros(n_cells, bool)
            for qid, q, cells in zip(*(probes.column(c).to_pylist()
                                       for c in ("query_id", "query", "cells"))):
                cells = np.frombuffer(cells, "<i4")
                visited[cells] = True
                near, score = best(np.array(q, np.float64), qid, ids, v,
                                   np.flatnonzero(visited[cell]), k)
                visited[cells] = False
                found.append((np.full(len(near), qid), near, score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()),
                         "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n_blocks = -(-queries.count() // p.queries)
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Dealt by another key than the aggregate's, so that no earlier partitioning is taken for this one.
    probes = (queries.repartition(4 * n_blocks + 8, F.xxhash64("vec_id", F.lit("probe")))
              .mapInArrow(probe, "shard long, query_id long, query array<double>, cells binary")
              .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))))
    placed = (index.withColumn("spread", F.shiftrightunsigned(F.xxhash64("vec_id"), 1))
              .mapInArrow(place, "shard long, vec_id long, cell int, vec array<double>")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
                          if n_blocks > 1 else F.lit(0)).withColumn("block", F.col("block").cast("long")))
    found = (placed.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block"))
             .applyInArrow(compare, RESULT))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
