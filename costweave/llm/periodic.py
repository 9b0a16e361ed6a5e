"""Periodic runs of words, found by block convolution at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import slices

#: Shortest run in words; a run also holds its period twice.
SHORTEST = 12
#: A prime with roots of unity of order 2^23, and a generator of its units.
PRIME, GENERATOR = 998_244_353, 3
#: Numbers that are transformed at once; bounds memory whatever the length of a text.
AT_ONCE = 1 << 17
#: Longest block: transforms of four blocks have the size that the prime allows.
LONGEST = 1 << 21
#: Words that extensions compare in one step.
STRIDE = 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """The factors of each level of a transform of ``size`` numbers, from the widest level down."""
    base = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        base = pow(base, PRIME - 2, PRIME)
    out = []
    while size > 1:
        powers = np.ones(1, np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), PRIME)) % np.uint64(PRIME)])
        out.append(powers)
        base, size = base * base % PRIME, size // 2
    return out


def _below(values: np.ndarray) -> np.ndarray:
    """Values under twice the prime, brought under it; unsigned numbers wrap to large ones."""
    return np.minimum(values, values - np.uint64(PRIME))


def ntt(rows: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, its entries in bit-reversed order."""
    shape, size = rows.shape, rows.shape[1]
    for powers in _roots(size, inverse=False):
        rows = rows.reshape(-1, 2, len(powers))
        low, high = rows[:, 0], rows[:, 1]
        rows = np.stack([_below(low + high), (low + np.uint64(PRIME) - high) * powers % np.uint64(PRIME)], axis=1)
    return rows.reshape(shape)


def inverse_ntt(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms in bit-reversed order are given."""
    shape, size = rows.shape, rows.shape[1]
    for powers in reversed(_roots(size, inverse=True)):
        rows = rows.reshape(-1, 2, len(powers))
        low, high = rows[:, 0], rows[:, 1] * powers % np.uint64(PRIME)
        rows = np.stack([_below(low + high), _below(low + np.uint64(PRIME) - high)], axis=1)
    return rows.reshape(shape) * np.uint64(pow(size, PRIME - 2, PRIME)) % np.uint64(PRIME)


def occurrences(codes: np.ndarray, block: int, nearest: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) where a block of ``codes`` occurs again without a mismatch.

    Blocks begin at the multiples of their length, distances go from ``nearest`` to ``farthest``. The squared
    differences of a block and a window are the squares of both less twice their product sum, which a transform
    gives for all distances at once, exactly, modulo the prime. What is no multiple of the prime is a mismatch; the
    extension of a seed compares words and so tells the multiples from zero.
    """
    n, count = len(codes), farthest - nearest + 1
    window = count + block - 1
    size = 4 * block
    starts = np.arange(0, n - block - nearest + 1, block)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(farthest + block, np.uint64)])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded % np.uint64(PRIME))])
    lags = np.arange(count)
    found = []
    for at in range(0, len(starts), max(1, AT_ONCE // size)):
        own = starts[at:at + max(1, AT_ONCE // size)]
        blocks = np.zeros((len(own), size), np.uint64)
        blocks[:, :block] = padded[own[:, None] + np.arange(block - 1, -1, -1)]
        windows = np.zeros((len(own), size), np.uint64)
        windows[:, :window] = padded[own[:, None] + nearest + np.arange(window)]
        product = inverse_ntt(ntt(blocks) * ntt(windows) % np.uint64(PRIME))[:, block - 1:block - 1 + count]
        there = own[:, None] + nearest + lags
        both = (squares[own + block] - squares[own])[:, None] + squares[there + block] - squares[there]
        row, lag = np.nonzero(both % np.uint64(PRIME) == 2 * product % np.uint64(PRIME))
        found.append((own[row], lag + nearest))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])


def _extended(codes: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal those ``distance`` later."""
    n, total = len(codes), np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    reach = np.arange(STRIDE) if step > 0 else -1 - np.arange(STRIDE)
    while len(todo):
        here = (at[todo] + step * total[todo])[:, None] + reach
        there = here + distance[todo][:, None]
        inside = (here >= 0) & (there < n)
        same = inside & (codes[np.where(inside, here, 0)] == codes[np.where(inside, there, 0)])
        length = np.where(same.all(axis=1), STRIDE, same.argmin(axis=1))
        total[todo] += length
        todo = todo[length == STRIDE]
    return total


def _chains(position: np.ndarray, distance: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """First and last block of each chain of neighbouring blocks with one distance."""
    order = np.lexsort((position, distance))
    position, distance = position[order], distance[order]
    begins = np.r_[True, (np.diff(distance) != 0) | (np.diff(position) != block)]
    first = np.flatnonzero(begins)
    return position[first], position[np.r_[first[1:], len(position)] - 1], distance[first]


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, distance), the least distance of each stretch."""
    rows = np.unique(rows, axis=0)
    return rows[np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)][:len(rows)]]


def runs_of(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run, by start and period; codes are numbers from 1.

    A run of period q has at least q words that are repeated q later (and at least 12 - q of them), so among
    these is a whole block of B words for 2B - 1 <= q. Distances are gone through in ranges of 2B for the doubling
    B (then in ranges for the longest block). A seed of
    distance d is extended to all its neighbours that repeat d later. Stretches of 2d words or more are
    runs; the least d of a stretch is its period. Seeds within a run whose period divides d give that run again
    and are passed over.
    """
    n, block, found, painted = len(codes), 2, [], []
    nearest, farthest = 1, 6
    while 2 * nearest <= n and n >= SHORTEST:
        position, distance = occurrences(codes, block, nearest, farthest)
        if len(position):
            first, last, d = _chains(position, distance, block)
            fresh = np.ones(len(first), bool)
            for owner, (start, end, period) in painted:
                own = owner[first]
                fresh &= ~((own >= 0) & (start[own] <= first) & (end[own] >= last + block + d)
                           & (d % period[own] == 0))
            first, last, d = first[fresh], last[fresh], d[fresh]
            begin = first - _extended(codes, first, d, -1)
            end = last + _extended(codes, last, d, 1) + d
            # A chain of a multiple of the prime's squares would not hold its own blocks.
            whole = begin + np.maximum(SHORTEST, 2 * d) <= end
            rows = _smallest_periods(np.stack([begin, end, d], axis=1)[whole])
            if len(rows):
                found.append(rows)
                owner = np.full(n, -1, np.int64)
                for i in np.argsort(rows[:, 1] - rows[:, 0], kind="stable").tolist():
                    owner[rows[i, 0]:rows[i, 1]] = i
                painted.append((owner, (rows[:, 0], rows[:, 1], rows[:, 2])))
        block = min(2 * block, LONGEST)
        nearest, farthest = farthest + 1, farthest + 2 * block
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = _smallest_periods(np.concatenate(found))
    out = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where only words follow each other that the text holds more than once: no run lies elsewhere."""
    again = np.bincount(ids)[ids] > 1
    edges = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= SHORTEST]


def text_runs(tokens: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words. Stretches of about one length are searched as one row of codes, each
    ended by a code of its own, which no run passes."""
    out = [[] for _ in tokens]
    sized: dict[int, list] = {}
    for i, own in enumerate(tokens):
        if len(own) < SHORTEST:
            continue
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in own], np.int64)
        for a, b in _stretches(ids):
            sized.setdefault((b - a).bit_length(), []).append((i, a, ids[a:b]))
    for alike in sized.values():
        at = 0
        while at < len(alike):
            end, held = at, 0
            while end < len(alike) and (end == at or held + len(alike[end][2]) < AT_ONCE):
                held += len(alike[end][2]) + 1
                end += 1
            part = alike[at:end]
            most = 1 + max(int(ids.max()) for _, _, ids in part)
            codes = np.concatenate([np.r_[ids + 1, most + k + 1] for k, (_, _, ids) in enumerate(part)])
            base = np.cumsum([0] + [len(ids) + 1 for _, _, ids in part])
            rows = runs_of(codes)
            for k, row in zip((np.searchsorted(base, rows[:, 0], "right") - 1).tolist(), rows):
                out[part[k][0]].append(row + np.array([part[k][1] - base[k], 0, 0]))
            at = end
    none = np.zeros((0, 3), np.int64)
    return [np.array(sorted(map(tuple, rows), key=lambda r: (r[0], r[2])), np.int64) if rows else none for rows in out]


def collapsed(tokens: list[bytes], runs: np.ndarray) -> bytes:
    """The words, of each run only its first period, joined by one space."""
    drop = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(drop) > 0
    return b" ".join([w for w, g in zip(tokens, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words) and collapsed, the text without repeats.

    Words are what stands between ASCII white space, as written. A run is a stretch of words with smallest
    period q and at least 12 and 2q words that no neighbour prolongs. ``collapsed`` keeps of each run the
    first q words; a word that any run drops is dropped. Null and empty texts have no words, no runs and an
    empty ``collapsed``. Rows with a null or repeated doc_id each come back; an empty table gives no rows, and
    other columns are ignored, whatever their names. Nothing is shuffled; a task holds a slice of some 3 MB of
    text, or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = [(t or "").encode("utf-8").split() for t in batch.column("text").to_pylist()]
            found = text_runs(tokens)
            ends = np.cumsum([0] + [len(r) for r in found])
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t) for t in tokens], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells),
                 pa.array([collapsed(t, r).decode("utf-8") for t, r in zip(tokens, found)], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts repeating a stretch of theirs to the end, to find runs in.

    With h the crc32 of doc_id as text and g = h div 10, where h divides by 10 the words from a = g mod n on become
    those of the next p = 1 + (n - a) div (3 + g mod 8), over and over, joined by one space. Other texts, and
    those of a null doc_id, stay as they are.
    """
    spread = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                         F.crc32(F.col("doc_id").cast("long").cast("string")).alias("h"))
    changed = """transform(array(filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), words ->
      transform(array(named_struct('n', size(words), 'g', h div 10)), s ->
       transform(array(cast(s.g % s.n AS int)), a ->
        transform(array(cast(1 + (s.n - a) div (3 + s.g % 8) AS int)), p ->
         array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(
          slice(words, a + 1, p), cast(ceil((s.n - a) / p) AS int))), 1, s.n - a)), ' '))[0])[0])[0])[0]"""
    some = (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return spread.select("doc_id", F.when(some, F.expr(changed)).otherwise(F.col("text")).alias("text"))
