"""Packing documents into fixed windows, in order, by dynamic programming over cut points."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import slices
from costweave.llm.tokens import encoder, token_bytes

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, cut string")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cut", pa.string())])
KINDS = ("document", "sentence", "word", "inside")


@dataclass(frozen=True)
class Packing:
    """window: tokens of a sequence. The penalties, in tokens, are what a cut at a sentence end,
    between words or anywhere else costs against padding. grid: a cut between words is
    considered about every so many tokens. block: tokens that one dynamic program covers."""

    window: int = 2048
    sentence: int = 2
    word: int = 12
    inside: int = 64
    grid: int = 32
    block: int = 2_000_000


def cut_points(ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, p: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and each one's kind (0 a document's end, 3 inside).

    ``marks`` has for each id 1 if it ends a sentence, plus 2 if it begins a word.
    """
    n = len(ids)
    kind = np.full(n + 1, 4, np.uint8)
    mark = marks[ids]
    w = np.flatnonzero(mark & 2)
    if len(w):
        slot = w // p.grid
        kind[w[np.r_[True, slot[1:] != slot[:-1]]]] = 2
    kind[np.flatnonzero(mark & 1) + 1] = 1
    kind[ends] = 0
    kind[0] = kind[n] = 0
    at = np.flatnonzero(kind < 4)
    gaps = np.flatnonzero(np.diff(at) > p.window // 2)
    for g in gaps:
        kind[np.arange(at[g] + p.window // 2, at[g + 1], p.window // 2)] = 3
    at = np.flatnonzero(kind < 4)
    return at, kind[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int, goes_on: bool = False) -> list[int]:
    """Indices into ``at`` of the window ends of least padding plus penalties.

    best(j) = window - at(j) + cost(j) + min over i of best(i) + at(i), where at(j) - at(i) is
    at most the window. The i in reach slide to the right with j, so a queue of candidates
    with increasing value gives each minimum in constant amortised time. Where the text
    ``goes_on``, the last window is not full yet and its padding counts for nothing.
    """
    places, costs = at.tolist(), cost.tolist()
    came = [0] * len(places)
    value = [0] * len(places)
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        here = places[j]
        while here - places[queue[0]] > window:
            queue.popleft()
        i = came[j] = queue[0]
        v = value[j] = value[i] + window + costs[j]   # best(j) + at(j)
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    if goes_on:
        last = len(places) - 1
        within = range(last - 1, max(last - window - 1, -1), -1)      # no more places than tokens
        came[last] = min((i for i in within if places[last] - places[i] <= window),
                         key=lambda i: value[i] - places[i])
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def powers_of_two(length: int) -> list[int]:
    """The length as powers of two, largest first: sequences that need no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class _Packer:
    def __init__(self, p: Packing, marks: np.ndarray, first_sequence: int) -> None:
        self.p, self.marks = p, marks
        self.sequence = first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []       # doc_id, tokens of it packed before, its tokens
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Packs what is held; unless ``last``, the end of it waits for what follows."""
        if not self.held:
            return None
        p = self.p
        ids = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        at, kind = cut_points(ids, ends, self.marks, p)
        cost = np.array([0, p.sentence, p.word, p.inside])[kind]
        chosen = best_cuts(at, cost, p.window, goes_on=not last)
        cuts, kinds = at[chosen].tolist(), kind[chosen].tolist()
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            tail = np.cumsum(powers_of_two(cuts[-1] - begin)) + begin
            cuts[-1:] = tail.tolist()
            kinds[-1:] = [0 if e in set(ends.tolist()) else 3 for e in cuts[len(kinds) - 1:]]
        elif len(cuts) > 1:
            cuts.pop(), kinds.pop()
        else:
            return None
        out = self._pieces(ids, ends, np.array([0, *cuts]), kinds)
        self._keep(ids, ends, cuts[-1])
        return out

    def _pieces(self, ids, ends, cuts, kinds) -> pa.RecordBatch:
        done = cuts[-1]
        begins = np.r_[0, ends[:-1]]
        at = np.union1d(cuts, ends[ends <= done])
        starts, stops = at[:-1], at[1:]
        doc = np.searchsorted(ends, starts, "right")
        seq = np.searchsorted(cuts, starts, "right") - 1
        before = np.array([d[1] for d in self.docs])
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        out = pa.record_batch([
            pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
            pa.array(starts - begins[doc] + before[doc], pa.int64()),
            pa.array(stops - starts, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array([self.docs[k][2] for k in doc.tolist()], pa.int64()),
            pa.array(seq + self.sequence, pa.int64()),
            pa.array(starts - cuts[seq], pa.int64()),
            pa.array([KINDS[kinds[k]] for k in seq.tolist()])], schema=_ARROW)
        self.sequence += len(cuts) - 1
        return out

    def _keep(self, ids: np.ndarray, ends: np.ndarray, done: int) -> None:
        kept_ids, kept_docs, begin = [], [], 0
        for (doc_id, before, total), end in zip(self.docs, ends.tolist()):
            if end > done:
                a = max(begin, done)
                kept_ids.append(ids[a:end].copy())
                kept_docs.append((doc_id, before + a - begin, total))
            begin = end
        self.ids, self.docs = kept_ids, kept_docs
        self.held = sum(map(len, kept_ids))


def pack(docs: DataFrame, tokenizer: str, end_id: int, packing: Packing = Packing()) -> DataFrame:
    """One row per piece of a document in a sequence, in ascending order of documents.

    Documents are dealt out by ranges of doc_id and packed in order within each range. A window
    may end at a document's end (free), at the end of a sentence or between words, or, where
    none of these is within half a window, anywhere; ``cut`` tells which one ended the sequence.
    The last window of a range is cut to powers of two, lengths that are not padded. Ids come
    from the library; every document ends with ``end_id``.

    Null and empty texts are a document of the end id alone. Null doc_ids come first and keep
    null. Repeated doc_ids are documents of their own, next to each other. An empty table gives
    no rows; other columns are ignored. A range holds one window's tokens over ``block`` at a
    time (or one document, if that is longer).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(tokenizer)
        marks = np.zeros(max(len(known), end_id + 1, encoder(tokenizer).tokenizer.get_vocab_size()), np.uint8)
        for i, b in enumerate(known):
            marks[i] = b.endswith((b".", b"!", b"?", b"\n")) + 2 * b.startswith(b" ")
        code = encoder(tokenizer)
        packer = _Packer(packing, marks, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")
        for batch in slices(batches):
            coded = code.encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                packer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                if packer.held >= packing.block:
                    out = packer.flush(last=False)
                    if out is not None:
                        yield out
        out = packer.flush(last=True)
        if out is not None:
            yield out

    ordered = (docs.select(F.col("doc_id").cast("long"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    return ordered.mapInArrow(run, SCHEMA)
