"""Benchmark items in training documents: BM25 with block-max WAND, then overlap of words."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import columns_of, fold, forget_others, fresh_name, slices, small_batches, without_keys, written

RESULT = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
          "passage long")
#: Items whose bounds are held against whole passages together.
ITEM_BLOCK = 4
#: Sentence ends, behind which the last part of an item is its answer.
SENTENCE_END = re.compile(rb"[.?!](?:[\x20\x09-\x0D]+|$)")


@dataclass(frozen=True)
class Decontamination:
    """threshold: part of an item's score for its own text that a passage must reach. overlap:
    part of the question's and the answer's word shingles that the document must have.
    shingle: words of one. passage: words of a passage, at least; items longer than half
    of it make passages longer. block: postings that share an upper bound. k1, b: of BM25."""

    threshold: float = 0.5
    overlap: float = 0.8
    shingle: int = 5
    passage: int = 128
    block: int = 16
    k1: float = 1.2
    b: float = 0.75


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The words of an item up to its last sentence, and of that; one sentence has no answer."""
    folded = fold(text)
    ends = [m.end() for m in SENTENCE_END.finditer(folded) if folded[m.end():].strip()]
    at = ends[-1] if ends else len(folded)
    return folded[:at].split(), folded[at:].split()


def shingles(words: list[bytes], n: int) -> set[bytes]:
    """Runs of n words; of fewer words, all of them as one run."""
    if not words:
        return set()
    return {b" ".join(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))}


@dataclass(frozen=True)
class Whole:
    """Of all items with words: their number, their words, those of the longest one, and how many
    items have each word (of an index's own items)."""

    n: int
    words: int
    longest: int
    df: dict[bytes, int]


class Index:
    """Postings of the items by word, with block maxima, weighted so that an item's own text scores 1.

    Items are numbered in ascending order of item_id; the postings of a word are sorted by
    number, null ids last. BM25 is divided by the item's score for itself, which puts all items
    under one threshold. ``whole``: what a part of the items needs to know of all of them.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], p: Decontamination, whole: Whole | None = None) -> None:
        self.p = p
        parts = [(i, *question_and_answer(t))
                 for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        parts = [x for x in parts if x[1] or x[2]]
        self.items = [i for i, _, _ in parts]
        self.parts = [(shingles(q, p.shingle), shingles(a, p.shingle)) for _, q, a in parts]
        self.sizes = [len(q) + len(a) for _, q, a in parts]
        self.wanted = {s for q, a in self.parts for s in q | a}
        counts = [Counter(q + a) for _, q, a in parts]
        whole = whole or Whole(len(parts), sum(self.sizes), max(self.sizes, default=0),
                               Counter(w for c in counts for w in c))
        self.longest = whole.longest
        df, n, mean = whole.df, whole.n, whole.words / whole.n if whole.n else 1.0
        postings: dict[bytes, list[tuple[int, float]]] = {w: [] for c in counts for w in c}
        for number, (c, size) in enumerate(zip(counts, self.sizes)):
            own = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (p.k1 + 1)
                   / (f + p.k1 * (1 - p.b + p.b * size / mean)) for w, f in c.items()}
            total = sum(own.values())
            for w, weight in own.items():
                postings[w].append((number, float(weight / total)))
        self.terms = {w: t for t, w in enumerate(postings)}
        self.numbers = [[i for i, _ in x] for x in postings.values()]
        self.weights = [[v for _, v in x] for x in postings.values()]
        cut = range(0, max(map(len, self.numbers), default=0), p.block)
        self.block_max = [[max(x[at:at + p.block]) for at in cut if at < len(x)] for x in self.weights]
        # The same maxima by blocks of item numbers, term after term, for whole passages at a time.
        self.n_blocks = max(1, -(-len(parts) // ITEM_BLOCK))
        blocks = [np.unique(np.array(x) // ITEM_BLOCK, return_index=True) for x in self.numbers]
        self.first_block = np.r_[0, np.cumsum([len(b) for b, _ in blocks], dtype=np.int64)].astype(np.int64)
        self.block_of = np.concatenate([b for b, _ in blocks] or [np.zeros(0, np.int64)])
        self.bound_of = np.concatenate([np.maximum.reduceat(np.array(w), at) for w, (_, at) in zip(self.weights, blocks)]
                                       or [np.zeros(0)])
        self.most = np.array([max(x) for x in self.weights] or [0.0])

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score for the distinct terms reaches the threshold, by block-max WAND.

        Cursors stand on their postings, sorted by item. The first item that the upper bounds
        of the cursors up to it let reach the threshold is the pivot; it is scored only if the
        bounds of the blocks it lies in reach it too, and otherwise skipped past with
        the nearest end of these blocks.
        """
        least, block = self.p.threshold - 1e-9, self.p.block
        most, numbers, weights, block_max = self.most, self.numbers, self.weights, self.block_max
        cursors = [[numbers[t][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            tight, reach = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items)
            for c in cursors[:pivot + 1]:
                own = numbers[c[2]]
                at = bisect_left(own, item, c[1])
                if at < len(own):
                    tight += block_max[c[2]][at // block]
                    after = (at // block + 1) * block
                    reach = min(reach, own[after - 1] + 1 if after <= len(own) else own[-1] + 1)
            if tight >= least:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    own = numbers[c[2]]
                    at = bisect_left(own, item, c[1])
                    if at < len(own) and own[at] == item:
                        score += weights[c[2]][at]
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                target = max(reach, item + 1)
            left = []
            for c in cursors[:pivot + 1]:
                at = bisect_left(numbers[c[2]], target, c[1])
                if at < len(numbers[c[2]]):
                    left.append([numbers[c[2]][at], at, c[2]])
            cursors[:pivot + 1] = left
        return found

    def passages(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and distinct terms of the passages that could reach the threshold for some item: for
        some block of items, the sum of their terms' maxima in it does.

        Passages overlap by half, so a run of words as long as the longest item is whole in one.
        """
        wide = max(self.p.passage, 2 * self.longest)
        step, n_terms, least = wide // 2, len(self.terms), self.p.threshold - 1e-9
        term = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(term >= 0)
        half, term = at // step, term[at]
        later = half > 0
        pair = np.unique(np.concatenate([half * n_terms + term, (half[later] - 1) * n_terms + term[later]]))
        passage, term = pair // n_terms, pair % n_terms
        cut = np.flatnonzero(np.r_[True, np.diff(passage) > 0, True]) if len(pair) else np.zeros(1, np.int64)
        for first in range(0, len(cut) - 1, 256):           # passages at a time
            ends = cut[first:first + 257]
            own = term[ends[0]:ends[-1]]
            n = self.first_block[own + 1] - self.first_block[own]
            place = np.repeat(self.first_block[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            key = np.repeat(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), n) * self.n_blocks + self.block_of[place]
            bound = np.bincount(key, self.bound_of[place], (len(ends) - 1) * self.n_blocks)
            for k in np.flatnonzero(bound.reshape(-1, self.n_blocks).max(axis=1) >= least).tolist():
                yield int(passage[ends[k]]) * step, term[ends[k]:ends[k + 1]].tolist()

    def matches(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """item_id, best score, question and answer overlap, and word where the best passage
        begins, of each item that the text is contaminated with."""
        words = fold(text).split()
        best: dict[int, tuple[float, int]] = {}
        for start, terms in self.passages(words):
            for item, score in self.retrieve(terms):
                if item not in best or score > best[item][0]:
                    best[item] = (score, start)
        if not best:
            return []
        n = self.p.shingle
        have = {s for i in range(max(len(words) - n + 1, 1)) if (s := b" ".join(words[i:i + n])) in self.wanted}
        for item in best:
            for short in self.parts[item]:      # parts of fewer words than a shingle
                for s in short:
                    if (k := s.count(b" ") + 1) < n and s not in have:
                        if any(words[i:i + k] == s.split() for i in range(len(words) - k + 1)):
                            have.add(s)
        out = []
        for item, (score, start) in best.items():
            q, a = (len(part & have) / len(part) if part else 1.0 for part in self.parts[item])
            both = [s for part in self.parts[item] for s in part]
            if sum(s in have for s in both) >= self.p.overlap * len(both):
                out.append((self.items[item], score, q, a, start))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))


def whole_items(items: DataFrame) -> tuple[tuple[int, int, int], DataFrame]:
    """Number, words and longest of all items with words, and for the words of each part how many
    items of all parts have them: part, word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [fold(t).split() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("part"), pa.array([len(w) for w in own], pa.int64()),
                                   pa.array([list(set(w)) for w in own], pa.list_(pa.binary()))],
                                  names=["part", "size", "words"])

    rows = written(items.select("part", "text").mapInArrow(run, "part int, size long, words array<binary>")
                   .where("size > 0"), "items")
    n, words, longest = rows.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    each = rows.select("part", F.explode("words").alias("word")).groupBy("part", "word").agg(F.count("*").alias("n"))
    df = each.select("part", "word").join(each.groupBy("word").agg(F.sum("n").alias("n")), "word")
    return (int(n), int(words or 0), int(longest or 0)), written(df, "frequencies")


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(),
                 item_part: int = 50_000) -> DataFrame:
    """The items that occur in each document: doc_id, item_id, score, question_overlap,
    answer_overlap and passage (the first word of the best passage).

    The test items are indexed in parts of ``item_part`` by a hash; every document passes by each
    part, so no index outgrows a task, and weights are those of all items together. Words are cut at ASCII white space, A-Z
    lower-cased. An item's last sentence is its answer, what comes before it the question; of the
    shingles of both, none reaching from one into the other, ``overlap`` must be there. Null or empty items and texts match nothing, null ids are kept as null, repeated
    items and documents give rows of their own, merged per (doc_id, item_id) with the best score.
    Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    n_parts = max(1, -(-items.count() // item_part))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)).cast("int"))
    lengths, df = whole_items(items) if n_parts > 1 else (None, None)
    found = None
    for part in range(n_parts):
        own = items.where(F.col("part") == part).collect()
        whole = lengths and Whole(*lengths, {bytes(r.word): r.n for r in df.where(F.col("part") == part).collect()})
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own], p, whole))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            forget_others()
            for batch in slices(batches):
                out = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                                            batch.column("text").to_pylist())
                       for m in index.value.matches(text)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                columns = list(zip(*out)) or [[]] * 6
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["doc_id", "item_id", "score", "question_overlap",
                                             "answer_overlap", "passage"])

        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
        found = rows if found is None else found.unionByName(rows)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage")).alias("p")))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("m"))
            .select("doc_id", "item_id", "m.score", "m.question_overlap", "m.answer_overlap",
                    (-F.col("m.p")).alias("passage")))


def without_items(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """The documents in which no item occurs, with the columns they had; null doc_ids are tested
    by their text like others."""
    key = fresh_name(docs, "row")
    marked = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    with small_batches(docs.sparkSession):
        found = written(contaminated(marked.select(F.col(key).alias("doc_id"), "text"), benchmark, p)
                        .select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return without_keys(marked, key, found)
