"""A hierarchical Pitman-Yor language model of words, sampled in passes over dealt-out tokens.

Restaurants: one for each previous word, whose parents are those of the words with the same last
two bytes (classes of a fixed number), whose parent is the restaurant without context, over a
uniform base. Tokens are dealt out by word into buckets of bounded size, so a word's customers and
tables in all restaurants meet in one task. A previous word's restaurant is spread over the buckets of
all words that follow it: each pass sends the buckets' shares of its size to one task by context and the
sums back to the buckets that hold the context. A context that one bucket alone holds does not travel.
Only the sizes of the parents and the root, a fixed number of counts, go around whole. A sweep of Gibbs
sampling seats customers against the sizes of the sweep before, as distributed samplers do.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, Row, functions as F

from costweave.llm.shared import remainder_of_crc, slices, words

END = b"\n"      # no word has it; also the word before the first
RESULT = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass(frozen=True)
class PitmanYor:
    """parents: classes of last two bytes, at most 1024. burn_in: Gibbs sweeps before the first that counts;
    sweeps: those after it, each a sample whose predictions are averaged. moves: of a dish's
    customers in a sweep; dishes of more customers move several at once. theta: concentration.
    bucket_bytes: text a bucket's tokens stand for. hot, most_hot: a word of over ``hot`` of all tokens,
    or of half a bucket's, is dealt out by context too; at most ``most_hot`` words are looked for."""

    parents: int = 1024
    burn_in: int = 1
    sweeps: int = 2
    moves: int = 8
    theta: float = 1.0
    bucket_bytes: int = 16_000_000
    hot: float = 0.004
    most_hot: int = 20_000
    slice_bytes: int = 6_000_000


def _packed(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpacked(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(data)))


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


#: Of a context: bits of the previous word's hash within its parent. Two of a parent's n words share a
#: restaurant with a chance of about n / 2**31 each, and nothing else comes of it.
OWN = 31
#: Bits of a context in all, with up to 1024 parents before.
CONTEXT = OWN + 10


def context_of(words: list[bytes], hashes: np.ndarray, p: PitmanYor) -> np.ndarray:
    """The restaurant that a word opens for the next: the number of its parent, then 31 bits of its hash."""
    ends = np.fromiter((xxhash.xxh32_intdigest(w[-2:]) for w in words), np.int64, len(words))
    return (ends % p.parents << OWN) + (hashes >> np.uint64(64 - OWN)).astype(np.int64)


def shard_of(contexts: np.ndarray, n: int) -> np.ndarray:
    """Contexts dealt by hash, about equal in number."""
    return (contexts & (1 << OWN) - 1) * n >> OWN


def distinct_pairs(place: np.ndarray, contexts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context of each distinct pair, ascending, and the pair of each entry."""
    if n_words < 1 << 63 - CONTEXT:
        keys, pair = np.unique((place << CONTEXT) + contexts, return_inverse=True)
        return keys >> CONTEXT, keys & (1 << CONTEXT) - 1, pair
    forms, at = np.unique(contexts, return_inverse=True)
    keys, pair = np.unique(place * len(forms) + at, return_inverse=True)
    return keys // len(forms), forms[keys % len(forms)], pair


@dataclass
class Sizes:
    """What the parents, the root and the whole corpus amount to, and the words dealt over several tasks."""

    parent_customers: np.ndarray      # the tables of the parent's restaurants
    parent_tables: np.ndarray
    split: np.ndarray                 # of each such word: tokens, customers of the root, tables
    root_tables: int = 0
    tokens: int = 0
    vocabulary: int = 0
    ones: np.ndarray = field(default_factory=lambda: np.zeros((3, 2), np.int64))   # dishes of 1 and 2 customers

    @classmethod
    def empty(cls, p: PitmanYor, n_split: int) -> "Sizes":
        return cls(np.zeros(p.parents, np.int64), np.zeros(p.parents, np.int64), np.zeros((n_split, 3), np.int64))

    def packed(self) -> bytes:
        return _packed(**vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> "Sizes":
        return cls(**_unpacked(data))

    def plus(self, other: "Sizes") -> "Sizes":
        return Sizes(**{k: v + getattr(other, k) for k, v in vars(self).items()})

    def discounts(self) -> list[float]:
        """Of the levels from the children to the root, from dishes with one and two customers."""
        return [float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95)) for a, b in self.ones.tolist()]


def reseat(c: np.ndarray, t: np.ndarray, new: np.ndarray, d: float, moves: int, rng) -> np.ndarray:
    """Tables of each dish after its customers have left and come back in turns.

    ``c`` customers sit at ``t`` tables. Who leaves is at the head of a table with probability
    t / c and takes it along unless it is the last; who comes back sits down at the dish's
    tables with weight customers - d * tables, or opens one with weight ``new``. Dishes of
    more than ``moves`` customers move ceil(c / moves) at once.
    """
    t = t.copy()
    for several in (False, True):
        at = np.flatnonzero(c > moves if several else (c > 1) & (c <= moves))
        own, tables, weight = c[at], t[at], new[at]
        for move in range(moves):
            if several:
                m = -(-own // moves)
                left = np.minimum(rng.hypergeometric(tables, own - tables, m), tables - 1)
                rest = tables - left
                tables = rest + rng.binomial(m, weight / (own - m - d * rest + weight))
            else:
                live = np.flatnonzero(own > move)
                if not len(live):
                    break
                o, x, w = own[live], tables[live], weight[live]
                x = np.where((rng.random(len(x)) * o < x) & (x > 1), x - 1, x)
                x = np.minimum(x, o - 1)
                tables[live] = x + (rng.random(len(x)) < w / (o - 1 - d * x + w))
        t[at] = tables
    return t


class Bucket:
    """The customers of one task's words in all restaurants, and their seating.

    ``customers`` and ``tables`` are the sizes of the restaurants of ``contexts``: at first what this
    bucket holds of them, then, by meet(), the sums over all buckets.
    """

    def __init__(self, parts: list[dict], number: int, p: PitmanYor, split: np.ndarray) -> None:
        self.p, self.number = p, number
        self.slices = [x["slice"] for x in parts]
        self.sizes = [len(x["own"]) for x in parts]
        self.words, place = np.unique(np.concatenate([x["hashes"] for x in parts]), return_inverse=True)
        place = np.repeat(place, np.concatenate([x["counts"] for x in parts]))
        contexts = np.concatenate([x["parent"] for x in parts]).astype(np.int64) << OWN
        contexts += np.concatenate([x["own"] for x in parts])
        word, context, pair = distinct_pairs(place, contexts, len(self.words))
        del place, contexts
        self.doc = np.concatenate([x["doc"] for x in parts])
        self.times = np.concatenate([x["times"] for x in parts])
        learned = np.concatenate([x["train"] for x in parts])
        self.pair, self.word = pair.astype(np.uint32), word.astype(np.uint32)
        del pair
        self.contexts, self.context = np.unique(context, return_inverse=True)
        # Pairs ascend by word, parent and context, so those of a word in a parent are neighbours.
        parent = context >> OWN
        new = np.r_[True, (word[1:] != word[:-1]) | (parent[1:] != parent[:-1])]
        self.group, self.group_word, self.parent = np.cumsum(new) - 1, word[new], parent[new]
        del word, context, parent
        self.split = np.searchsorted(split, self.words)
        self.n_split = len(split)
        self.is_split = np.isin(self.words, split)
        add = lambda index, weight, n: np.bincount(index, weights=weight, minlength=n).astype(np.int64)
        self.c2 = add(self.pair[learned], self.times[learned], len(self.word))
        self.t2 = np.minimum(self.c2, 1)
        self.count = add(self.word, self.c2, len(self.words))
        self.customers = self.held(self.c2)
        self.tables = self.held(self.t2)
        self.travels = np.arange(len(self.contexts))      # places of contexts, by shard
        self._upper()
        self.t1 = np.minimum(self.c1, 1)
        self._root()
        self.t0 = np.minimum(self.c0, 1)

    def held(self, amounts: np.ndarray) -> np.ndarray:
        """What this bucket holds of each context."""
        return np.bincount(self.context, weights=amounts, minlength=len(self.contexts)).astype(np.int64)

    def _upper(self) -> None:
        self.c1 = np.bincount(self.group, weights=self.t2, minlength=len(self.group_word)).astype(np.int64)

    def _root(self) -> None:
        self.c0 = np.bincount(self.group_word, weights=self.t1, minlength=len(self.words)).astype(np.int64)

    def offered(self, n_shards: int, first: bool) -> Iterator[tuple[int, bytes]]:
        """This bucket's shares of sizes, for each shard of contexts: all at first, later those that travel."""
        self._by_shard(n_shards)
        shard = shard_of(self.contexts[self.travels], n_shards)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else [0]
        tables = self.held(self.t2)
        for a, e in zip(cut, cut[1:]):
            at = self.travels[a:e]
            more = {"customers": self.customers[at].astype("<u4")} if first else {}
            yield int(shard[a]), _packed(bucket=self.number, contexts=self.contexts[at], tables=tables[at].astype("<u4"), **more)

    def _by_shard(self, n_shards: int) -> None:
        shard = shard_of(self.contexts[self.travels], n_shards)
        self.travels = self.travels[np.argsort(shard.astype("<u2" if n_shards < 1 << 16 else "<u4"), kind="stable")]

    def meet(self, answers: list[dict], n_shards: int) -> None:
        """Takes the sums over all buckets, of shards in ascending order; the first ones tell which contexts travel."""
        self._by_shard(n_shards)
        self.tables = self.held(self.t2)
        if answers:
            self.tables[self.travels] = np.concatenate([x["tables"] for x in answers])
            if "customers" in answers[0]:
                self.customers[self.travels] = np.concatenate([x["customers"] for x in answers])
                self.travels = np.sort(self.travels[np.concatenate([x["shared"] for x in answers])])

    def chances(self, s: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities: of words, of words in parents, and of words in restaurants."""
        d2, d1, d0 = s.discounts()
        theta = self.p.theta
        c0, t0 = self.c0.astype(float), self.t0.astype(float)
        c0[self.is_split], t0[self.is_split] = s.split[self.split[self.is_split], 1:].T
        below = 1.0 / (s.vocabulary + 1)
        p0 = (c0 - d0 * t0 + (theta + d0 * s.root_tables) * below) / (theta + int(s.parent_tables.sum()))
        p1 = (self.c1 - d1 * self.t1 + (theta + d1 * s.parent_tables[self.parent]) * p0[self.group_word]) / (
            theta + s.parent_customers[self.parent])
        p2 = (self.c2 - d2 * self.t2 + (theta + d2 * self.tables)[self.context] * p1[self.group]) / (
            theta + self.customers)[self.context]
        return p0, p1, p2

    def sweep(self, s: Sizes, number: int) -> None:
        """Seats all customers once, level by level, against the sizes ``s``."""
        rng = np.random.default_rng([number, self.number])
        d2, d1, d0 = s.discounts()
        theta, moves = self.p.theta, self.p.moves
        p0, p1, _ = self.chances(s)
        self.t2 = reseat(self.c2, self.t2, (theta + d2 * self.tables)[self.context] * p1[self.group], d2, moves, rng)
        self._upper()
        self.t1 = np.clip(self.t1, np.minimum(self.c1, 1), self.c1)
        self.t1 = reseat(self.c1, self.t1, (theta + d1 * s.parent_tables[self.parent]) * p0[self.group_word], d1, moves, rng)
        self._root()
        self.t0 = np.clip(self.t0, np.minimum(self.c0, 1), self.c0)
        new = np.full(len(self.words), (theta + d0 * s.root_tables) / (s.vocabulary + 1))
        self.t0 = reseat(self.c0, self.t0, new, d0, moves, rng)

    def sums(self) -> Sizes:
        p, own = self.p, ~self.is_split
        add = lambda index, weight: np.bincount(index, weights=weight, minlength=p.parents).astype(np.int64)
        split = np.zeros((self.n_split, 3), np.int64)
        split[self.split[self.is_split], 0] = self.count[self.is_split]
        split[self.split[self.is_split], 1] = self.c0[self.is_split]
        ones = np.array([[(c == 1).sum(), (c == 2).sum()] for c in (self.c2, self.c1, self.c0[own])])
        return Sizes(add(self.parent, self.c1), add(self.parent, self.t1), split, int(self.t0[own].sum()),
                     int(self.count.sum()), int((self.count[own] > 0).sum()), ones)


def _deal(p: PitmanYor, n_buckets: int, split: np.ndarray):
    """Cuts texts into tokens and gives, for each slice and bucket, the bucket's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=p.slice_bytes):
            known: dict[bytes, int] = defaultdict(count().__next__)     # numbers in the order of first sight
            known[END]
            ids, sizes = [], []
            for text in batch.column("text").to_pylist():
                own = words(text)
                own.append(END)
                ids.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
                sizes.append(len(own))
            n, n_docs = len(known), len(sizes)
            word = np.concatenate(ids)
            # Equal tokens of a text after the same word are one entry. Texts end with END, which also begins the next.
            entry = (word * n + np.r_[0, word[:-1]]) * n_docs + np.repeat(np.arange(n_docs), sizes)
            entry, times = np.unique(entry, return_counts=True)
            word, doc = entry // n_docs, entry % n_docs
            word, before = word // n, word % n
            forms = list(known)
            hashes = word_hash(forms)
            context = context_of(forms, hashes, p)[before]
            part = np.where(np.isin(hashes, split)[word], context >> OWN, 0).astype(np.uint64)
            deal = hashes[word] + part * np.uint64(0x9E3779B97F4A7C15)
            bucket = (deal ^ deal >> np.uint64(32)) % np.uint64(n_buckets)
            order = np.argsort(bucket.astype("<u2" if n_buckets < 1 << 16 else "<u4"), kind="stable")
            word, doc, context, bucket, times = word[order], doc[order], context[order], bucket[order], times[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            train = np.array(batch.column("train").to_pylist(), bool)
            kind = "<u2" if n_docs < 1 << 16 else "<u4"
            rows = []
            for a, e in zip(cut, cut[1:]):
                first = np.flatnonzero(np.r_[True, np.diff(word[a:e]) > 0])
                rows.append((int(bucket[a]), _packed(
                    slice=number, hashes=hashes[word[a:e][first]], counts=np.diff(np.r_[first, e - a]).astype("<u4"),
                    parent=(context[a:e] >> OWN).astype("<u2"), own=(context[a:e] & (1 << OWN) - 1).astype("<u4"),
                    doc=doc[a:e].astype(kind), times=times[a:e].astype("<u4"), train=train[doc[a:e]])))
            rows.append((number % n_buckets, _packed(slice=number, doc_ids=batch.column("doc_id").to_pylist(), sizes=sizes,
                                                     train=train)))
            yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
                                  names=["bucket", "data"])
            number += 1

    return run


def _hot_words(docs: DataFrame, hot: float) -> np.ndarray:
    """Words of a share of tokens over ``hot`` in a small sample: at most 1 / hot of them. Only how
    tokens are dealt out depends on it, not what comes of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = [w for t in batch.column("text").to_pylist() for w in (*words(t), END)]
            hashes, n = np.unique(word_hash(tokens), return_counts=True)
            often = n > max(hot / 4 * len(tokens), 1)
            yield pa.record_batch([pa.array(hashes[often].view(np.int64)), pa.array(n[often]),
                                   pa.array([len(tokens)] + [0] * (int(often.sum()) - 1), pa.int64())[:int(often.sum())]],
                                  names=["word", "n", "of"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0)
    seen = sample.select("text").mapInArrow(count, "word long, n long, of long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("of").alias("of"))
    total = seen.agg(F.sum("of")).first()[0] or 0
    often = seen.where(F.col("n") > hot * total).select("word").collect() if total else []
    return np.sort(np.array([r.word for r in often], np.int64).view(np.uint64))


def _own_partition(key: int) -> int:
    return key


def _met(rows: Iterator[tuple[int, tuple[int, bytes]]]) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """Adds up a shard's contexts over all buckets; each bucket gets the sums of the contexts it sent, in their order.

    The buckets' own sums, which came along, are handed on as one.
    """
    parts, total, pass_number, own = [], None, 0, 0
    for own, (pass_number, data) in rows:
        x = _unpacked(data)
        if "contexts" in x:
            parts.append(x)
        else:
            s = Sizes(**x)
            total = s if total is None else total.plus(s)
    if total is not None:
        yield own, (-1, total.packed())
    if not parts:
        return
    parts.sort(key=lambda x: x["bucket"])
    contexts, place = np.unique(np.concatenate([x["contexts"] for x in parts]), return_inverse=True)
    add = lambda name: np.bincount(place, weights=np.concatenate([x[name] for x in parts])).astype("<u4")
    first = "customers" in parts[0]
    sums = {"tables": add("tables")} | ({"customers": add("customers"), "shared": np.bincount(place) > 1} if first else {})
    at = 0
    for x in parts:
        mine = place[at:at + len(x["contexts"])]
        at += len(mine)
        yield x["bucket"], (pass_number, _packed(shard=own, **{k: v[mine] for k, v in sums.items()}))


def score(docs: DataFrame, p: PitmanYor = PitmanYor()) -> DataFrame:
    """For each document: doc_id, train, n_tokens, n_known, train_tokens, base_score and score.

    ``docs`` has doc_id, text and train (whether the model learns from the document). Words are
    cut at ASCII white space with A-Z lower-cased; each text ends with a token of its own.
    base_score is that of single tokens with one added to each count, score the average
    predictive probability of the Gibbs samples, both as log10 over the whole text; exp10 of
    -score / n_tokens is the perplexity. A word that was not learned has the base's mass for one.

    Null and empty texts are the end token alone; a null ``train`` is false. Null and repeated
    doc_ids are rows like others. Without training documents both scores are zero, those of a
    vocabulary of one unknown word. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("train", F.lit(False)).alias("train"))
    n_bytes = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    n_buckets = max(-(-n_bytes // p.bucket_bytes), min(spark.sparkContext.defaultParallelism, 1 + n_bytes // 100_000))
    split = _hot_words(docs, min(p.hot, max(0.5 / n_buckets, 1 / p.most_hot)))
    # One shuffle, whose files all passes read again; a lost one is made again from the documents.
    dealt = (docs.mapInArrow(_deal(p, n_buckets, split), "bucket int, data binary").rdd
             .map(lambda r: (r.bucket, (-1, bytes(r.data)))).partitionBy(n_buckets, _own_partition))
    answers: list[RDD] = []          # of each pass, the sizes of the restaurants that a bucket holds
    known_sizes: list[Sizes] = []

    def together_with_answers() -> RDD:
        rows = dealt
        for a in answers:
            rows = rows.union(a)     # of one partitioner, so that nothing moves
        assert rows.getNumPartitions() == dealt.getNumPartitions()
        return rows

    def bucket(rows: Iterator, n_passes: int) -> tuple[Bucket | None, list[list[dict]], list[tuple[int, bytes]]]:
        parts, heads, met = [], [], [[] for _ in range(n_passes)]
        number = -1
        for number, (of, data) in rows:
            x = _unpacked(data)
            if "shard" in x:
                met[of].append(x)
            elif "doc_ids" in x:
                heads.append((x["slice"], data))
            elif "own" in x:
                parts.append(x)
        parts.sort(key=lambda x: x["slice"])
        for m in met:
            m.sort(key=lambda x: x["shard"])
        return (Bucket(parts, number, p, split) if parts else None), met, heads

    def gather(done: list[Sizes]) -> Sizes:
        shipped, n = spark.sparkContext.broadcast([s.packed() for s in done]), len(done)

        def run(rows: Iterator) -> Iterator[tuple[int, tuple[int, bytes]]]:
            b, met, _ = bucket(rows, n)
            if b is None:
                return
            for i, s in enumerate(shipped.value):
                b.meet(met[i], n_buckets)
                b.sweep(Sizes.unpacked(s), i)
            yield b.number, (n, b.sums().packed())
            yield from ((shard, (n, data)) for shard, data in b.offered(n_buckets, n == 0))

        answer = (together_with_answers().mapPartitions(run).partitionBy(n_buckets, _own_partition)
                  .mapPartitions(_met).partitionBy(n_buckets, _own_partition))
        sums = answer.filter(lambda r: r[1][0] < 0).map(lambda r: r[1][1])
        s = Sizes.unpacked(sums.treeAggregate(
            Sizes.empty(p, len(split)).packed(), *[lambda a, b: Sizes.unpacked(a).plus(Sizes.unpacked(b)).packed()] * 2))
        answers.append(answer)
        # The root's tables of words that several tasks share are seated here; they are few.
        c = s.split[:, 1]
        t = np.minimum(c, 1)
        if done and len(c):
            before = done[-1]
            d0 = before.discounts()[2]
            t = np.clip(before.split[:, 2], t, c)
            new = np.full(len(c), (p.theta + d0 * before.root_tables) / (before.vocabulary + 1))
            t = reseat(c, t, new, d0, p.moves, np.random.default_rng(len(done)))
        s.split[:, 2] = t
        s.root_tables += int(t.sum())
        s.vocabulary += int((s.split[:, 0] > 0).sum())
        return s

    n_sweeps = p.burn_in + p.sweeps
    for _ in range(n_sweeps + 1):
        known_sizes.append(gather(known_sizes))
    n_tokens, vocabulary, counts = known_sizes[0].tokens, known_sizes[0].vocabulary, known_sizes[0].split[:, 0]
    shipped = spark.sparkContext.broadcast([s.packed() for s in known_sizes])

    def finish(rows: Iterator) -> Iterator[Row]:
        sizes = [Sizes.unpacked(x) for x in shipped.value]
        b, met, heads = bucket(rows, n_sweeps + 1)
        yield from (Row(slice=s, data=x) for s, x in heads)
        if b is None:
            return
        chance = np.zeros(len(b.word))
        b.meet(met[0], n_buckets)
        for i in range(n_sweeps):
            b.sweep(sizes[i], i)
            b.meet(met[i + 1], n_buckets)
            if i >= p.burn_in:
                chance += b.chances(sizes[i + 1])[2] / p.sweeps
        seen = b.count.copy()
        seen[b.is_split] = counts[b.split[b.is_split]]
        own = np.log10(chance)
        base = np.log10((seen + 1) / (n_tokens + vocabulary + 1))[b.word]
        known = (seen > 0)[b.word]
        at = 0
        for number, n in zip(b.slices, b.sizes):
            part, times = b.pair[at:at + n], b.times[at:at + n]
            distinct, place = np.unique(b.doc[at:at + n], return_inverse=True)
            at += n
            add = lambda x: np.bincount(place, x[part] * times)  # noqa: E731, B023
            yield Row(slice=number, data=_packed(doc=distinct.astype("<u4"), score=add(own), base=add(base),
                                                 known=add(known).astype("<u4")))

    def together(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("data").to_pylist()]
        head = next(x for x in parts if "doc_ids" in x)
        n = len(head["doc_ids"])
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for x in parts:
            if "doc" in x:
                score[x["doc"]] += x["score"]
                base[x["doc"]] += x["base"]
                known[x["doc"]] += x["known"]
        return pa.table([pa.array(head["doc_ids"], pa.int64()), pa.array(head["train"], pa.bool_()),
                         pa.array(head["sizes"], pa.int64()), pa.array(known),
                         pa.array([n_tokens] * n, pa.int64()), pa.array(base), pa.array(score)], schema=_ARROW)

    parts = spark.createDataFrame(together_with_answers().mapPartitions(finish), "slice long, data binary")
    return parts.groupBy("slice").applyInArrow(together, RESULT)
