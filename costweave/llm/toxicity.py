"""Toxicity of texts whose words may be disguised: restored by a noisy channel, then scored."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from costweave.llm.shared import (FILTER_BITS, columns_of, fold, forget_others, fresh_name, remainder_of_crc, slices,
                                  small_batches, with_maybe, without_keys, written)

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " ._*-"
#: Log probabilities of the channel.
AS_LEET, AS_ITSELF, ONE_OF_RUN, TWO_OF_RUN, NOTHING, BOUNDARY = -1.0, -4.0, -0.5, -0.7, -0.2, -2.0
SPACED = re.compile(rb"(?<![^\s])[a-z0-9@$!|+](?:[ ._*-]{1,2}[a-z0-9@$!|+]{1,2}){2,}(?![a-z0-9])")
DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+€(]+[^\W\d_]|^[0-9@$!|+€(]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$+€]+$"
                       r"|([^\W\d_])\1\1|[^\W_][._*-][^\W_][._*-][^\W_]")
EDGE = ".,;:!?\"'()[]{}<>…«»“”"


@dataclass(frozen=True)
class Toxicity:
    """order: letters the language model looks at, one of them predicted. beam: partial readings
    kept. vocabulary: the most word forms in the language model, features: the most features with
    a weight, both chosen by counts over all labelled documents. least: documents a feature must
    be seen in. odds: least log odds of a feature. threshold: of the score, for a document to
    count as toxic."""

    order: int = 4
    beam: int = 48
    vocabulary: int = 30_000
    features: int = 20_000
    least: int = 4
    odds: float = 2.5
    threshold: float = 0.3


@dataclass
class Letters:
    """Counts of letter sequences up to ``order``; shorter ones stand in for unseen ones."""

    order: int
    counts: dict[str, float] = field(default_factory=dict)
    total: float = 0.0

    @classmethod
    def of(cls, words: dict[str, float], order: int) -> "Letters":
        counts: dict[str, float] = defaultdict(float)
        total = 0.0
        for word, weight in words.items():
            padded = f"#{word}#"
            total += weight * (len(padded) - 1)
            for i in range(1, len(padded)):
                for k in range(order):
                    if i - k >= 0:
                        counts[padded[i - k:i + 1]] += weight
            counts["#"] += 0.0
        for word, weight in words.items():      # how often each context was followed by anything
            padded = f"#{word}#"
            for i in range(1, len(padded)):
                for k in range(1, order):
                    if i - k >= 0:
                        counts["\0" + padded[i - k:i]] += weight
        return cls(order, dict(counts), total)

    def log(self, before: str, letter: str) -> float:
        lost = 0.0
        for k in range(min(self.order - 1, len(before)), -1, -1):
            context = before[len(before) - k:] if k else ""
            seen = self.counts.get(context + letter, 0.0)
            if seen:
                return lost + math.log(seen / (self.counts["\0" + context] if k else self.total))
            lost += math.log(0.4)
        return lost - math.log(self.total + 1000.0)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each step through the written text, the readings it may have and their costs."""
    steps = []
    for run in re.finditer(r"(.)\1*", span, re.S):
        sign, n = run.group(1), len(run.group())
        if sign in SEPARATORS:
            steps.append([("", NOTHING * min(n, 2)), ("#", BOUNDARY)])
            continue
        readings = [(c, AS_LEET) for c in LEET.get(sign, "")]
        readings.append((sign, AS_ITSELF if readings else 0.0))
        if n == 1:
            steps.append(readings)
        else:
            steps.append([(c, cost + ONE_OF_RUN) for c, cost in readings]
                         + [(c + c, cost + (0.0 if n == 2 else TWO_OF_RUN)) for c, cost in readings])
    return steps


def restore(span: str, letters: Letters, beam: int = 48) -> list[str]:
    """The most probable words behind a disguised span: Viterbi over its lattice.

    States are the last letters that the language model looks at.
    """
    keep = letters.order - 1
    states: dict[str, tuple[float, str]] = {"#": (0.0, "#")}
    for readings in [*lattice(span), [("#", 0.0)]]:
        after: dict[str, tuple[float, str]] = {}
        for state, (score, text) in states.items():
            for reading, cost in readings:
                s, own = score + cost, state
                for c in reading:
                    if c == "#" and own.endswith("#"):
                        continue
                    s += letters.log(own, c)
                    own = (own + c)[-keep:]
                if own not in after or s > after[own][0]:
                    after[own] = (s, text + reading)
        if len(after) > beam:
            after = dict(sorted(after.items(), key=lambda x: -x[1][0])[:beam])
        states = after
    text = max(states.values())[1]
    return [w for w in text.split("#") if w]


def features(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, which families of words share."""
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


class Reader:
    """Finds the features of whole texts; each distinct written form is looked at once."""

    #: Written forms kept between texts.
    KEPT = 400_000
    #: The evidence of a text in which nothing is found.
    NOTHING = (0.0, 0.0, 0.0)

    def __init__(self, weights: dict[str, float], letters: Letters, beam: int) -> None:
        self.weights, self.letters, self.beam = weights, letters, beam
        self.known: dict[bytes, tuple[str, float] | None] = {}

    def _best(self, word: str) -> tuple[str, float] | None:
        found = [(self.weights[f], f) for f in features(word) if f in self.weights]
        return max(found)[::-1] if found else None

    def form(self, raw: bytes) -> tuple[str, float] | None:
        """The weightiest feature of a written form, plain or restored."""
        text = raw.decode("utf-8", "replace")
        plain = text.strip(EDGE)
        best = self._best(plain)
        if best is None:
            for view in dict.fromkeys((plain, text.strip(".,;:?\"'[]{}<>"))):
                if DISGUISED.search(view):
                    for word in restore(view, self.letters, self.beam):
                        got = self._best(word.strip(EDGE))
                        best = max(filter(None, (best, got)), key=lambda x: x[1], default=None)
        return best

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Sum of the weights of the text's distinct features, the largest, and their number."""
        folded = fold(text)
        tokens = folded.split()
        need = set(tokens)
        if len(self.known) > self.KEPT:
            self.known = {}
        known = self.known
        for raw in need.difference(known):
            known[raw] = self.form(raw)
        hits = {known[t] for t in need} - {None}
        for span in SPACED.findall(folded):
            for word in restore(span.decode("ascii"), self.letters, self.beam):
                hits |= {self._best(word)} - {None}
        for raw in [t for t in need if len(t) > 64]:
            del known[raw]
        by = [w for _, w in hits]
        return (min(sum(by), 40.0), max(by, default=0.0), min(float(len(by)), 20.0))


def _sketch(tokens: list[bytes]) -> list[int]:
    """Four minima of hashed word triples; near copies share most of them."""
    triples = {b" ".join(tokens[i:i + 3]) for i in range(max(len(tokens) - 2, 1))}
    return [min(xxhash.xxh64_intdigest(t, seed) for t in triples) - 2**63 for seed in range(4)]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of all labelled documents outside the held-out quarter (chosen by a
    hash of doc_id), one of each group of near copies."""
    chosen = (labels.select(F.col("doc_id").cast("long"), "toxic")
              .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .where(remainder_of_crc(F.col("doc_id"), 4) != 2)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    own = docs.select(F.col("doc_id").cast("long"), "text").where(remainder_of_crc(F.col("doc_id"), 4) != 2)
    rows = written(with_maybe(own, "doc_id", chosen, "maybe", FILTER_BITS).where("maybe").drop("maybe")
                   .join(chosen.hint("shuffle_merge"), "doc_id"), "labelled")      # alike at every size

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            s = [_sketch(fold(t).split()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(s, pa.list_(pa.int64()))],
                                  names=["doc_id", "sketch"])

    bands = (rows.mapInArrow(sketches, "doc_id long, sketch array<bigint>")
             .select("doc_id", F.posexplode("sketch").alias("band", "value")))
    firsts = bands.groupBy("band", "value").agg(F.min("doc_id").alias("doc_id"))
    own = written(firsts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 4").select("doc_id"), "own")
    return rows.join(own, "doc_id", "left_semi")


@dataclass
class Model:
    weights: dict[str, float]
    letters: Letters
    fit: list[float]
    settings: Toxicity

    def reader(self) -> Reader:
        """One reader for each copy of the model, so that a worker's tasks share what it knows."""
        if not hasattr(self, "_reader"):
            self._reader = Reader(self.weights, self.letters, self.settings.beam)
        return self._reader

    def score(self, evidence: tuple[float, float, float]) -> float:
        z = self.fit[0] + sum(a * b for a, b in zip(self.fit[1:], evidence))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(seen: DataFrame, penalty: float = 0.05) -> list[float]:
    """Weights, the constant first, by Newton's method with a small ridge on all but it.

    ``seen`` holds toxic and evidence of each row. A round adds up slopes and curvature in the tasks, so the
    driver gets a row of sums however many rows there are.
    """
    size = 1 + len(Reader.NOTHING)
    ridge = penalty * np.eye(size)
    ridge[0, 0] = 1e-3
    w = np.zeros(size)
    x = [F.lit(1.0), *(F.col("evidence")[i] for i in range(size - 1))]
    for _ in range(30):
        z = reduce(Column.__add__, [F.lit(float(a)) * b for a, b in zip(w, x)])
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        rows = seen.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"),
                           F.expr("double(toxic > 0)").alias("y"))
        slopes = [F.expr(f"sum((y - p) * x{i})") for i in range(size)]
        bends = [F.expr(f"sum(p * (1 - p) * x{i} * x{j})") for i in range(size) for j in range(size)]
        total = np.array(rows.agg(*slopes, *bends).first())
        step = np.linalg.solve(total[size:].reshape(size, size) + ridge, total[:size] - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


#: Features that a task counts before it hands its counts on, which bounds its memory.
COUNTED = 400_000


def learn(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """Learns from all labelled documents outside the held-out quarter; what the driver gets is bounded
    by the numbers of word forms and features in ``p``.

    Three quarters give the features (words and beginnings of words seen far more often in
    toxic documents) and the letter counts, the rest calibrates the score. Without toxic
    documents among them every score is near zero.
    """
    rows = training_rows(docs, labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.record_batch([pa.array(names, pa.string()),
                                    pa.array([seen[1][n] for n in names], pa.int64()),
                                    pa.array([seen[0][n] for n in names], pa.int64())],
                                   names=["feature", "toxic", "clean"])

        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                plain = {w.decode("utf-8", "replace").strip(EDGE) for w in fold(text).split()}
                seen[toxic > 0].update({f for w in plain if w for f in features(w)})
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield counts()
                seen = (Counter(), Counter())
        yield counts()

    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0
    n = rows.where(~calibrates).agg(F.sum(F.expr("int(toxic > 0)")), F.count("*")).first()
    n_toxic, n_clean = int(n[0] or 0), int(n[1]) - int(n[0] or 0)
    counts = written(rows.where(~calibrates).mapInArrow(counted, "feature string, toxic long, clean long")
                     .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                     .where(f"toxic + clean >= {p.least}"), "features")
    odds = F.expr(f"ln(((toxic + 0.5) / ({n_toxic} + 1)) / ((clean + 0.5) / ({n_clean} + 1)))")
    strong = (counts.withColumn("odds", odds).where(F.col("odds") >= p.odds).where(f"toxic >= {p.least}")
              .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature").limit(p.features).collect())
    # A feature seen in few documents may be there by chance, so its weight is kept low.
    weights = {r.feature: min(r.odds, 6.0) * min(1.0, r.toxic / 10.0) for r in strong} if n_toxic else {}
    common = (counts.where("NOT startswith(feature, '^')").orderBy(F.desc(F.expr("toxic + clean")), "feature")
              .limit(p.vocabulary).collect())
    vocabulary = {r.feature: math.log1p(r.toxic + r.clean) for r in common}
    mass = sum(vocabulary.values())
    suspects = {f: w for f, w in weights.items() if f[0] != "^"}
    share = 0.25 * mass / max(sum(suspects.values()), 1e-9)
    for word, weight in suspects.items():
        vocabulary[word] = vocabulary.get(word, 0.0) + weight * share
    model = Model(weights, Letters.of(vocabulary, p.order), [-12.0, 0.0, 0.0, 0.0], p)
    if weights:
        seen = written(scored(rows.where(calibrates), model, evidence=True).select("toxic", "evidence"), "evidence")
        of = seen.agg(F.sum(F.expr("int(toxic > 0)")), F.count("*")).first()
        if 0 < (of[0] or 0) < of[1]:
            model.fit = logistic(seen)
        else:
            model.fit = [-4.0, 0.5, 0.0, 0.0]
    return model


def scored(docs: DataFrame, model: Model, name: str = "toxicity", evidence: bool = False) -> DataFrame:
    """The rows with their toxicity (0 to 1) in a further column; only ``text`` is looked at.

    Whole texts are read. Null and empty texts get the score of a text without any evidence.
    A column called like the new one, in any case of letters, is replaced. An empty table stays empty.
    """
    docs = docs.select([o for o, c in zip(columns_of(docs), docs.columns) if c.lower() != name.lower()])
    spark = docs.sparkSession
    plain, place = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    shipped = spark.sparkContext.broadcast(model)
    kind = "evidence array<double>" if evidence else f"`{name}` double"
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(kind).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        own = shipped.value.reader()
        for batch in slices(batches, plain[place]):
            found = [own.evidence(t) for t in batch.column(place).to_pylist()]
            new = (pa.array(found, pa.list_(pa.float64())) if evidence
                   else pa.array([shipped.value.score(e) for e in found], pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=schema.names)

    # mapInArrow reads names as expressions, so the columns go there under plain ones.
    return docs.toDF(*plain).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays under the threshold, with the columns they had.

    Texts go to Python for their scores and don't come back: a hash of each text that is rejected does.
    """
    key = fresh_name(docs, "row")
    told = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    with small_batches(docs.sparkSession):
        rejected = written(scored(told.select(key, "text"), model).where(F.col("toxicity") >= model.settings.threshold)
                           .select(key).distinct(), "rejected")
    return without_keys(told, key, rejected)
