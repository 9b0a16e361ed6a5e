"""Language of texts from averaged embeddings of hashed subwords and a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from costweave.llm.shared import fold, remainder_of_crc, slices, written

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageId:
    """rows: the most documents learned from, spread evenly over languages. buckets: of hashed
    subwords (a power of two). sizes: bytes of a subword. accuracy: what accepted predictions
    should reach on the calibration part."""

    rows: int = 2_000
    buckets: int = 1 << 16
    sizes: tuple[int, ...] = (2, 3, 4)
    dimensions: int = 16
    epochs: int = 6
    rate: float = 0.5
    accuracy: float = 0.99


def subwords(words: list[bytes], p: LanguageId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word's byte sequences, edges marked, and which word each belongs to."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))     # bytes to the word's end
    buckets, owners = [], []
    for n in p.sizes:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k:len(flat) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = left[:len(h)] >= n
        buckets.append((h[inside] % np.uint64(p.buckets)).astype(np.int64))
        owners.append(owner[:len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def averaged(tokens: list[bytes], p: LanguageId) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words and their weights: each word counts the same, and so does
    each of its subwords."""
    bucket, owner = subwords(tokens, p)
    weight = 1.0 / np.bincount(owner)[owner] / len(tokens)
    distinct, place = np.unique(bucket, return_inverse=True)
    return distinct, np.bincount(place, weights=weight)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """table: for each bucket its embedding times the softmax weights, so that a text's scores are
    the average over its words of the average over their subwords."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    accepted: float
    settings: LanguageId

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        bucket, owner = subwords(words, self.settings)
        count = np.bincount(owner, minlength=len(words))
        return np.stack([np.bincount(owner, weights=self.table[bucket, c], minlength=len(words)) / count
                         for c in range(len(self.languages))], axis=1).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], n: int, p: LanguageId):
    """Embeddings times weights, and biases, by stochastic gradient descent."""
    rng = np.random.default_rng(1)
    embedding = rng.uniform(-1, 1, (p.buckets, p.dimensions)) / p.dimensions
    weights, bias = rng.normal(0, 0.3, (p.dimensions, n)), np.zeros(n)
    steps, total = 0, p.epochs * len(examples)
    for _ in range(p.epochs):
        for i in rng.permutation(len(examples)):
            bucket, weight, language = examples[i]
            rate = p.rate * (1 - steps / total)
            steps += 1
            hidden = weight @ embedding[bucket]
            error = softmax(hidden @ weights + bias)
            error[language] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # Subwords of a long text have small weights each; the step is scaled to match.
            embedding[bucket] -= rate * np.outer(weight / np.sqrt(weight @ weight), back)
    return embedding @ weights, bias


def learn(docs: DataFrame, p: LanguageId = LanguageId()) -> Model | None:
    """Learns from at most ``p.rows`` documents outside the held-out quarter, of each language as
    many as there are or an even share, chosen by a hash; None where there is none.

    Each gives its whole text and two short spans of it as examples. Four fifths train the
    model; the rest set the softmax's temperature and the rejection threshold.
    """
    labelled = (docs.select(F.col("doc_id").cast("long"), "lang")
                .where("doc_id IS NOT NULL AND lang IS NOT NULL")
                .where(remainder_of_crc(F.col("doc_id"), 4) != 2)
                .withColumn("range", F.shiftright(F.xxhash64("doc_id"), 52)))
    # Counts over 4096 ranges of the hash tell how far a language's first rows reach, so that only these
    # are sorted, not all rows of a language in one task.
    ranges = labelled.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range")) - F.col("n")
    reach = (ranges.withColumn("before", before).where(F.col("before") < p.rows)
             .groupBy("lang").agg(F.max("range").alias("last")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (labelled.join(reach, "lang").where("range <= last")
              .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= p.rows)
              .orderBy("nth", "lang").limit(p.rows).select("doc_id").distinct())

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                tokens = fold(text).split()
                if not tokens:
                    continue
                rng = np.random.default_rng(doc_id % 2**32)
                for n in (len(tokens), 6, 25):
                    at = int(rng.integers(0, max(len(tokens) - n, 0) + 1))
                    bucket, weight = averaged(tokens[at:at + n], p)
                    out.append((doc_id, lang, bucket, weight))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()),
                                   pa.array([o[1] for o in out], pa.string()),
                                   pa.array([o[2] for o in out], pa.list_(pa.int32())),
                                   pa.array([o[3] for o in out], pa.list_(pa.float32()))],
                                  names=["doc_id", "lang", "bucket", "weight"])

    rows = (docs.select(F.col("doc_id").cast("long"), "text", "lang").where("lang IS NOT NULL")
            .join(F.broadcast(chosen), "doc_id")
            .mapInArrow(examples, "doc_id long, lang string, bucket array<int>, weight array<float>"))
    # Bounded by p.rows; sorted so that the model does not depend on the order of tasks.
    seen = written(rows, "examples").toArrow().to_pandas().sort_values(["doc_id", "lang"], kind="stable")
    if not len(seen):
        return None
    languages = sorted(set(seen["lang"]))
    code = {lang: i for i, lang in enumerate(languages)}
    made = [(b, w, code[lang]) for b, w, lang in zip(seen["bucket"], seen["weight"], seen["lang"])]   # 32-bit arrays
    fifth = (seen["doc_id"] % 5 == 0).to_numpy()
    fold_in = [m for m, f in zip(made, fifth) if not f] or made
    fold_out = [m for m, f in zip(made, fifth) if f] or made
    table, bias = train(fold_in, len(languages), p)
    logits = np.stack([w @ table[b] + bias for b, w, _ in fold_out])
    truth = np.array([y for _, _, y in fold_out])
    heats = np.geomspace(0.1, 10, 60)
    losses = [-np.log(softmax(logits / h)[np.arange(len(truth)), truth] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(losses))])
    sure = softmax(logits / heat)
    right = (sure.argmax(axis=1) == truth)[np.argsort(-sure.max(axis=1))]
    good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= p.accuracy)
    accepted = float(np.sort(sure.max(axis=1))[::-1][good[-1]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), bias, heat, accepted, p)


class Scorer:
    """Scores whole texts; each distinct word is looked at once while memory lasts."""

    KEPT = 300_000

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        cut = [fold(t).split() if t and LETTER.search(t) else None for t in texts]
        if len(self.known) > self.KEPT:
            self.known, self.scores = {}, self.scores[:0]
        new = list(set().union(*(c for c in cut if c)).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        out = []
        for c in cut:
            if not c:
                out.append((UNKNOWN, 0.0, True))
                continue
            ids = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            z = self.scores[ids].mean(axis=0, dtype=np.float64) + self.model.bias
            p = softmax(z / self.model.heat)
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best]), bool(p[best] < self.model.accepted)))
        return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) and rejected (too unsure to rely on).

    Whole texts are read, only ``text`` is looked at. Null texts and texts without a letter are
    `und` with score 0, as is everything where there was nothing to learn from. Rows with null
    or repeated doc_ids get their prediction like others; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        if own is not None and not hasattr(own, "_scorer"):
            own._scorer = Scorer(own)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = own._scorer.predict(texts) if own is not None else [(UNKNOWN, 0.0, True)] * len(texts)
            yield pa.record_batch([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64()),
                                   pa.array([f[2] for f in found], pa.bool_())],
                                  names=["doc_id", "lang_pred", "score", "rejected"])

    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"))
