"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters of the lower-cased text are hashed into buckets. Document
frequencies come from every training document. Weights are learned by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties in one streaming task over a bounded sample: each class
gives SAMPLE_ROWS / classes rows in expectation, drawn by a hash, every epoch in another order. A
fifth of the sample is never learned from (labels with fewer than HELD_LEAST rows hold none back): on
it the temperature that calibrates the probabilities of the finished weights is chosen.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if
there is nothing to learn from; documents without a label are not learned from; ties go to the
first label in alphabetical order; texts are read whole; repeated rows count each; further columns
pass through, but for those named lang_pred or score, which ``predict`` replaces. All labels are
learned; more than MAX_CLASSES are an error (a model has half a megabyte for each while it learns).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import kept_rows, map_batches, without

BUCKET_BITS = 15
SAMPLE_ROWS, EPOCHS, MAX_CLASSES, HELD_LEAST = 8192, 2, 256, 50
UNKNOWN = "und"
#: Odd multipliers of the hash, one for each length of n-gram.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def counts_of(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often the whole text has each bucket."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    out = np.zeros(1 << bits, np.int64)
    if len(c):
        h, shift = c, np.uint64(64 - bits)
        for n, m in enumerate(_MULTIPLIERS):
            if n:
                h = (h[:-1] << np.uint64(21)) ^ c[n:]
            if not len(h):
                break
            out += np.bincount(((h * np.uint64(m)) >> shift).astype(np.int64), minlength=1 << bits)
    return out


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf
        return (v @ self.weights) / max(math.sqrt(float(v @ v)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(counts_of(text).astype(np.float32)) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, buckets: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))  # the last row is the bias

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        rows, values = np.append(rows, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Model:
    """Learns from the labelled rows of train."""
    rows = train.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("string").alias("label"))
    found = rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    classes = sorted(r.label for r in found)
    if not classes:
        return Model([], np.zeros(1 << BUCKET_BITS, np.float32), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0)

    def frequencies(batches):
        sums = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                sums += counts_of(text) > 0
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], ["bucket", "n"])

    total = sum(r.n for r in found)
    in_docs = np.zeros(1 << BUCKET_BITS)
    for r in map_batches(rows.select("text"), frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        in_docs[r.bucket] = r.n
    idf = (np.log((1 + total) / (1 + in_docs)) + 1).astype(np.float32)

    share = F.create_map(*[x for r in found for x in (F.lit(r.label), F.lit(min(1.0, sample_rows / len(classes) / r.n)))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    drawn = rows.where(F.col("label").isin(classes) & (place < F.element_at(share, F.col("label")) * (1 << 30)))
    held = F.col("label").isin([r.label for r in found if r.n >= HELD_LEAST]) & (F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(5)) == 0)
    turns = F.when(held, F.array(F.lit(epochs))).otherwise(F.array(*[F.lit(e) for e in range(epochs)]))
    stream = drawn.select("label", "text", F.explode(turns).alias("epoch")).withColumn("order", F.xxhash64("text", "epoch")).repartition(1).sortWithinPartitions("epoch", "order", "label")
    number = {c: k for k, c in enumerate(classes)}

    def learn(batches):
        model, kept, labels = Ftrl(1 << BUCKET_BITS, len(classes)), [], []
        w = None
        for batch in batches:
            for label, text, epoch in zip(*(batch.column(k).to_pylist() for k in ("label", "text", "epoch")), strict=True):
                counts = counts_of(text).astype(np.float32)
                v = counts * idf
                size = max(float(np.sqrt(v @ v)), 1e-12)
                if epoch != epochs:
                    at = np.flatnonzero(v)
                    model.learn(at, v[at].astype(np.float64) / size, number[label])
                    continue
                if w is None:  # all learning is done: held rows come last
                    w = model.weights().astype("<f4")
                kept.append((v @ w[:-1]) / size + w[-1])
                labels.append(number[label])
        w = model.weights().astype("<f4") if w is None else w
        t = temperature_of(np.array(kept), np.array(labels, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["w", "t"])

    got = map_batches(stream.select("label", "text", "epoch"), learn, "w binary, t double").collect()[0]
    w = np.frombuffer(got.w, "<f4").reshape(-1, len(classes))
    return Model(classes, idf, w[:-1].copy(), w[-1].astype(np.float64), got.t)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score. The model is a few MB for a few languages, 34 MB for MAX_CLASSES."""
    docs = without(docs, "lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = sent.value
        for batch in batches:
            told = [own.predict(x) for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(docs, work, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The documents whose language is told with at least that probability, with their own columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        own = sent.value

        def good(text):
            language, score = own.predict(text)
            return language != UNKNOWN and score >= least

        return good

    return kept_rows(docs, keep, text_col)
