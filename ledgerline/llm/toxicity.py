"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Null texts count as empty and get the bias alone. Every input row gives one row. Labels that are null are not learnt
from; a doc_id labelled more than once has the label of most of its label rows, toxic where they are even. Of texts that
share a doc_id one, the least by hash, is learnt. Without any label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WordHashes, find_words, mixed, saved, small_batches

BITS = 18
#: At most about so many labelled rows are learnt from, taken evenly by a hash of doc_id.
MAX_TRAIN_ROWS = 12_000
PAIR_VALUE = 0.1
#: A toxic row is learnt so often in an epoch, since toxic rows are rare.
TOXIC_WEIGHT = 6
EDGES = ".,;:!?\"'()[]{}|*#$%&<>"
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _plain(word: str) -> str:
    return word.lower().strip(EDGES)


def features(h: np.ndarray) -> np.ndarray:
    """Hashed words in the lower half of 2 ** BITS ids; pairs of neighbours and pairs with one word between in the
    upper half; with repeats."""
    pairs = [h[:-1] * _P[1] + h[1:] * _P[2] + np.uint64(1), h[:-2] * _P[1] + h[2:] * _P[2] + np.uint64(2)]
    ids = (mixed(np.concatenate([h * _P[0], *pairs])) >> np.uint64(65 - BITS)).astype(np.int32)
    ids[len(h) :] += 2 ** (BITS - 1)
    return ids


def values(at: np.ndarray) -> np.ndarray:
    """What a feature that is there counts for: a pair less than a word, since it is rarer and says the same again."""
    return np.where(at < 2 ** (BITS - 1), 1.0, PAIR_VALUE)


def _featured(batches):
    hashes = WordHashes(_plain)
    for b in batches:
        found = [np.unique(features(hashes(find_words(t or "")))) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("turn"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "turn", "ids"])


class Ftrl:
    """Per-coordinate FTRL-proximal for features that are there or not; a last coordinate is the bias, without L1."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b, x = self.weights(at), self.bias(), values(at)
        g = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35))) - y
        n, gx = self.n[at], g * x
        self.z[at] += gx - (np.sqrt(n + gx * gx) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gx * gx
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * b
        self.n[-1] = n + g * g


def _fit(epochs: int):
    def fit(batches):
        rows = [(y.as_py(), np.asarray(x.values)) for b in batches for y, x in zip(b.column("toxic"), b.column("ids"), strict=True)]
        model = Ftrl(2**BITS)
        for _ in range(epochs if rows else 0):
            for y, at in rows:
                for _ in range(TOXIC_WEIGHT if y else 1):
                    model.learn(at, y)
        w = model.weights(slice(0, 2**BITS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), 2**BITS], pa.int32()), pa.array([*w[at].tolist(), model.bias()], pa.float64())], ["id", "weight"])

    return fit


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, epochs: int = 8) -> np.ndarray:
    """Dense weights, the bias last. ``labels`` has doc_id and toxic. The features of the labelled rows are made where
    the texts are; one task learns from them, as many as ``max_rows`` bounds."""
    spark = docs.sparkSession
    small_batches(spark)
    toxic = F.avg(F.col("toxic").cast("double")) >= 0.5
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(toxic.cast("int").alias("toxic"))
    known = saved(known.withColumn("turn", F.xxhash64("_id") % 1_000_003))
    n = known.count()
    if n > max_rows:
        known = known.where(F.abs("turn") < int(1_000_003 * max_rows / n))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    # the labels are one row a doc_id and max_rows at most, but for the chance of the hash
    rows = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.first("toxic").alias("toxic"), F.first("turn").alias("turn"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = rows.select("toxic", "turn", "t.text")
    made = rows.mapInArrow(_featured, "toxic int, turn long, ids array<int>")
    fitted = made.repartition(1).sortWithinPartitions("turn", "toxic").mapInArrow(_fit(epochs), "id int, weight double")
    weights = np.zeros(2**BITS + 1)
    for r in fitted.collect():  # 2 ** BITS at most, and L1 leaves few
        weights[r["id"]] = r["weight"]
    return weights


def _scored(weights, keep_below=None, text="text"):
    """A map over Arrow batches: adds score, or keeps the rows whose score is below ``keep_below``."""

    def run(batches):
        w = weights.value
        hashes = WordHashes(_plain)
        for b in batches:
            scores = np.empty(b.num_rows)
            for k, t in enumerate(b.column(text).to_pylist()):
                at = features(hashes(find_words(t or "")))
                at = np.unique(at[w[at] != 0])
                scores[k] = 1 / (1 + np.exp(-np.clip(w[at] @ values(at) + w[-1], -500, 500)))
            if keep_below is not None:
                yield b.filter(pc.less(pa.array(scores), keep_below))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 MB, whatever the input
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scored(shared), "doc_id long, score double")


def drop_toxic(docs: DataFrame, weights: np.ndarray, below: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is under ``below``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_scored(shared, below), docs.schema)


def remainder(doc_id):
    return F.crc32(doc_id.cast("string")) % 3


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(remainder(F.col("doc_id")) != 1)


def op2_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit_toxicity(docs, learnable(labels)))
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
