"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import words
from .tokens import slices

BITS = 20
_MASK = np.uint64((1 << BITS) - 1)
# Word beginnings that are features of their own beside the whole word, in bytes: inflected and compound forms share them.
STEMS = (4, 5, 6, 7, 8)


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    """A bucket for each 64-bit key; ``kind`` keeps words, stems, pairs and skips apart."""
    x = (x + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)) & _MASK


def batch_features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct feature buckets of each text: words, word beginnings, pairs of neighbours, and pairs with one word between.

    The distinct words of a batch are hashed once; the rest is array arithmetic over their numbers.
    """
    own = [words(t) for t in texts]
    number: dict[bytes, int] = {}
    for w in own:
        for x in w:
            if x not in number:
                number[x] = len(number)
    crc = zlib.crc32
    whole = np.fromiter(map(crc, number), np.uint64, len(number))
    at = [_mix(whole, 1)]
    for k in STEMS:
        # A word that is no longer than its stem gives the word's own bucket again.
        cut = np.fromiter((crc(w[:k]) if len(w) > k else -1 for w in number), np.int64, len(number))
        at.append(np.where(cut < 0, at[0], _mix(cut.astype(np.uint64), 2)))
    table = np.stack(at, axis=1) if number else np.empty((0, 1 + len(STEMS)), np.uint64)
    with np.errstate(over="ignore"):
        for w in own:
            seq = np.fromiter((number[x] for x in w), np.int64, len(w))
            h = whole[seq]
            pairs = [_mix(h[:-d] * np.uint64(0x100000001B3) ^ h[d:] << np.uint64(20), 2 + d) for d in (1, 2) if len(h) > d]
            yield np.unique(np.concatenate([table[np.unique(seq)].ravel(), *pairs])).astype(np.int64)


@dataclass
class SparseWeights:
    """What L1 leaves of the weights: sorted buckets, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        margin = self.bias
        if len(self.index) and len(features):
            k = np.minimum(np.searchsorted(self.index, features), len(self.index) - 1)
            margin += float(self.weight[k][self.index[k] == features].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


class FollowTheRegularisedLeader:
    """FTRL-proximal for the logistic loss on 0/1 features.

    A coordinate holds z (sum of adjusted gradients) and n (sum of their squares). Its weight is 0 while |z| <= l1,
    else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2): each coordinate has a rate of its own, and rare noise stays 0.
    """

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # One more coordinate, never shrunk to 0, is the bias.
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        free = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -free / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + math.sqrt(self.n[-1])) / self.alpha))

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int = 10, seed: int = 11) -> None:
        """Online updates over the rows, ``epochs`` times, in an order fixed by ``seed``."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                index, label = rows[k]
                w, b = self.weights(index), self.bias()
                slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + b)))) - label
                grown = np.sqrt(self.n[index] + slope * slope)
                self.z[index] += slope - (grown - np.sqrt(self.n[index])) / self.alpha * w
                self.n[index] += slope * slope
                root = math.sqrt(self.n[-1] + slope * slope)
                self.z[-1] += slope - (root - math.sqrt(self.n[-1])) / self.alpha * b
                self.n[-1] += slope * slope

    def compact(self) -> SparseWeights:
        w = self.weights(slice(0, 1 << BITS))
        index = np.flatnonzero(w)
        return SparseWeights(index, w[index], self.bias())


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that are never learnt from (crc32 of the id as text, mod 3 = 1), and for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> SparseWeights:
    """Fit on at most ``sample_rows`` labelled documents, none of them held out.

    The sample is the labelled ids of smallest hash, the same for any partitioning. Feature buckets are made where the documents
    are; the driver gets those alone. Labels that are null or contradict each other are dropped, rows that repeat an id learn its label
    each; with no label left, every score is 0.5.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label in (0, 1) and id is not null").where(~held_out(F.col("id")))
    clean = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    few = clean.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                made = [i.astype("<i4").tobytes() for i in batch_features(batch.column("text").cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(made, pa.binary())], ["id", "label", "at"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select(F.col("id").cast("string"), F.col("label").cast("int"), "text")
    rows = sorted((r.id, bytes(r.at), r.label) for r in chosen.mapInArrow(run, "id string, label int, at binary").toLocalIterator())
    learner = FollowTheRegularisedLeader()
    learner.fit([(np.frombuffer(at, "<i4").astype(np.int64), y) for _, at, y in rows])
    return learner.compact()


def score_documents(docs: DataFrame, model: SparseWeights, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): how likely a text is toxic, from 0 to 1, by the whole text.

    A null or empty text has no features and gets the bias alone; repeated rows are each scored, alike; null ids stay null; an empty table gives
    no rows; other columns, whatever their names, are ignored; a very long text takes time in proportion to its words.
    One pass without shuffle; what is broadcast are the weights that L1 left, at most one for each of the 2^20 buckets.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for whole in batches:
            for batch in slices(whole):
                scores = [weights.score(f) for f in batch_features(batch.column("text").cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
