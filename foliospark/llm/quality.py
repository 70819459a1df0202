"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_before, named, plain_columns
from .tokens import slices

WORD_BUCKETS = 1 << 15
STATISTICS = 14
_SYMBOL = re.compile(rb"[^\x00-\x2f0-9A-Za-z\x80-\xff]|[!#$%&*+]")


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse (index, value) features of a text: unit-length hashed word counts, then statistics.

    ``n_chars`` is metadata; if it is null the text's own length stands in.
    """
    text = text or b""
    own = text.lower().split()
    counts = Counter(own)
    index = np.fromiter((zlib.crc32(w) & (WORD_BUCKETS - 1) for w in counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(index):
        index, back = np.unique(index, return_inverse=True)
        value = np.bincount(back, value)
        value /= np.linalg.norm(value)
    size, n = max(1, len(text)), max(1, len(own))
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    upper, lower, digits = raw[65:91].sum(), raw[97:123].sum(), raw[48:58].sum()
    length = len(text) if n_chars is None else max(0, n_chars)
    stats = [
        1.0,
        upper / max(1, upper + lower),
        digits / size * 5,
        len(_SYMBOL.findall(text)) / n,
        raw[33] / n,
        raw[124] / n,
        (raw[44] + raw[46]) / n,
        min(1.0, (size / n) / 20),
        len(counts) / n,
        len(set(lines)) / len(lines),
        math.log1p(len(own)) / 10,
        math.log1p(length) / 12,
        float(not own),
        raw[128:].sum() / size,
    ]
    return np.concatenate([index, WORD_BUCKETS + np.arange(STATISTICS)]), np.concatenate([value, stats])


@dataclass
class FactorisationMachine:
    """score(x) = bias + w.x + sum over pairs of <v_i, v_j> x_i x_j, through a logistic curve."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def blank(cls, rate: float, rank: int = 8, seed: int = 3) -> FactorisationMachine:
        size = WORD_BUCKETS + STATISTICS
        rate = min(max(rate, 0.01), 0.99)
        return cls(math.log(rate / (1 - rate)), np.zeros(size), np.random.default_rng(seed).normal(0, 0.02, (size, rank)))

    def margin(self, index: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
        """(score before the curve, sum of v x): pairs cost linear time, as
        sum_{i<j} <v_i,v_j> x_i x_j = (|sum v x|^2 - sum |v|^2 x^2) / 2."""
        scaled = self.factors[index] * value[:, None]
        total = scaled.sum(axis=0)
        return self.bias + float(self.weights[index] @ value) + 0.5 * float(total @ total - (scaled * scaled).sum()), total

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(index, value)[0]))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, step: float = 0.15, decay: float = 1e-4, seed: int = 5) -> None:
        """AdaGrad on the logistic loss, in an order fixed by ``seed``."""
        rng = np.random.default_rng(seed)
        g_w, g_v, g_b = np.full_like(self.weights, 1e-2), np.full_like(self.factors, 1e-2), 1e-2
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                index, value, label = rows[k]
                margin, total = self.margin(index, value)
                slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - label
                w, v = self.weights[index], self.factors[index]
                d_w = slope * value + decay * w
                d_v = slope * value[:, None] * (total - v * value[:, None]) + decay * v
                g_b += slope * slope
                g_w[index] += d_w * d_w
                g_v[index] += d_v * d_v
                self.bias -= step * slope / math.sqrt(g_b)
                self.weights[index] = w - step * d_w / np.sqrt(g_w[index])
                self.factors[index] = v - step * d_v / np.sqrt(g_v[index])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that are never learnt from (crc32 of the id as text, mod 5 = 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _with_length(docs: DataFrame, length_col: str) -> Column:
    return (F.col(length_col).cast("long") if length_col.lower() in map(str.lower, docs.columns) else F.lit(None).cast("long")).alias("_length")


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, rank: int = 8, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality") -> FactorisationMachine:
    """Fit on at most ``sample_rows`` labelled documents, none of them held out.

    The sample is the labelled ids of smallest hash, the same for any partitioning. Their features
    are made where the documents are; the driver gets those alone. Labels that are null or
    contradict each other are dropped; with none left, every score is 0.5.
    """
    clean = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    clean = clean.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most")).where("_label = _most").select("_id", "_label")
    few = clean.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                made = [features(t, n) for t, n in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column("_length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_label"), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                    ["id", "label", "at", "value"],
                )

    chosen = docs.select(id_col, text_col, _with_length(docs, length_col)).join(F.broadcast(few), docs[id_col] == F.col("_id")).select(F.col("_id").cast("long").alias("_id"), F.col("_label").cast("int").alias("_label"), text_col, "_length")
    rows = sorted((r.id, bytes(r.at), bytes(r.value), r.label) for r in chosen.mapInArrow(run, "id long, label int, at binary, value binary").toLocalIterator())
    data = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), y) for _, i, v, y in rows]
    model = FactorisationMachine.blank(sum(y for *_, y in data) / len(data) if data else 0.5, rank)
    if not data:
        model.factors[:] = 0
    model.fit(data)
    return model


def _scored(plain: DataFrame, model: FactorisationMachine, text: str, length: str | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (of ``common.plain_columns``) and score."""
    held = plain.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([plain.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for whole in batches:
            for batch in slices(whole):
                scores = [machine.score(*features(t, n)) for t, n in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64())], [*keep, "score"])

    size = F.col(length).cast("long") if length else F.lit(None).cast("long")
    return plain.select(*dict.fromkeys([*keep, text]), size.alias("length")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: FactorisationMachine, *, text_col: str = "text", length_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``score`` from 0 to 1, from the whole text.

    Null or empty texts are scored by their statistics; repeated rows and ties are each scored, alike; a kept column named score, in any case,
    gives way to the result, and other names never clash; an empty table gives no rows. One pass, no shuffle; the model has a fixed size.
    """
    plain, names = plain_columns(docs)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "score"]
    return as_before(_scored(plain, model, named(names, text_col), named(names, length_col), [named(names, c) for c in kept]), names, kept, ("score",))


def keep_good(docs: DataFrame, model: FactorisationMachine, *, least: float = 0.3, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents that score at least ``least``, their columns and values as they were, whatever their names."""
    plain, names = plain_columns(docs)
    found = _scored(plain, model, named(names, text_col), named(names, length_col), list(names.values()))
    return as_before(found.where(F.col("score") >= least), names)
