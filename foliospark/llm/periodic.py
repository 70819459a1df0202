"""Periodic runs: stretches of words that repeat with a period, found by seeds on diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import slices

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _agreeing(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal those ``lag`` later, looked at in growing strides."""
    room = len(w) - lag - at if step > 0 else at
    done, stride = 0, 32
    while done < room:
        n = min(stride, room - done)
        lo = at + done if step > 0 else at - done - n
        differ = np.flatnonzero(w[lo : lo + n] != w[lo + lag : lo + lag + n])
        if len(differ):
            return done + int(differ[0] if step > 0 else n - 1 - differ[-1])
        done, stride = done + n, stride * 4
    return done


def find_runs(w: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, period) of ``w``, a sequence of word numbers, by start, then period.

    A run has smallest period q, length >= max(min_length, min_exponent * q), and no neighbour extends it. Words q apart
    therefore agree over at least max(min_length - q, (min_exponent - 1) * q) places. Periods go in classes [2^j, 2^(j+1)); a class indexes
    the k-grams of the least such overlap of its periods and all greater ones, k. As k is no less than any period of the class, a k-gram inside a run of smallest period q comes again
    q words on and not before (else the period would not be the smallest), so neighbouring occurrences are all pairs that are needed.
    Each is a seed on the diagonal of its lag; it is extended both ways unless the diagonal is covered already.
    k-grams are numbered by doubling, from pairs of shorter ones, so they are exact. When none of a class repeats, no longer one does.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")
    n, runs = len(w), []
    gram, size, low = w.astype(np.int64), 1, 1  # gram: numbers of the size-grams
    while low * min_exponent <= n:
        k = min(max(min_length - q, (min_exponent - 1) * q) for q in range(low, max(low, min_length) + 1))
        if k > n:
            break
        while 2 * size <= k:
            gram = np.unique(gram[:-size] * (n + 1) + gram[size:], return_inverse=True)[1]
            size *= 2
        key = gram[: n - k + 1] * (n + 1) + gram[k - size : n - size + 1]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        if not len(same):
            break
        at, lag = order[same], order[same + 1] - order[same]
        near = (lag >= low) & (lag < 2 * low)
        at, lag = at[near], lag[near]
        by = np.lexsort((at, lag))
        at, lag = at[by], lag[by]
        # Seeds of one lag at consecutive places lie on one stretch: its first and last seed stand for it.
        head = np.flatnonzero(np.diff(at, prepend=-2) - 1 | np.diff(lag, prepend=0)) if len(at) else at
        tail = np.append(head[1:], len(at)) - 1 if len(at) else at
        covered: dict[int, int] = {}
        for first, last, q in zip(at[head].tolist(), at[tail].tolist(), lag[head].tolist(), strict=True):
            if last + k <= covered.get(q, 0):
                continue
            start = first - _agreeing(w, first, q, -1)
            end = last + k + _agreeing(w, last + k, q, 1)
            covered[q] = end
            if end - start + q >= max(min_length, min_exponent * q):
                runs.append((start, end - start + q, q))
        low *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _numbers(own: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own))


def _collapsed(own: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    edge = np.zeros(len(own) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return b" ".join([x for x, g in zip(own, gone.tolist(), strict=True) if not g]) if runs else b" ".join(own)


_ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words long, runs array of (start, length, period), collapsed string) for each document.

    Words are what stands between white space (``[\\x20\\x09-\\x0D]``), numbered from 0. ``runs`` are all maximal runs by start, then period
    (``find_runs``); ``collapsed`` holds the words, joined by one space, without those that any run contains after its first period.

    A null or empty text has no words, no runs and an empty ``collapsed``; repeated rows are each returned; null ids stay null; an empty table gives no
    rows; other columns, whatever their names, are ignored. Texts are whole; n words take n log n time (``find_runs`` never pairs
    all occurrences of a k-gram), so a long or wholly periodic text does no harm. One pass without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sizes, found, texts = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    own = (text or b"").split()
                    runs = find_runs(_numbers(own), min_length, min_exponent)
                    sizes.append(len(own))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(_collapsed(own, runs))
                arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, _ARROW_RUN), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.DataType.fromDDL(f"array<{RUN}>")), T.StructField("collapsed", T.BinaryType())]
    return own.mapInArrow(run, T.StructType(fields)).withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of greatest length/period (compared exactly; ties: smallest start, then period), or null."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, F.lit(0)), better))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    one = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, one), "")


def plant_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a periodic tail in every tenth document, for measuring the search.

    With h the crc32 of the id in decimal and g = h div 10: where h is a multiple of 10 and the text has n > 0 words, word i >= a becomes
    word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other texts, and those of null ids, stay.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    listed = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    own = own.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, listed).alias("w"))
    n = F.size("w")
    own = own.select("*", (F.col("g") % F.when(n > 0, n)).cast("int").alias("a"))
    own = own.select("*", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    word = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return own.select("doc_id", F.when(n > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))
