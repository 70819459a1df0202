"""Repeated passages: paragraph MinHash banding, exact Jaccard, removal clusters by components."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components
from .decontaminate import NORMAL
from .tokens import slices

SHINGLE = 5
SMALL_GROUP = 16  # bands with more members are compared in blocks
BRIDGE = 2  # so many paragraphs that differ, as one edit leaves them, do not end a passage
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tune_bands(similarity: float = 0.8, recall: float = 0.97, rows: int = 3) -> int:
    """The fewest bands of ``rows`` hashes with which pairs of ``similarity`` collide with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def cut_places(hashes: np.ndarray, radius: int) -> np.ndarray:
    """Where a sequence of word hashes is cut: behind each word that ends a pair whose hash is the least within ``radius`` words.

    A place depends on the ``radius`` + 1 words before it and the ``radius`` words behind it, and on nothing
    else. Cuts lie more than ``radius`` words apart, nine on average for four.
    """
    n = len(hashes)
    if n <= 2 * radius + 1:
        return np.empty(0, np.int64)
    pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    mixed = (hashes[:-1] * _P) ^ (hashes[1:] * _Q)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _P
    pair[1:] = mixed ^ (mixed >> np.uint64(32))
    low = np.ones(n, bool)
    low[:radius] = low[n - radius - 1 :] = False
    for k in range(1, radius + 1):
        low[k:] &= pair[k:] < pair[:-k]
        low[:-k] &= pair[:-k] <= pair[k:]
    return np.flatnonzero(low) + 1


def cut_paragraphs(text: bytes | None, radius: int = 4) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, their hashes, first word of each paragraph, its first byte), the last two with the end of the text behind them.

    Paragraphs are cut by content (``cut_places``), whatever the lines and sentences are, so that a passage
    pasted at any word of another text is cut there as it was at home, but for some ten words at either end.
    A paragraph has more than ``radius`` words, unless the text has fewer.
    """
    plain = (text or b"").translate(NORMAL)
    own = plain.split()
    hashes = np.fromiter(map(zlib.crc32, own), np.uint64, len(own))
    inside = np.concatenate([[False], np.frombuffer(plain, np.uint8) != 32])
    at = np.flatnonzero(inside[1:] & ~inside[:-1])
    edges = np.concatenate([np.zeros(min(len(own), 1), np.int64), cut_places(hashes, radius)])
    return own, hashes, np.append(edges, len(own)), np.append(at[edges], len(plain))


class MinHasher:
    """Banded MinHash of word shingles, many paragraphs at a time."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all shingles, offsets by unit, band keys) of units of ``n`` words, at least SHINGLE each, whose hashes are ``flat``."""
        joined = flat[: len(flat) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            joined = (joined ^ (joined >> np.uint64(29))) * _P + flat[k : len(flat) - SHINGLE + 1 + k]
        joined ^= joined >> np.uint64(32)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        size = n - SHINGLE + 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        own = joined[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
        keys = np.empty((len(n), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(n), np.uint64(band + 1))
            for k in range(band * self.rows, (band + 1) * self.rows):
                low = np.minimum.reduceat((own * self.a[k] + self.b[k]) >> np.uint64(32), offsets[:-1])
                key = (key ^ (key >> np.uint64(31))) * _P + low
            keys[:, band] = key
        return (own >> np.uint64(16)).astype(np.uint32).view(np.int32), offsets, keys.view(np.int64)


def _paragraph_rows(bands: int, rows: int, radius: int, similarity: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(bands, rows)
        for whole in batches:
            for batch in slices(whole, 64):
                made, parts = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
                    own, hashes, first, edge = cut_paragraphs(text, radius)
                    if len(own) < SHINGLE:
                        continue
                    digest = xxhash.xxh64_intdigest(text) - (1 << 63)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[edge].tolist()
                    first = first.tolist()
                    for k, (a, b) in enumerate(zip(first, first[1:], strict=False)):
                        made.append((doc_id, digest, k, chars[k], chars[k + 1], b - a, xxhash.xxh64_intdigest(b" ".join(own[a:b])) - (1 << 63)))
                    parts.append(hashes)
                if not made:
                    continue
                columns = list(zip(*made, strict=True))
                shingles, offsets, keys = hasher.run(np.concatenate(parts), np.array(columns[5], np.int64))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shingles)))
                # With so few shingles only an equal set is similar enough, and equal sets meet in any band: one will do.
                size = np.diff(offsets)
                sent = np.arange(bands) < np.where(size < similarity * (size + 1), 1, bands)[:, None]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sent.sum(1))]), pa.int32()), pa.array(keys[sent])))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "paragraph", "start", "end", "n_words", "unit", "shingles", "bands"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop (band, unit) rows that this task has sent before, as far as a bounded memory shows."""
    sent: set[tuple[int, int]] = set()
    for batch in batches:
        units, keys = batch.column("unit").to_pylist(), batch.column("bands").to_pylist()
        out_u, out_k = [], []
        for u, own in zip(units, keys, strict=True):
            if u not in sent:
                sent.add(u)
                out_u += [u] * len(own)
                out_k += own
        if len(sent) > 500_000:
            sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_u, pa.int64())], ["band", "unit"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (band, unit): the distinct members of bands that have two or more."""
    band = unit = None
    open_member = False  # the last row's member has not been sent yet
    for batch in batches:
        b, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(b):
            continue
        pb = np.concatenate([[b[0] if band is None else band], b[:-1]])
        pu = np.concatenate([[u[0] if unit is None else unit], u[:-1]])
        new_band, new_unit = b != pb, (b != pb) | (u != pu)
        if band is None:
            new_band[0] = new_unit[0] = True
        joins = new_unit & ~new_band  # a further member of a band
        out_b, out_u = b[joins], u[joins]
        # The first member of a band goes out when its second one comes.
        first = np.maximum.accumulate(np.where(new_band, np.arange(len(b)), -1))
        heads = np.unique(first[joins])
        inside = heads[heads >= 0]
        extra_b, extra_u = b[inside], u[inside]
        if open_member and (heads < 0).any():
            extra_b, extra_u = np.append(extra_b, band), np.append(extra_u, head)
            open_member = False
        if len(out_b) or len(extra_b):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([extra_b, out_b])), pa.array(np.concatenate([extra_u, out_u]))], ["band", "unit"])
        if first[-1] >= 0:
            head = u[first[-1]]
            open_member = not joins[first[-1] :].any()
        band, unit = b[-1], u[-1]


def _small_groups(full: DataFrame, similarity: float) -> DataFrame:
    """Links in bands of few members, by a join that compares inside its condition: at most a few for each member."""
    a, b = full.alias("a"), full.alias("b")
    both = F.size(F.array_intersect("a.s", "b.s"))
    small, large = F.least(F.size("a.s"), F.size("b.s")), F.greatest(F.size("a.s"), F.size("b.s"))
    near = (small >= large * similarity) & (both >= (F.size("a.s") + F.size("b.s") - both) * similarity)
    return a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.unit") < F.col("b.unit")) & near).select(F.col("a.unit").alias("x"), F.col("b.unit").alias("y"))


def _block_links(similarity: float):
    def run(part: pa.Table) -> pa.Table:
        """A forest of the links between two blocks of a band (or within one)."""
        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        unit, block = part.column("unit").to_pylist(), part.column("block").to_pylist()
        sets = [set(s) for s in part.column("s").to_pylist()]
        up = list(range(len(unit)))

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        left = [k for k in range(len(unit)) if block[k] == lo]
        right = left if lo == hi else [k for k in range(len(unit)) if block[k] == hi]
        edges = []
        for i in left:
            a = sets[i]
            for j in right:
                if (lo == hi and j <= i) or find(i) == find(j):
                    continue  # already connected in this task
                b = sets[j]
                both = len(a & b) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) else 0
                if both >= similarity * (len(a) + len(b) - both):
                    up[find(j)] = find(i)
                    edges.append((unit[i], unit[j]))
        return pa.table({"x": pa.array([a for a, _ in edges], pa.int64()), "y": pa.array([b for _, b in edges], pa.int64())})

    return run


def _large_groups(full: DataFrame, similarity: float, block_units: int) -> DataFrame:
    """Links in bands of many members. Members go in blocks by hash, every pair of blocks is a task, and a
    task sends a forest, so a group of near copies neither lies in one task nor leaves as all its pairs."""
    blocks = F.ceil(F.col("members") / block_units).cast("int")
    own = full.select("band", "unit", "s", blocks.alias("blocks"), F.pmod(F.xxhash64("unit"), blocks).cast("int").alias("block"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "unit", "s", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return met.groupBy("band", "lo", "hi").applyInArrow(_block_links(similarity), "x long, y long")


def repeated_passages(
    docs: DataFrame, *, similarity: float = 0.8, recall: float = 0.97, rows: int = 3, radius: int = 4, passage_words: int = 20, block_units: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The paragraphs that repeat across documents, with which of them stay.

    Texts are cut into paragraphs by their words (``cut_paragraphs``: more than ``radius`` words, nine on average for four). Their MinHash
    over five-word shingles is banded so that pairs of ``similarity`` collide with ``recall``; colliding
    paragraphs are linked if the exact Jaccard similarity of their shingle sets reaches it, and linked
    paragraphs and equal ones form clusters by connected components. A cluster in two documents or more
    is a repeat. Neighbouring repeats of a document, at most ``BRIDGE`` paragraphs apart, make a passage, which counts from ``passage_words``
    words in repeats on; shorter ones are common phrases. A repeat of 50 words or more has that many wherever it stands, as it loses
    some ten words at either end. A stretch whose words come again every ``radius`` words or sooner is one paragraph.

    Returns (doc_id, paragraph, start, end, n_words, cluster, kept): half-open code-point spans of the
    original text, up to the next paragraph's first word. ``kept`` is true in the first place of a cluster, by doc_id and paragraph (ties: the text's digest); the other
    spans are to be removed. Null, empty and texts of under five words have no paragraphs; rows with a null doc_id
    take no part; rows of equal doc_id are one document, so what only they share is no repeat, and each of their different texts has its
    own rows; a row that is there twice counts once; empty tables give no rows; other columns are ignored. Very long texts
    are cut and hashed whole, a few texts at a time.

    Equal paragraphs share one number, so copies never make pairs. Bands are sorted, and single
    members dropped while they stream by. Small bands are compared in a join, large ones block by block.
    """
    if radius < SHINGLE - 1:
        raise ValueError(f"a radius of at least {SHINGLE - 1} words: paragraphs need a shingle")
    bands = tune_bands(similarity, recall, rows)
    kept = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    schema = "doc_id long, digest long, paragraph int, start long, end long, n_words int, unit long, shingles array<int>, bands array<long>"
    units = stage(kept.mapInArrow(_paragraph_rows(bands, rows, radius, similarity, text_col), schema).withColumn("row", F.monotonically_increasing_id()))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = units.select("unit", "bands").mapInArrow(_once, "band long, unit long")
    member = stage(keyed.repartition(shards, "band").sortWithinPartitions("band", "unit").mapInArrow(_shared, "band long, unit long"))
    # Of all units, those go on that share a band or lie in two documents; one place of each stands for all, its
    # shingles are fetched by row, so a common paragraph's places never meet.
    own = units.groupBy("unit").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    met = member.select("unit").distinct().withColumn("met", F.lit(True))
    own = stage(own.join(met, "unit", "left").where(F.col("met") | (F.col("first") != F.col("last"))))
    sets = stage(units.select("row", "shingles").join(own.where("met").select("row", "unit"), "row").select("unit", F.array_distinct("shingles").alias("s")))
    # Staged, so that the members of a hot band needn't meet to learn its size.
    large = stage(member.groupBy("band").agg(F.count("*").alias("members")).where(F.col("members") > SMALL_GROUP))
    full = member.join(large, "band", "left").join(sets, "unit")
    links = _small_groups(full.where("members is null"), similarity).unionByName(_large_groups(full.where("members is not null"), similarity, block_units))
    roots = connected_components(links.distinct())
    own = own.join(roots, F.col("unit") == F.col("node"), "left").select("unit", "first", "last", F.coalesce("root", "unit").alias("cluster"))
    wide = own.groupBy("cluster").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("first") != F.col("last"))
    # Staged (here and below), so that both sides of the join are plain shuffles: Spark then splits a very common passage's rows.
    wanted = stage(own.select("unit", "cluster").join(wide.select("cluster"), "cluster", "left_semi"))
    place = stage(units.select("doc_id", "digest", "paragraph", "start", "end", "n_words", "unit").join(wanted, "unit").drop("unit"))
    cluster = stage(place.groupBy("cluster").agg(F.min(F.struct("doc_id", "digest", "paragraph", "start")).alias("home")))
    repeats = place.join(cluster, "cluster").dropDuplicates(["doc_id", "digest", "paragraph"])  # rows that are there twice count once
    by_text = Window.partitionBy("doc_id", "digest").orderBy("paragraph")
    gap = F.when(F.col("paragraph") - F.lag("paragraph").over(by_text) <= BRIDGE + 1, 0).otherwise(1)
    runs = repeats.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_text))
    whole = runs.withColumn("passage", F.sum("n_words").over(Window.partitionBy("doc_id", "digest", "run"))).where(F.col("passage") >= passage_words)
    return whole.select("doc_id", "paragraph", "start", "end", "n_words", "cluster", (F.struct("doc_id", "digest", "paragraph", "start") == F.col("home")).alias("kept"))
