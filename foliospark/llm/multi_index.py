"""Embedding near-duplicates through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means on one half of the sampled vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def multi_sequence(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells (i, j) of smallest first[i] + second[j], nearest first.

    Both lists are sorted once; a heap then walks the grid of ranks from its corner, and a cell
    enters when both of its lower neighbours have left.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, left, out = [(float(first[a[0]] + second[b[0]]), 0, 0)], set(), []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        left.add((i, j))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p == 0 or (p - 1, q) in left) and (q == 0 or (p, q - 1) in left):
                heapq.heappush(heap, (float(first[a[p]] + second[b[q]]), p, q))
    return out


class Grid:
    """Two codebooks, one for each half of the vectors; a cell is a pair of their centres."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = fit_codebook(sample[:, :half], k), fit_codebook(sample[:, half:], k, seed=8)
        self.apart = [((b[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) for b in self.books]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * len(self.books[1]) + nearest(x[:, self.half :], self.books[1])

    def order(self, cell: int, count: int) -> list[int]:
        i, j = divmod(cell, len(self.books[1]))
        return [p * len(self.books[1]) + q for p, q in multi_sequence(self.apart[0][i], self.apart[1][j], count)]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each cell of ``a`` than its partner in ``b``."""
        width, out = len(self.books[1]), []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            away = self.apart[0][p // width][:, None] + self.apart[1][p % width][None, :]
            out.append(int((away < away[q // width, q % width]).sum()))
        return np.array(out)

    def visits_for(self, sample: np.ndarray, cosine: float, recall: float, far_recall: float, seed: int = 9) -> int:
        """How many cells a cell must visit until target recall.

        ``recall`` is of the links among the sampled vectors, found by brute force; ``far_recall`` of
        links simulated at the threshold, the farthest a link can be: each vector and a random one at
        exactly that cosine.
        """
        rng = np.random.default_rng(seed)
        own = self.cells(sample)
        aside = rng.standard_normal(sample.shape)
        aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        far = own, self.cells(cosine * sample + np.sqrt(1 - cosine**2) * aside)

        def visits(a: np.ndarray, b: np.ndarray, share: float) -> int:
            best = np.sort(np.minimum(self.ranks(a, b), self.ranks(b, a)))
            return int(best[min(len(best) - 1, int(np.ceil(share * len(best))))]) + 1

        i, j = np.nonzero(np.triu(sample @ sample.T >= cosine, 1))
        some = rng.permutation(len(i))[:4096]
        return max(visits(*far, far_recall), visits(own[i[some]], own[j[some]], recall) if len(i) else 1)


def _visits(grid, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cell, visited cell) for every cell that holds vectors, nearest first."""
        for batch in batches:
            for cell in batch.column("cell").to_pylist():
                near = grid.value.order(cell, count)
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(near), pa.int64()), pa.array(near, pa.int64())], ["c", "d"])

    return run


def _assign(grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                cells = grid.value.cells(unit_rows(flat.reshape(batch.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("number", "rep", "copies", "vector")], pa.array(cells, pa.int64())], ["number", "rep", "copies", "vector", "cell"])

    return run


def _links(cosine: float):
    def run(part: pa.Table) -> pa.Table:
        """The links between a block (side 0) and the other blocks of a task, and within it in the task that is told to (self)."""
        side, number, rep, copies = (part.column(c).to_numpy() for c in ("side", "number", "rep", "copies"))
        x = unit_rows(part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1))
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inside = bool(part.column("self").to_numpy(zero_copy_only=False)[l].any()) if len(l) else False
        count = np.zeros(len(rep), np.int64)
        up = list(range(len(rep)))

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def meet(own, other, hit):
            for k in np.flatnonzero(hit.any(axis=1)):
                for j in set(map(find, other[hit[k]].tolist())):
                    a, b = find(int(own[k])), find(j)
                    if a != b:
                        a, b = (a, b) if rep[a] < rep[b] else (b, a)
                        up[b] = a

        for at in range(0, len(l), 512):
            own = l[at : at + 512]
            if inside:
                hit = x[own] @ x[l].T >= cosine
                hit[np.arange(len(own)), np.arange(at, at + len(own))] = False
                count[own] += hit @ copies[l]
                meet(own, l, hit)
            for to in range(0, len(r), 4096):
                other = r[to : to + 4096]
                hit = x[own] @ x[other].T >= cosine
                count[own] += hit @ copies[other]
                count[other] += hit.T @ copies[own]
                meet(own, other, hit)
        found = np.flatnonzero(count)
        root = np.array([rep[find(int(k))] for k in found], np.int64)
        return pa.table({"number": pa.array(number[found], pa.int64()), "rep": pa.array(rep[found], pa.int64()), "links": pa.array(count[found], pa.int64()), "root": pa.array(root, pa.int64())})

    return run


def _index_links(entry: DataFrame, *, cosine: float, recall: float, far_recall: float, sample_rows: int, cell_rows: int, block_rows: int, task_blocks: int) -> DataFrame:
    """(number, rep, links, root) from every task that found links among entries (number, h1, h2, rep, copies, vector) of one length."""
    spark = entry.sparkSession
    n = entry.count()
    sample = unit_rows(np.array([r.vector for r in entry.orderBy("h1", "h2").limit(sample_rows).select("vector").collect()]))
    grid = Grid(sample, int(np.clip(np.ceil(np.sqrt(n / cell_rows)), 1, len(sample))))
    visits = grid.visits_for(sample[:4096], cosine, recall, far_recall)
    held = spark.sparkContext.broadcast(grid)
    vector = entry.schema["vector"].dataType.simpleString()
    indexed = stage(entry.select("number", "rep", "copies", "vector").mapInArrow(_assign(held), f"number long, rep long, copies long, vector {vector}, cell long"))
    cells = stage(indexed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks")))
    near = cells.select("cell").mapInArrow(_visits(held, visits), "c long, d long")
    near = near.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()  # one of the two visits the other
    met = near.join(cells.select(F.col("cell").alias("c"), F.col("blocks").alias("cb")), "c").join(cells.select(F.col("cell").alias("d"), F.col("blocks").alias("db")), "d")
    pairs = met.withColumn("x", F.explode(F.expr("sequence(0, cb - 1)"))).withColumn("y", F.explode(F.expr("sequence(if(c = d, x, 0), db - 1)")))
    # A task: block x of cell c against some of the blocks that it meets, so a block is sent on about once for every two visits.
    turn = Window.partitionBy("c", "x").orderBy("d", "y")
    pairs = stage(pairs.withColumn("part", F.floor((F.row_number().over(turn) - 1) / task_blocks)).select("c", "x", "d", "y", "part"))
    own = pairs.groupBy("c", "x", "part").agg(F.bool_or((F.col("c") == F.col("d")) & (F.col("x") == F.col("y"))).alias("self"))
    own = own.select("c", "x", "part", F.col("c").alias("cell"), F.col("x").alias("block"), F.lit(0).alias("side"), "self")
    other = pairs.where("c <> d or x <> y").select("c", "x", "part", F.col("d").alias("cell"), F.col("y").alias("block"), F.lit(1).alias("side"), F.lit(False).alias("self"))
    block = indexed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")))
    work = block.join(own.unionByName(other), ["cell", "block"]).select("c", "x", "part", "side", "self", "number", "rep", "copies", "vector")
    return work.groupBy("c", "x", "part").applyInArrow(_links(cosine), "number long, rep long, links long, root long")


def embedding_groups(
    vectors: DataFrame, *, cosine: float = 0.9, recall: float = 0.99, far_recall: float = 0.95, sample_rows: int = 8192, cell_rows: int = 512, block_rows: int = 1024, task_blocks: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Codebooks of both vector halves are fitted on at most ``sample_rows`` distinct vectors
    (chosen by hash) and form a product grid of about one cell for ``cell_rows`` vectors. Every
    vector is indexed. Cells are visited nearest first, by the multi-sequence algorithm, as many as
    reach ``recall`` on the sample's own links and ``far_recall`` on links simulated at the threshold; then all vectors of cells that meet are compared
    by cosine in double precision, so nothing below ``cosine`` is linked.

    Equal vectors are one index entry that counts its copies. Cells over ``block_rows`` vectors are cut
    into blocks by hash; a task compares one block with ``task_blocks`` others at most and sends link counts and local
    forests, not links. Cells and who meets whom are tables of Spark; the sample alone reaches the driver.

    Vectors that are null, zero or hold null or non-finite components link with nothing, not even each other;
    vectors of different lengths have no cosine, so each length has an index of its own; a null id takes part in no link; repeated rows, and
    different vectors of one id, each count and are each returned; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    base = stage(raw.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), F.col("vector"))))
    entry = base.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    # Two vectors of one id are two entries with one smallest id, so links are counted by the entry's number.
    entry = stage(entry.withColumn("width", F.size("vector")).withColumn("number", F.monotonically_increasing_id()))
    nothing = vectors.sparkSession.createDataFrame([], "number long, rep long, links long, root long")
    options = {"cosine": cosine, "recall": recall, "far_recall": far_recall, "sample_rows": sample_rows, "cell_rows": cell_rows, "block_rows": block_rows, "task_blocks": task_blocks}
    widths = [r.width for r in entry.groupBy("width").count().where("count > 1").orderBy("width").collect()]  # lengths of vectors, one in most tables
    found = stage(reduce(DataFrame.unionByName, [_index_links(entry.where(F.col("width") == w), **options) for w in widths], nothing))

    linked = found.groupBy("number").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("rep", "root"))
    named = entry.select("number", "h1", "h2", "rep", "copies").join(linked, "number", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = stage(named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("component")))
    out = base.where("good").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    rest = base.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.unionByName(rest)
