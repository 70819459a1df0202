"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage
from .tokens import shared_encoder, slices_by_size


def cut_pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids with ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for whole in batches:
            for batch in slices_by_size(whole, text_col):
                rows: list[tuple] = []
                ids = batch.column(id_col).to_pylist()
                for doc_id, own in zip(ids, encoder.encode(batch.column(text_col)), strict=True):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return kept.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_STATE = "kind int, size long, start long, n long, seq long, slots long, offset long"

# One round. Windows over all rows sort classes, whose number the capacity bounds, not pieces.
_ROUND = """
WITH sized AS (
  SELECT kind, size, start, n, max(IF(kind = 1, size, NULL)) OVER () AS longest, coalesce(max(IF(kind = 0, size, NULL)) OVER (), 0) AS widest FROM {state} WHERE kind <> 2
), counted AS (
  SELECT *, greatest(CAST(ceil(sum(IF(kind = 1 AND size > widest, size * n, 0)) OVER () / :capacity) AS BIGINT), sum(IF(kind = 1 AND size > widest AND size * 2 > :capacity, n, 0)) OVER ()) AS fresh FROM sized
), opened AS (
  SELECT longest, inline(IF(kind = 3, array(struct(0 AS kind, CAST(:capacity AS BIGINT) AS size, start, fresh AS n), struct(3 AS kind, 0L AS size, start + fresh AS start, 1L AS n)), array(struct(kind, size, start, n)))) FROM counted
), taking_part AS (
  SELECT kind, size, start, n, coalesce(kind < 2 AND n > 0 AND size > longest div 2, FALSE) AS active FROM opened
), edges AS (
  SELECT *, kind = 0 AND coalesce(lag(kind) OVER (ORDER BY size DESC, kind, start), 1) = 1 AS begins FROM taking_part
), grouped AS (
  SELECT *, IF(active, sum(CAST(begins AS INT)) OVER (ORDER BY size DESC, kind, start ROWS UNBOUNDED PRECEDING), -1) AS grp FROM edges
), weighed AS (
  SELECT *, max(IF(kind = 1, size, NULL)) OVER (PARTITION BY grp) AS top,
    coalesce(sum(IF(kind = 1, n, 0)) OVER (PARTITION BY grp) > :many * sum(IF(kind = 0, n, 0)) OVER (PARTITION BY grp), FALSE) AS many FROM grouped
), slotted AS (
  SELECT *, IF(many AND kind = 0 AND active, size div top, 1L) AS slots FROM weighed
), wanting AS (
  SELECT *, IF(active AND NOT (kind = 1 AND many AND size < top), n * slots, 0L) AS wants FROM slotted
), ranked AS (
  SELECT *, sum(wants) OVER (PARTITION BY grp, kind ORDER BY IF(kind = 0, size, -size), start ROWS UNBOUNDED PRECEDING) - wants AS at,
    sum(IF(kind = 0, wants, 0)) OVER (PARTITION BY grp) AS offered, sum(IF(kind = 1, wants, 0)) OVER (PARTITION BY grp) AS wanted FROM wanting
), merged AS (
  SELECT *, last(IF(kind = 0 AND wants > 0, struct(size, start, at, slots, at + wants AS until), NULL), TRUE) OVER meet AS g,
    last(IF(kind = 1 AND wants > 0, struct(size, start, at, at + wants AS until), NULL), TRUE) OVER meet AS p,
    coalesce(lead(at) OVER (PARTITION BY grp ORDER BY at, kind, size, start), 1L << 62) AS next,
    greatest(0L, least(wants, IF(kind = 0, wanted, offered) - at)) AS used
  FROM ranked WINDOW meet AS (PARTITION BY grp ORDER BY at, kind, size, start ROWS UNBOUNDED PRECEDING)
), matched AS (
  SELECT *, IF(g IS NULL OR p IS NULL, 0L, greatest(0L, least(g.until, p.until, next) - at)) AS cnt FROM merged
), parted AS (
  SELECT *, cnt div g.slots AS full, cnt % g.slots AS odd, g.start + (at - g.at) div g.slots AS seq, IF(kind = 0, -((-used) div slots) + IF((-used) % slots <> 0, 1, 0), used) AS gone, CAST(NULL AS BIGINT) AS no FROM matched
), results AS (
  SELECT inline(array(
    struct(2 AS kind, p.size AS size, p.start + at - p.at AS start, cnt AS n, seq, g.slots AS slots, :capacity - g.size AS offset),
    struct(0 AS kind, g.size - g.slots * p.size AS size, seq AS start, full AS n, no AS seq, no AS slots, no AS offset),
    struct(0 AS kind, g.size - odd * p.size AS size, seq + full AS start, IF(odd > 0, 1L, 0L) AS n, no AS seq, no AS slots, no AS offset),
    struct(kind, size, start + gone AS start, n - gone AS n, no AS seq, no AS slots, no AS offset))) FROM parted
)
SELECT CAST(kind AS INT) AS kind, size, start, n, seq, slots, offset FROM results WHERE n > 0 AND (size > 0 OR kind = 3)
"""


def sweep_round(state: DataFrame, *, capacity: int, many: int = 4) -> DataFrame:
    """One bulk-synchronous best-fit round over classes: rows of the next state, and what was placed.

    ``state`` has rows (kind, size, start, n): gaps (kind 0: n open sequences from number ``start`` on, each
    with ``size`` free tokens), pieces (kind 1: the n pieces of length ``size`` from rank ``start`` on), and
    in kind 3 the number of the next sequence. Pieces longer than every gap get new sequences, as many as their tokens, or those over half
    a sequence, need at least. Then pieces of more than half the longest one left, and gaps of that size, are range-sorted together, largest first. Sweeping along, the
    gaps right before some pieces are their successors: they fit, and nothing nearer does. Pieces that
    want the same gaps are matched by rank, longest piece to smallest gap. If such pieces are over ``many`` times the sequences,
    their longest length alone fills each sequence as often as it fits. Placed pieces leave as rows of kind 2 (``slots``
    to a sequence, sequences from ``seq`` on, at ``offset``); the gaps left by them, and what found no partner, go into the
    next round.
    """
    return state.sparkSession.sql(_ROUND, args={"capacity": capacity, "many": many}, state=state)


def match_classes(lengths: DataFrame, *, capacity: int, check_every: int = 3) -> tuple[list[str], DataFrame]:
    """Match all pieces of ``lengths`` (length, n) to sequences: (the rounds' folders, rows (length, rank, n, seq, slots, offset)).

    Rounds are repeated until no piece is left; one more changes nothing, so only every few rounds the driver looks. Rounds are
    staged, so a lost executor repeats one of them at most; some thirty to sixty are usual, whatever the number of pieces.
    """
    spark = lengths.sparkSession
    null = [F.lit(None).cast("long").alias(c) for c in ("seq", "slots", "offset")]
    state = lengths.select(F.lit(1).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("start"), "n", *null)
    state = state.unionByName(spark.createDataFrame([(3, 0, 0, 1, None, None, None)], _STATE))
    rounds: list[str] = []
    while state.where("kind = 1").limit(1).count():
        for _ in range(check_every):
            rounds.append(shared_dir(spark))
            sweep_round(state, capacity=capacity).write.parquet(rounds[-1])
            state = spark.read.schema(_STATE).parquet(rounds[-1])
    done = spark.read.schema(_STATE).parquet(*rounds).where("kind = 2") if rounds else spark.createDataFrame([], _STATE)
    return rounds, done.select(F.col("size").alias("length"), F.col("start").alias("rank"), "n", "seq", "slots", "offset")


def pack(pieces: DataFrame, *, capacity: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ...); columns of these names are replaced.

    Lengths must be from 1 to ``capacity``. Pieces are range-sorted by length, and each has a rank among those of its length;
    what a round does to them depends on their length and rank only. The pieces of every length are counted (at most ``capacity`` rows), the rounds
    match those classes with classes of gaps (``match_classes``), and each piece finds its place
    by its rank, in a table that ``capacity`` bounds. A length that a third
    of all pieces share is spread over tasks, since the range is on the document as well. Null
    ids and repeated rows are packed like others; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(shards, "length", "doc_id", "piece", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
    # Within the sorted partition the generated id counts rows from 0 in its lower 33 bits.
    number = F.monotonically_increasing_id()
    ordered = stage(ordered.withColumn("_shard", F.shiftright(number, 33).cast("int")).withColumn("_row", number.bitwiseAND(F.lit((1 << 33) - 1))))
    classes = stage(ordered.groupBy("_shard", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first")))  # shards hold ranges: at most shards + capacity rows
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = classes.select("_shard", "length", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"))
    _, done = match_classes(stage(classes.groupBy("length").agg(F.sum("n").alias("n"))), capacity=capacity)
    plan = np.array(sorted(tuple(r) for r in done.collect()), np.int64).reshape(-1, 6)  # rows of classes, not of pieces
    held = spark.sparkContext.broadcast(plan)
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            _, first, _, seq, slots, offset = rows[k].T
            seq, slot = seq + (rank - first) // slots, (rank - first) % slots
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(offset + slot * length)], [*names, "sequence_id", "offset"])

    ranked = ordered.join(F.broadcast(base), ["_shard", "length"]).select(*names, (F.col("_row") + F.col("_shift")).alias("_rank"))
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of ``capacity`` tokens: one row per piece.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Only documents longer than a
    sequence are cut, a very long text into many pieces. A null text is the end id alone; other columns, whatever their names, are
    ignored. Texts are tokenized once and never shuffled.
    """
    return pack(stage(cut_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)), capacity=capacity)
