"""Token files coded with a static range asymmetric numeral system (rANS).

One frequency table for the whole corpus; blocks that decode on their own, each with
interleaved coder lanes, checkpoints to start decoding inside a block, and a checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage
from .tokens import load, shared_encoder, slices_by_size

LOW = np.uint64(1 << 31)  # a lane's state stays in [2^31, 2^63)
SCALE = 20  # frequencies add up to 2^SCALE
LANES, EVERY = 4096, 128  # interleaved lanes of a block; steps from one checkpoint to the next
_BLOCK = "shard_first long, block long, doc_ids array<long>, lengths array<long>, n_ids long, lanes int, every int, marks array<struct<word:long,state:binary,crc:long>>, stream binary"
_MARK = pa.struct([("word", pa.int64()), ("state", pa.binary()), ("crc", pa.int64())])
_BLOCK_ARROW = pa.schema([
    ("shard_first", pa.int64()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()),
    ("lanes", pa.int32()), ("every", pa.int32()), ("marks", pa.list_(_MARK)), ("stream", pa.binary()),
])


def scale_frequencies(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Counts scaled to add up to 2^bits, at least 1 for each id that occurs."""
    total, goal = int(counts.sum()), 1 << bits
    if total == 0:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > goal:
        raise ValueError("more different ids than the frequency scale holds")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * goal // total), 0).astype(np.int64)
    spare = goal - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    for k in order:  # the largest frequencies bear the rounding
        step = spare if spare > 0 else max(spare, 1 - int(freq[k]))
        freq[k] += step
        spare -= step
        if spare == 0:
            break
    return freq.astype(np.uint64)


def lookup_tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each id's range, id of each slot)."""
    start = np.concatenate([[0], np.cumsum(freq.astype(np.int64))[:-1]]).astype(np.uint64)
    return start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


@dataclass
class Mark:
    """A checkpoint: the next word of the stream, the state of every lane, and the crc32 of the ids up to the next checkpoint."""

    word: int
    state: bytes
    crc: int


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, every: int = EVERY) -> tuple[list[Mark], bytes]:
    """(checkpoints, stream of 32-bit words) of a block. Ids are dealt to the lanes in turn; step t codes ids t*lanes to (t+1)*lanes-1."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    count = 0
    width, first = freq[ids], start[ids]
    limit = width << np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        now = slice(t * lanes, min((t + 1) * lanes, len(ids)))
        f, x = width[now], state[: now.stop - now.start]
        over = x >= limit[now]
        if k := int(np.count_nonzero(over)):
            words.append(x[over].astype(np.uint32)[::-1])  # the lower half
            count += k
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + first[now]
        if t % every == 0:
            marks.append((count, state.astype("<u8").tobytes()))
    stream = np.concatenate(words)[::-1] if words else np.empty(0, np.uint32)
    span = lanes * every
    crcs = [zlib.crc32(ids[k * span : (k + 1) * span].astype("<u4").tobytes()) for k in range(len(marks))]
    return [Mark(count - used, own, crc) for (used, own), crc in zip(reversed(marks), crcs, strict=True)], stream.astype("<u4").tobytes()


def decode_from(mark: Mark, stream: bytes, n: int, end: int, freq: np.ndarray, start: np.ndarray, slot: np.ndarray, lanes: int = LANES, every: int = EVERY) -> np.ndarray:
    """The first ``n`` ids from a checkpoint on. ``stream`` begins at the checkpoint's word; ``end`` ids are left in the block.

    The ids up to the next checkpoint are held against the checkpoint's checksum, if all of them are asked for.
    """
    words = np.frombuffer(stream, "<u4").astype(np.uint64)
    state = np.frombuffer(mark.state, "<u8").astype(np.uint64)
    steps = -(-n // lanes)
    out = np.empty(min(end, steps * lanes), np.uint32)
    at = 0
    for t in range(steps):
        now = slice(t * lanes, min((t + 1) * lanes, end))
        x = state[: now.stop - now.start]
        low = x & np.uint64((1 << SCALE) - 1)
        own = slot[low]
        out[now] = own
        x = freq[own] * (x >> np.uint64(SCALE)) + low - start[own]
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << np.uint64(32)) | words[at : at + len(under)]
            at += len(under)
        state[: len(x)] = x
    whole = min(end, lanes * every)
    if n >= whole and zlib.crc32(out[:whole].astype("<u4").tobytes()) != mark.crc:
        raise ValueError("a block's checksum does not match its ids")
    if n == end and (state != LOW).any():  # every lane ends where the coder began
        raise ValueError("a block does not end where it should")
    return out[:n]


def id_type(tokenizer: str, end_id: int) -> str:
    """Two bytes an id while ids are passed on, if the vocabulary allows it; else four."""
    vocabulary = load(tokenizer).get_vocab()
    return "<u2" if max(end_id, *vocabulary.values()) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, crc, ids, counts): the ids of each whole text with ``end_id``, as little-endian bytes of
    ``id_type``, and their crc32. Each task ends with a row that has counts alone: how often it met each id."""
    kind = id_type(tokenizer, end_id)
    counted = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("counts", counted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        total = np.zeros(end_id + 1, np.int64)
        for whole in batches:
            for batch in slices_by_size(whole, text_col):
                ids, ends = encoder.encode_array(batch.column(text_col))
                own = np.bincount(ids, minlength=len(total))
                own[: len(total)] += total
                total = own
                total[end_id] += batch.num_rows
                data, size = ids.astype(kind), np.dtype(kind).itemsize
                end, raw = np.array([end_id], kind).tobytes(), data.tobytes()
                rows = [raw[a * size : b * size] + end for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                arrays = [batch.column(id_col), pa.array(list(map(zlib.crc32, rows)), pa.int64()), pa.array(rows, pa.binary()), pa.nulls(len(rows), counted)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pylist([{"counts": [{"id": i, "n": n} for i, n in zip(seen.tolist(), total[seen].tolist(), strict=True)]}], schema=schema)

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return kept.mapInArrow(run, "doc_id long, crc long, ids binary, counts array<struct<id:long,n:long>>")


def _pack_blocks(tables, block_ids: int, kind: str, lanes: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, start = tables.value
        docs: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        held = before = number = 0

        def block():
            ids = np.concatenate(parts)
            marks, stream = encode_block(ids, freq, start, lanes, every)
            row = {"shard_first": before, "block": number, "doc_ids": [d for d, _ in docs], "lengths": [n for _, n in docs], "n_ids": held, "lanes": lanes, "every": every, "marks": [vars(m) for m in marks], "stream": stream}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, kind).astype(np.uint32)
                docs.append((doc_id, len(ids)))
                parts.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield block()
                    before, number = before + held, number + 1
                    docs, parts, held = [], [], 0
        if docs:
            yield block()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int, path: str | None = None, block_ids: int = 1 << 20, lanes: int = LANES, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the ids in ascending doc_id order as rANS blocks. Returns the path.

    ``path/freq`` holds the frequency table (bounded by the vocabulary), ``path/blocks`` the
    blocks: (shard, shard_first, block, doc_ids, lengths, n_ids, lanes, every, marks, stream). Shards ascend with doc_id, and blocks
    within a shard; shard_first is the number of ids before the block in its shard; marks are the
    checkpoints, with a checksum each. A block ends with a document, so a very long document is a long block. Parquet is the container, so that any store that
    Spark writes to will do and failed tasks leave no half files.

    Null texts give the end id alone; null doc_ids come first; repeated doc_ids stay, in order of
    their ids' checksums; empty tables give no blocks; other columns, whatever their names, are ignored. Texts are read and tokenized once, and the ids counted on the way; ids are staged,
    then range-sorted (the bounds are found from doc_id and checksum alone), so no step holds more than a partition's block and one document.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    staged = stage(tokenize(docs, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col))
    count = staged.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    count.orderBy("id").coalesce(1).write.parquet(f"{path}/freq")
    freq, start, _ = read_tables(spark, path)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = staged.where("counts is null").select("doc_id", "crc", "ids")
    ordered = tokens.repartitionByRange(shards, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    packed = ordered.select("doc_id", "ids").mapInArrow(_pack_blocks(spark.sparkContext.broadcast((freq, start)), block_ids, id_type(tokenizer, end_id), lanes, every), _BLOCK)
    packed.withColumn("shard", F.spark_partition_id().cast("long")).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_tables(spark, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared frequency table of a file set and its lookup tables."""
    rows = spark.read.parquet(f"{path}/freq").collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = scale_frequencies(counts)
    return freq, *lookup_tables(freq)


def read_token_files(spark, path: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ``ids`` only if asked for.

    Every checkpoint of a block is a unit of work of its own: it is decoded from its states and its
    part of the stream, checked against its checksum, and gives the documents that begin before the next
    checkpoint (it reads on into that one's part to end the last of them). ``start`` is the number
    of ids of all documents before: those of earlier shards (as many as the writer had shuffle partitions, so
    their sums fit one task), of the shard's earlier blocks, and of the block.
    """
    tables = spark.sparkContext.broadcast(read_tables(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shard = shard.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("shard_start"))
    unit = blocks.join(F.broadcast(shard), "shard").withColumn("first", F.col("shard_start") + F.col("shard_first"))
    unit = unit.select("doc_ids", "lengths", "n_ids", "lanes", "every", "first", "stream", F.posexplode("marks").alias("at", "mark"))
    unit = unit.withColumn("stream", F.expr("substring(stream, cast(mark.word * 4 + 1 as int))"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, start, slot = tables.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                size = np.array(row["lengths"], np.int64)
                ends = np.cumsum(size)
                begin, span = ends - size, row["lanes"] * row["every"]
                from_id = row["at"] * span
                own = np.flatnonzero((begin >= from_id) & (begin < from_id + span))
                left = row["n_ids"] - from_id
                n = max(int(ends[own[-1]]) - from_id if len(own) else 0, min(span, left))
                ids = decode_from(Mark(**row["mark"]), row["stream"], n, left, freq, start, slot, row["lanes"], row["every"]).astype("<u4").tobytes()
                parts = [ids[4 * (a - from_id) : 4 * (b - from_id)] for a, b in zip(begin[own].tolist(), ends[own].tolist(), strict=True)]
                docs = row["doc_ids"]
                arrays = [pa.array([docs[i] for i in own], pa.int64()), pa.array(row["first"] + begin[own]), pa.array(size[own]), pa.array(list(map(zlib.crc32, parts)), pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return unit.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
