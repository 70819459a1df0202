"""Phrase collocation mining over count streams in prefix and suffix order."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stage
from .tokens import slices

# A-Z are lowered, tabs are spaces, and every byte that ends a piece becomes 0xFF, which UTF-8 never holds.
_END = b"\xff"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_ID_BITS = 31
_ID_MASK = (1 << _ID_BITS) - 1


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, with ``_END`` where a piece ends."""
    return (text or b"").translate(_FOLD).replace(_END, b" \xff ").split()


class _Block:
    """Words of one language, numbered in the order in which the block meets them; number 0 ends a piece."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[_END] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes | None) -> None:
        own = tokens(text)
        own.append(_END)
        self.parts.append(np.fromiter(map(self.number.__getitem__, own), np.int32, len(own)))
        self.size += len(own)

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        """The distinct words in the order of their hashes, their counts, and the sequence of their numbers (from 1) in that order."""
        seq = np.concatenate(self.parts)
        names = list(self.number)[1:]
        counts = np.bincount(seq, minlength=len(names) + 1)
        order = np.argsort(_hashes(names), kind="stable")
        place = np.zeros(len(names) + 1, np.int32)
        place[order + 1] = np.arange(1, len(names) + 1)
        words = _END.join([names[k] for k in order.tolist()])
        arrays = [pa.array([v], t) for v, t in ((block, pa.int64()), (lang, pa.string()), (int(counts[1:].sum()), pa.int64()), (words, pa.binary()), (_planes(counts[order + 1]), pa.binary()), (_planes(place[seq]), pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, ["block", "lang", "n", "words", "counts", "seq"])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as their lowest bytes, then their second ones, and so on: the higher ones are mostly 0 and compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def word_blocks(docs: DataFrame, *, block_words: int, text_col: str, lang_col: str) -> DataFrame:
    """The texts as blocks of about ``block_words`` words of one language, a row each (``_Block.row``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        open_: dict[str, _Block] = {}
        for whole in batches:
            for batch in slices(whole):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    block = open_.setdefault(lang, _Block())
                    block.add(text)
                    if block.size >= block_words:
                        yield open_.pop(lang).row(part << 32 | made, lang)
                        made += 1
                if sum(b.size for b in open_.values()) >= 2 * block_words:
                    lang = max(open_, key=lambda x: open_[x].size)
                    yield open_.pop(lang).row(part << 32 | made, lang)
                    made += 1
        for lang, block in open_.items():
            yield block.row(part << 32 | made, lang)
            made += 1

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "block long, lang string, n long, words binary, counts binary, seq binary")


# What a block asks: the n keys from its place ``at`` on, packed with their counts; all keys of a bucket meet in one group.
_ASKED = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("keys", pa.binary())])
# What a bucket answers: to each block the ids of its keys (0: rare), and a row for each frequent key.
_ANSWER = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("at", pa.int32()), ("ids", pa.binary()), ("id", pa.int32()), ("word", pa.binary()), ("first", pa.int32()), ("second", pa.int32()), ("f", pa.int64())])


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _asked(lang: str, block: int, bucket: np.ndarray, keys) -> pa.Table:
    """The questions of a block whose keys lie in the order of their buckets; ``keys(a, b)``: the packed keys from place a to b."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    return pa.table([[lang] * len(starts), bucket[starts], [block] * len(starts), starts, ends - starts, [keys(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]], schema=_ASKED)


def _ask_words(buckets: int):
    """A block's words and counts, dealt by hash."""

    def run(table: pa.Table) -> pa.Table:
        if not table.column("n")[0].as_py():
            return _ASKED.empty_table()
        words, counts = table.column("words")[0].as_py().split(_END), _numbers(table.column("counts")[0].as_py())
        bucket = _hashes(words) * buckets >> 32
        return _asked(table.column("lang")[0].as_py(), table.column("block")[0].as_py(), bucket, lambda a, b: _pack(_planes(counts[a:b]) + _END.join(words[a:b])))

    return run


class _Pairs:
    """The pairs of neighbours in a sequence of ids (0: none), each once, by bucket, first and second; ``at`` and ``which``: where pairs begin, and which ones."""

    def __init__(self, seq: np.ndarray, buckets: int):
        self.at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
        keys = seq[self.at] << _ID_BITS | seq[self.at + 1]
        order, starts = _runs(keys)
        keys = keys[order[starts]]
        first, second = keys >> _ID_BITS, keys & _ID_MASK
        by_bucket = np.argsort((first + second) % buckets, kind="stable")
        self.first, self.second, self.counts = first[by_bucket], second[by_bucket], np.diff(starts, append=len(order))[by_bucket]
        self.bucket = (self.first + self.second) % buckets
        place = np.empty(len(keys), np.int64)
        place[by_bucket] = np.arange(len(keys))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.repeat(place, np.diff(starts, append=len(order)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where each key's run starts in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.diff(keys[order], prepend=-1))


def _pack_pairs(first: np.ndarray, second: np.ndarray, counts: np.ndarray, buckets: int) -> bytes:
    """Sorted pairs of one bucket as differences; what the bucket says of the second id is left out."""
    step, part = np.diff(first, prepend=0), second // buckets
    return _pack(_planes(step) + _planes(part - np.where(step == 0, np.roll(part, 1), 0)) + _planes(counts))


def _unpack_pairs(packed: bytes, n: int, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = _unpack(packed)
    step, more, counts = (_numbers(data[4 * n * k : 4 * n * (k + 1)]) for k in range(3))
    first, part = np.cumsum(step), np.cumsum(more)
    new = step != 0
    part -= (part - more)[new][np.cumsum(new) - 1]
    return first, part * buckets + (bucket - first) % buckets, counts


def _ask_pairs(size: int, buckets: int):
    """A block's phrases of ``size`` words, as pairs of frequent ones a word shorter, from its words and the answers on all shorter phrases."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows or not told.num_rows:
            return _ASKED.empty_table()
        seq = _numbers(block.column("seq")[0].as_py())
        answers = defaultdict(list)
        for m, at, ids in zip(told.column("m").to_pylist(), told.column("at").to_pylist(), told.column("ids").to_pylist(), strict=True):
            answers[m].append((at, _numbers(_unpack(ids))))

        def known(m: int, n: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            for at, ids in answers[m]:
                out[at : at + len(ids)] = ids
            return out

        seq = np.append(0, known(1, int(seq.max())))[seq]
        pairs = _Pairs(seq, buckets)
        for m in range(2, size):
            seq = np.zeros(len(seq), np.int64)
            seq[pairs.at] = known(m, len(pairs.first))[pairs.which]
            pairs = _Pairs(seq, buckets)
        if not len(pairs.first):
            return _ASKED.empty_table()
        return _asked(block.column("lang")[0].as_py(), block.column("owner")[0].as_py(), pairs.bucket, lambda a, b: _pack_pairs(pairs.first[a:b], pairs.second[a:b], pairs.counts[a:b], buckets))

    return run


def _answer(size: int, buckets: int, least: int):
    """The counts of a bucket's keys, the ids of the frequent ones (most frequent first), and each block's answer."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        lang, bucket = (k.as_py() for k in key)
        sizes, packed = asked.column("n").to_pylist(), asked.column("keys").to_pylist()
        if size == 1:
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            keys, counts = [], []
            for n, one in zip(sizes, packed, strict=True):
                data = _unpack(one)
                counts.append(_numbers(data[: 4 * n]))
                keys.append(np.fromiter(map(number.__getitem__, data[4 * n :].split(_END)), np.int64, n))
        else:
            found = [_unpack_pairs(one, n, bucket, buckets) for n, one in zip(sizes, packed, strict=True)]
            keys, counts = [first << _ID_BITS | second for first, second, _ in found], [c for _, _, c in found]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order, starts = _runs(keys)
        f = np.add.reduceat(counts[order], starts)
        often = np.flatnonzero(f >= least)
        often = often[np.argsort(-f[often], kind="stable")]
        own = np.arange(len(often)) * buckets + bucket + 1
        if len(own) and own[-1] > _ID_MASK:
            raise OverflowError("too many frequent phrases for the ids")
        ids = np.zeros(len(f), np.int64)
        ids[often] = own
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(ids, np.diff(starts, append=len(order)))
        ends = np.cumsum(sizes)
        rows = np.array([k for k, (n, end) in enumerate(zip(sizes, ends.tolist(), strict=True)) if each[end - n : end].any()], np.int64)
        no, none = len(rows), [None] * len(rows)
        told = pa.table([[lang] * no, asked.column("block").take(rows), asked.column("at").take(rows), [_pack(_planes(each[ends[k] - sizes[k] : ends[k]])) for k in rows], none, none, none, none, none], schema=_ANSWER)
        kept, none = keys[order[starts[often]]], [None] * len(often)
        if size == 1:
            names = list(number)
            what = [[names[k] for k in kept.tolist()], none, none]
        else:
            what = [none, kept >> _ID_BITS, kept & _ID_MASK]
        return pa.concat_tables([told, pa.table([[lang] * len(often), none, none, none, own, *what, f[often]], schema=_ANSWER)])

    return run


def phrase_counts(docs: DataFrame, *, least: int = 100, longest: int = 5, block_words: int = 2_000_000, bucket_words: int = 4_000_000, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(counts, totals): the phrases of 1 to ``longest`` words that occur at least ``least`` times, (lang, phrase, f); and (lang, n), all words of a language.

    Texts are read once, into blocks that keep each distinct word once and the sequence as numbers. Then there is a round for each length. Every block asks for
    its distinct phrases, sorted, as differences and with their counts; all that is asked for one phrase meets in a bucket, which counts it and answers every block
    with the ids of the frequent ones. A phrase is asked for only if both phrases a word shorter are frequent, as the pair of their ids. Rare words and
    ends of pieces have no id. Buckets grow in number with the words, ``bucket_words`` to one at most; no table of words or phrases is broadcast.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    table = path.rpartition("/")[2].replace("-", "_")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = word_blocks(docs, block_words=block_words, text_col=text_col, lang_col=lang_col)
    rounds = []
    try:
        # Bucketed, so that the sequences stay where they are when the answers come to them.
        made.write.format("parquet").bucketBy(tasks, "block").option("compression", "zstd").option("path", path).saveAsTable(table)
        blocks = spark.table(table)
        totals = stage(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
        # Some buckets a task, so that tasks are alike.
        buckets = max(4 * tasks, -(-(totals.agg(F.sum("n")).first()[0] or 0) // bucket_words))
        sequences = blocks.select(F.col("block").alias("owner"), "lang", "seq")
        told = None
        for m in range(1, longest + 1):
            if m == 1:
                asked = blocks.select("block", "lang", "n", "words", "counts").groupBy("block").applyInArrow(_ask_words(buckets), _spark_schema(_ASKED))
            else:
                asked = sequences.groupBy("owner").cogroup(told.groupBy("block")).applyInArrow(_ask_pairs(m, buckets), _spark_schema(_ASKED))
            answer = stage(asked.groupBy("lang", "bucket").applyInArrow(_answer(m, buckets, least), _spark_schema(_ANSWER)))
            rounds.append(answer.where("id is not null"))
            own = answer.where("block is not null").select(F.lit(m).alias("m"), "block", "at", "ids")
            told = own if told is None else told.unionByName(own)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    spelt = rounds[0].select("lang", "id", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f")
    counts = spelt.select("lang", "phrase", "f")
    for found in rounds[1:]:
        left = spelt.select("lang", F.col("id").alias("first"), "phrase")
        right = spelt.select("lang", F.col("id").alias("second"), "last")
        spelt = found.select("lang", "id", "first", "second", "f").join(left, ["lang", "first"]).join(right, ["lang", "second"])
        spelt = stage(spelt.select("lang", "id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"))
        counts = counts.unionByName(spelt.select("lang", "phrase", "f"))
    return counts, totals


def first_words(phrase: Column | str, k: Column | int) -> Column:
    return F.substring_index(phrase, " ", k) if isinstance(k, int) else F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def words_in(phrase: Column | str) -> Column:
    """Words hold no space, so a phrase has one word more than spaces."""
    return F.octet_length(phrase) - F.octet_length(F.replace(F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(" "), F.lit(""))) + 1


def backwards(phrase: str) -> Column:
    """The phrase from its last word to its first."""
    return F.array_join(F.reverse(F.split(phrase, " ", -1)), " ")


def count_streams(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same counts in prefix order (key: the phrase) and in suffix order (key: its words from last to first): (lang, key, size, f) sorted by lang and key."""
    keyed = [counts.select("lang", key.alias("key"), words_in("phrase").alias("size"), "f") for key in (F.col("phrase"), backwards("phrase"))]
    prefix, suffix = (stage(s.repartition("lang", "key").sortWithinPartitions("lang", "key")) for s in keyed)
    return prefix, suffix


def _part_counts(stream: DataFrame, name: str) -> DataFrame:
    """(lang, key, size, k, count): for each key of two words or more, the count of its first k words, by merging the stream with itself."""
    cuts = stream.where("size > 1").select("lang", "key", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = stream.select(F.col("lang").alias("_lang"), F.col("key").alias("part"), F.col("f").alias(name))
    joined = cuts.join(parts.hint("merge"), (F.col("lang") == F.col("_lang")) & (first_words("key", F.col("k")) == F.col("part")))
    return joined.select("lang", "key", "size", "k", name)


def _extended(stream: DataFrame, name: str) -> DataFrame:
    """(lang, key, count): for each key, the greatest count of a key that goes one word further."""
    shorter = first_words("key", F.col("size") - 1)
    return stream.where("size > 2").groupBy("lang", shorter.alias("key")).agg(F.max("f").alias(name))


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, scale: int = 1000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The phrases of each language whose words stick together most: (lang, rank, phrase, a, l, r, n, score).

    Texts (A-Z lowered) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. a is how often a phrase of 2 to ``longest`` words occurs
    in pieces, overlaps included; candidates have a >= ``least``. n counts the language's words. A cut after the first k words gives l and r, the counts of
    both parts, and score floor(scale * a * n / (l * r)) in exact arithmetic; the lowest score counts, of equal ones that of smallest k. A candidate goes if its words
    lie contiguously in a longer one with 100 * f(longer) >= ``covered`` * a. As counts never grow with the phrase, it is enough to look one word further to the right and to the left.
    Returned are the first ``top`` by score and a, descending, then phrase.

    Count streams lie in prefix and in suffix order. Merging the prefix stream with itself gives the counts of left parts and of right extensions, merging the suffix stream
    with itself those of right parts and left extensions; the halves meet again by phrase. All joins of streams are sort-merge joins.

    A null text is empty, a null language is ``und``; repeated rows count each; an empty table or one without frequent phrases gives no rows; ties of
    score and a go by the phrase's bytes, so ranks are unique; other columns, whatever their names, are ignored; very long texts are pieces of rows like any other.
    """
    counts, totals = phrase_counts(docs, least=least, longest=longest, text_col=text_col, lang_col=lang_col)
    prefix, suffix = count_streams(counts)
    left = _part_counts(prefix, "l").select("lang", F.col("key").alias("phrase"), "k", "l")
    right = _part_counts(suffix, "r").select("lang", backwards("key").alias("phrase"), (F.col("size") - F.col("k")).alias("k"), "r")
    after = _extended(prefix, "after").withColumnRenamed("key", "phrase")
    before = _extended(suffix, "before").select("lang", backwards("key").alias("phrase"), "before")
    candidates = counts.where(F.instr("phrase", " ") > 0).withColumnRenamed("f", "a")
    for side in (after, before):
        candidates = candidates.join(side.hint("merge"), ["lang", "phrase"], "left")
    most = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0)))
    candidates = candidates.where(100 * most < covered * F.col("a")).select("lang", "phrase", "a")
    cuts = candidates.join(left.hint("merge"), ["lang", "phrase"]).join(right.hint("merge"), ["lang", "phrase", "k"]).join(totals, "lang")
    # Decimals of 38 digits hold the products: counts have up to 15, the scale up to 6.
    exact = {c: f"CAST({c} AS DECIMAL(15,0))" for c in "anlr"}
    scored = cuts.withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(6,0)) * {exact['a']} * {exact['n']} div ({exact['l']} * {exact['r']})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    named = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.select("*", rank.cast("long").alias("rank")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
