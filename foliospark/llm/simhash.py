"""SimHash near-duplicates, candidates pruned by the pigeonring principle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_before, named, plain_columns, stage
from .components import connected_components
from .tokens import slices


WIDE = 4  # 64-bit words of the wide fingerprint
SMALL_GROUP = 32  # keys with more members are compared in blocks
BLOCK_ROWS = 1024
BANDS, ROWS = 10, 4  # MinHash bands that deal texts to candidates: 0.8 similar sets share one 99.5 times in 100
_MINIMA = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_WIDE = [f"w{k}" for k in range(WIDE)]


def _hashes(own: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; too few words are one shingle."""
    joined = b" ".join(own)
    if len(own) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    digest, ends = xxhash.xxh64_intdigest, (ends - 1).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)


def _majority(values: np.ndarray, words: int) -> np.ndarray:
    """The bits that over half of the hashes have; beyond 64 bits each hash is stretched by SplitMix64."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(values), 1 << 15):  # bounded memory for very long texts
        part = values[at : at + (1 << 15), None]
        if words > 1:
            z = part + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            part = z ^ (z >> np.uint64(31))
        flat = np.ascontiguousarray(part).view(np.uint8)
        total += np.unpackbits(flat, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(values), bitorder="little").view(np.int64)


def fingerprint(text: bytes | None, shingle: int, verify_shingle: int = 0) -> tuple[int, int, list[int]]:
    """(64-bit SimHash as a signed integer, number of words, wide fingerprint) of a UTF-8 text.

    A-Z are lowered, words split at ASCII white space; a bit is set if over half of the XXH64
    (seed 42) of the ``shingle``-word shingles, repeats included, have it. Fewer words make one
    shingle; none give 0. The wide fingerprint has more bits, over the distinct ``verify_shingle``-word shingles.
    """
    own = (text or b"").lower().split()
    if not own:
        return 0, 0, [0] * WIDE
    wide = _majority(np.unique(_hashes(own, verify_shingle)), WIDE).tolist() if verify_shingle else [0] * WIDE
    return int(_majority(_hashes(own, shingle), 1)[0]), len(own), wide


def shingle_set(text: bytes | None, shingle: int) -> tuple[int, np.ndarray]:
    """(a number for the set, its sorted hashes) of a UTF-8 text's ``shingle``-word shingles, words as in ``fingerprint``."""
    own = (text or b"").lower().split()
    found = np.unique(_hashes(own, shingle)) if own else np.zeros(0, np.uint64)
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63), found


def fingerprints(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n_words) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [fingerprint(t, shingle) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
                numbers = [[f for f, _, _ in found], [n for _, n, _ in found]]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(c, pa.int64()) for c in numbers]], ["doc_id", "fp", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "doc_id long, fp long, n_words long")


def wide_budget(similarity: float, deviations: float = 1) -> int:
    """Differing bits of the wide fingerprint for a Jaccard similarity: what two sets that similar
    are expected to show, and so many standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * WIDE * p + deviations * math.sqrt(64 * WIDE * p * (1 - p)))


def ring(max_bits: int, segments: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """The chains of a ring of ``segments`` segments of 64 bits for a budget of ``max_bits``.

    If two words differ in at most ``max_bits`` bits, some segment i exists from which every run of
    l consecutive segments differs in at most floor(l * max_bits / segments) bits. Returns how many
    of the first segments may not differ at all, and for every i the (mask, budget) of runs 1 to m.
    """
    edge = [round(64 * i / segments) for i in range(segments + 1)]
    part = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(segments)]
    chains = []
    for i in range(segments):
        mask, chain = 0, []
        for length in range(1, segments + 1):
            mask |= part[(i + length - 1) % segments]
            chain.append((mask, length * max_bits // segments))
        chains.append(chain)
    return sum(budget == 0 for _, budget in chains[0]), chains


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(masks: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), at + 1)


def near_pairs(groups: DataFrame, *, max_bits: int, segments: int, size_ratio: float = 0.0) -> DataFrame:
    """(a, b): representatives of groups whose fingerprints differ in at most ``max_bits`` bits.

    ``groups`` has fp, rep, size: one row for each fingerprint (and size, if ``size_ratio`` > 0).
    A group is dealt once for each ring segment, by the exact bits of the leading segments
    that may not differ; partners then pass the budgets of the longer chains, and last the whole
    Hamming distance, all inside the join condition, so only links leave the join; keys of many members
    are compared block by block and send forests, so the links returned connect the same groups. With
    ``size_ratio`` partners must also be of similar size: sizes are bucketed geometrically, and a
    group also visits the next bucket.
    """
    exact, chains = ring(max_bits, segments)
    start = F.explode(F.array(*[F.lit(i) for i in range(segments)]))
    dealt = groups.select("fp", "rep", "size", start.alias("seg"))
    dealt = dealt.withColumn("bits", F.col("fp").bitwiseAND(_mask([c[exact - 1][0] for c in chains], F.col("seg"))))
    left, right = dealt, dealt
    keys = ["seg", "bits"]
    if size_ratio > 0:
        bucket = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(-np.log(size_ratio))).cast("int")
        left, right = dealt.withColumn("bucket", bucket), dealt.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
        keys = [*keys, "bucket"]
    a, b = left.alias("a"), right.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    wanted = F.bit_count(differ) <= max_bits
    previous = 0
    for length in range(exact, segments - 1):
        budget = chains[0][length][1]
        if budget > previous or length == exact:  # the longest chain of a budget implies the shorter ones
            longest = max(k for k in range(segments) if chains[0][k][1] == budget)
            previous = budget
            if longest < segments - 1:
                wanted = (F.bit_count(differ.bitwiseAND(_mask([c[longest][0] for c in chains], F.col("a.seg")))) <= budget) & wanted
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.rep") != F.col("b.rep")]
    if size_ratio > 0:
        on.append(F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * size_ratio)
        # Seen from the smaller one's bucket, or from either if both share it.
        on.append((F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.rep") < F.col("b.rep"))))
    else:
        on.append(F.col("a.rep") < F.col("b.rep"))
    condition = wanted
    for c in reversed(on):
        condition = c & condition
    # Few members under a key: a join. Many, as near copies make them: block by block, a forest each.
    members = right.groupBy(*keys).agg(F.count("*").alias("members"))
    small = members.where(F.col("members") <= SMALL_GROUP).select(*keys)
    large = members.where(F.col("members") > SMALL_GROUP)
    found = left.join(small, keys, "left_semi").alias("a").join(right.alias("b"), condition).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    return found.unionByName(_large_groups(left, right, large, keys, chains, max_bits, size_ratio)).distinct()


def _large_groups(left: DataFrame, right: DataFrame, large: DataFrame, keys: list[str], chains: list[list[tuple[int, int]]], max_bits: int, size_ratio: float) -> DataFrame:
    """Links under keys of many members: both sides are cut into blocks by hash, and every pair of blocks is a task.
    There too the chains of the key's segment prune pairs before the whole Hamming distance."""
    large = large.select(*keys, F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks"))
    columns = ["fp", "rep", "size"]
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    l = left.join(large, keys).select(*keys, *columns, F.lit(0).alias("side"), own.alias("lo"), every.alias("hi"))
    r = right.join(large, keys).select(*keys, *columns, F.lit(1).alias("side"), every.alias("lo"), own.alias("hi"))

    def run(part: pa.Table) -> pa.Table:
        rep, size = part.column("rep").to_numpy(), part.column("size").to_numpy()
        fp = part.column("fp").to_numpy().view(np.uint64)
        side = part.column("side").to_numpy()
        own_chain = chains[part.column("seg")[0].as_py()]
        chain = [c for c, after in zip(own_chain, own_chain[1:] + [(0, -1)], strict=True) if after[1] != c[1]]  # the longest run of a budget implies the shorter ones
        mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        up: dict[int, int] = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        edges = []
        for at in range(0, len(mine), 256):
            i, j = mine[at : at + 256, None], other[None, :]
            differ = fp[i] ^ fp[j]
            near = rep[i] != rep[j]
            for mask, budget in chain:  # ever longer runs; the last one is the whole ring
                near &= np.bitwise_count(differ & np.uint64(mask)) <= budget
            if size_ratio > 0:
                near &= np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * size_ratio
            for x, y in zip(*np.nonzero(near), strict=True):
                a, b = int(rep[mine[at + x]]), int(rep[other[y]])
                p, q = find(a), find(b)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    edges.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return l.unionByName(r).groupBy(*keys, "lo", "hi").applyInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, *, shingle: int = 2, max_bits: int = 8, segments: int = 17, size_ratio: float = 0.75, verify_shingle: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, fp, n_words, component_id).

    Documents are linked if their fingerprints differ in at most ``max_bits`` bits and, with
    ``size_ratio`` > 0, if the shorter has at least that share of the longer one's words. component_id is
    the smallest doc_id that links reach. Equal fingerprints meet in one grouping, so copies never make pairs; a
    common fingerprint is only a large group of narrow rows.

    Null or empty texts have fingerprint 0 and are linked like others; a null doc_id takes part
    but never names a component, which is null if it has no other member; repeated rows are each
    returned; empty tables give no rows; other columns are ignored.
    """
    if verify_shingle:
        raise ValueError("similar_groups compares the shingles themselves")
    base = stage(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    by = ["fp", *(["n_words"] if size_ratio > 0 else [])]
    groups = stage(base.groupBy(*by).agg(F.min("doc_id").alias("rep")))
    sized = groups.where("rep is not null").select("fp", "rep", (F.col("n_words") if size_ratio > 0 else F.lit(0)).alias("size"))
    links = near_pairs(sized, max_bits=max_bits, segments=segments, size_ratio=size_ratio)
    roots = connected_components(links)
    # Staged, so that both sides of the join are plain shuffles: Spark then splits a very common fingerprint's rows.
    named = stage(groups.join(roots, groups.rep == roots.node, "left").select(*by, F.coalesce("root", "rep").alias("component_id")))
    return base.join(named, by).select("doc_id", "fp", "n_words", "component_id")


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys for each set of shingle hashes: hashes of ROWS minima. Sets of similarity s share one with 1 - (1 - s^ROWS)^BANDS."""
    some = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    flat, starts = np.concatenate(some), np.cumsum([0, *(len(s) for s in some[:-1])])
    factors, shifts = _MINIMA
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            low = np.minimum.reduceat((flat * (factors[k] | np.uint64(1)) + shifts[k]) >> np.uint64(20), starts)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + low
        keys[:, band] = key
    return keys.view(np.int64)


def wide_ring(max_bits: int) -> list[int]:
    """Budgets of runs of 1 to WIDE words of the wide fingerprint: some word starts a chain that keeps all of them."""
    return [length * max_bits // WIDE for length in range(1, WIDE + 1)]


def _compare(sure_bits: int, max_bits: int, similarity: float, exact: bool):
    """The pairs of one task, candidates by size, the ring's chains and the whole distance, as rows (a, b, key).

    First (not ``exact``): a forest of the pairs of at most ``sure_bits``, and every text in a pair beyond them, with its key (b null).
    Then, of those texts: a forest of the pairs whose sets are similar, leaving out what ``root`` connects. So a task sends
    rows in proportion to its texts, however many pairs there are.
    """

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        key, unit, size, block = (part.column(c).to_numpy() for c in ("key", "unit", "size", "block"))
        wide = [part.column(w).to_numpy().view(np.uint64) for w in _WIDE]
        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        up: dict[int, int] = dict(zip(unit.tolist(), part.column("root").to_pylist(), strict=True)) if exact else {}
        sets = [s.values.to_numpy() for s in part.column("s")] if exact else []

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up.setdefault(up[x], up[x])]
                x = up[x]
            return x

        def pairs():
            """(rows, rows) to compare: neighbours under a key at every distance, or the two blocks of a common key."""
            if lo < 0:
                at, step = np.arange(len(key)), 1
                while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
                    yield at, at + step
                    step += 1
                return
            mine, other = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            for k in range(0, len(mine), 64):
                i, j = np.repeat(mine[k : k + 64], len(other)), np.tile(other, len(mine[k : k + 64]))
                yield (i, j) if lo < hi else (i[i < j], j[i < j])

        edges: list[tuple[int, int]] = []
        open_ = np.zeros(len(unit), bool)
        for i, j in pairs():
            fits = np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * similarity - 1e-9
            i, j = i[fits], j[fits]
            differ = np.stack([np.bitwise_count(w[i] ^ w[j]) for w in wide], axis=1).astype(np.int64)
            chains = np.zeros(len(i), bool)
            for start in range(WIDE):
                chains |= (np.cumsum(np.roll(differ, -start, axis=1), axis=1) <= wide_ring(max_bits)).all(axis=1)
            sure = differ.sum(axis=1) <= sure_bits
            doubtful = chains & ~sure
            if not exact:
                open_[i[doubtful]] = open_[j[doubtful]] = True
            for m, n in zip(*(x[doubtful if exact else chains & sure].tolist() for x in (i, j)), strict=True):
                if (p := find(int(unit[m]))) == (q := find(int(unit[n]))):
                    continue
                if exact:
                    both = len(np.intersect1d(sets[m], sets[n], assume_unique=True))
                    if both + 1e-9 < similarity * (len(sets[m]) + len(sets[n]) - both):
                        continue
                up[max(p, q)] = min(p, q)
                edges.append((int(unit[m]), int(unit[n])))
        alone = np.flatnonzero(open_)
        columns = [[min(p) for p in edges] + unit[alone].tolist(), [max(p) for p in edges] + [None] * len(alone), [None] * len(edges) + key[alone].tolist()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "key"), columns, strict=True)})

    return run


def _by_task(met: DataFrame, columns: list[str], task_rows: int = 4096) -> DataFrame:
    """Deal rows (key, members, ...) to tasks: rare keys many at a time, the members of a common one in blocks, every pair of blocks a task."""
    tasks = max(1, -(-met.count() // task_rows))
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    own = met.withColumn("blocks", blocks).withColumn("block", F.when(F.col("blocks") == 1, -1).otherwise(F.pmod(F.xxhash64("unit"), F.col("blocks"))).cast("int"))
    own = own.withColumn("other", F.explode(F.when(F.col("block") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    task = F.when(F.col("block") < 0, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.col("key")).alias("task")
    return own.select(task, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "key", "unit", "size", "block", *_WIDE, *columns).groupBy("task", "lo", "hi")


def _similar_links(units: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): ``rep`` of units (unit, rep, size, keys, w0 to w3) whose shingle sets have the Jaccard ``similarity``.

    At such a similarity no segment of a fingerprint is sure to be equal, so a key of minima deals the texts
    to candidates. Those pass the ring's chains and then the Hamming distance: at most three standard deviations more
    bits of the wide fingerprint than expected at ``similarity``. Three below it are sure; for the others
    the sets are compared, unless sure links connect the two anyway. Keys that one text alone has go first, as narrow rows.
    """
    dealt = stage(units.select("unit", F.explode("keys").alias("key")))
    members = stage(dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    met = stage(dealt.join(members, "key").join(units.select("unit", "size", *_WIDE), "unit"))
    bits = wide_budget(similarity, -3), wide_budget(similarity, 3), similarity
    found = stage(_by_task(met, []).applyInArrow(_compare(*bits, exact=False), "a long, b long, key long"))
    sure = stage(found.where("b is not null").select("a", "b").distinct())
    roots = connected_components(sure)
    open_ = stage(found.where("b is null").select(F.col("a").alias("unit"), "key").distinct())
    wanted = stage(open_.select("unit").distinct().join(units.select("unit", "rep"), "unit"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["unit", "s"])

    again = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text").mapInArrow(sets, "unit long, s array<long>")
    again = stage(again.join(wanted.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.any_value("s").alias("s")))
    rest = met.join(open_, ["unit", "key"]).join(again, "unit").join(roots, F.col("unit") == F.col("node"), "left").withColumn("root", F.coalesce("root", "unit"))
    held = _by_task(stage(rest), ["root", "s"]).applyInArrow(_compare(*bits, exact=True), "a long, b long, key long").select("a", "b").distinct()
    links = stage(sure.unionByName(held))
    for side in ("a", "b"):
        links = links.join(units.select(F.col("unit").alias(side), F.col("rep").alias(f"rep_{side}")), side)
    return links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, component_id).

    Documents are linked if the sets of their ``shingle``-word shingles have a Jaccard ``similarity``;
    component_id is the smallest doc_id that links reach. Keys of minima and 256-bit SimHashes of the sets give the
    candidates (``_similar_links``); a pair right at 0.8 is among them over 98 times in a hundred, more similar ones
    nearly always, however the edits lie. Equal sets meet in one grouping, so copies never make pairs. The work grows with
    the number of texts, and with the square of a group of different near copies only.

    Null or empty texts have the empty set and are copies of each other; a null doc_id is linked by an equal set
    alone and never names a component, which is null if it has no other member; repeated rows are
    each returned; empty tables give no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [shingle_set(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                wide = np.array([_majority(s, WIDE) for _, s in found]).reshape(-1, WIDE)
                numbers = [[u for u, _ in found], [len(s) for _, s in found], *wide.T]
                keys = pa.array(list(band_keys([s for _, s in found])), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in numbers], keys], ["doc_id", "unit", "size", *_WIDE, "keys"])

    base = stage(own.mapInArrow(run, f"doc_id long, unit long, size long, {', '.join(f'{w} long' for w in _WIDE)}, keys array<long>"))
    units = stage(base.groupBy("unit").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("size", *_WIDE, "keys")]))
    roots = connected_components(_similar_links(units.where("rep is not null"), own, shingle, similarity))
    # Staged, so that both sides of the join are plain shuffles: Spark then splits a very common text's rows.
    named = stage(units.join(roots, units.rep == roots.node, "left").select("unit", F.coalesce("root", "rep").alias("component_id")))
    return base.join(named, "unit").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of every near-duplicate group, columns and values as they were, whatever their names.

    Among rows with equal doc_id (ties) all stay if it is the group's smallest; rows without doc_id stay.
    """
    plain, names = plain_columns(docs)
    own = named(names, id_col)
    groups = similar_groups(plain, id_col=own, text_col=named(names, text_col), **options)
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    return as_before(plain.join(dropped, F.col(own).cast("long") == F.col("gone"), "left_anti"), names)
