"""Idempotent merges of table snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_fingerprint
from ..session import staged


@dataclass(frozen=True)
class Policy:
    """How a matched row's columns change. Columns not named are overwritten.

    ``coalesce``: the new value unless it is null. ``replace_if_filled``: arrays, unless the new one is empty.
    ``map_merge``: maps, the new value winning by key, except ``guarded`` keys, which stay as they are.
    ``frozen``: never changed once the row exists. ``insert_values``: what a new row gets instead of its own.
    """

    coalesce: tuple[str, ...] = ()
    replace_if_filled: tuple[str, ...] = ()
    map_merge: tuple[str, ...] = ()
    guarded: tuple[str, ...] = ()
    frozen: tuple[str, ...] = ()
    insert_values: dict = field(default_factory=dict)
    insert_only: bool = False


def _map_merge(old: Column, new: Column, kind, guarded: tuple[str, ...]) -> Column:
    """Right-wins concatenation of two maps, in which guarded keys stay as the left has them."""
    none = F.create_map().cast(kind)
    kept = F.map_filter(F.coalesce(old, none), lambda k, _: k.isin(*guarded) | F.coalesce(~F.map_contains_key(new, k), F.lit(True)))
    return F.map_concat(kept, F.map_filter(F.coalesce(new, none), lambda k, _: ~k.isin(*guarded)))


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: Policy = Policy()) -> DataFrame:
    """The new snapshot with ``action``: inserted, updated, matched (same values) or kept.

    Keys compare null-safely. One full outer join; neither side may repeat a key (V6).
    """
    values = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *values, F.lit(True).alias("_in")).alias("t")
    s = source.select(*keys, *values, F.lit(True).alias("_in")).alias("s")
    on = None
    for k in keys:
        same = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        on = same if on is None else on & same
    both = t.join(s, on, "full_outer")
    old_row, new_row = F.col("t._in").isNotNull(), F.col("s._in").isNotNull()
    out = {}
    for c in values:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        if policy.insert_only or c in policy.frozen:
            merged = old
        elif c in policy.coalesce:
            merged = F.coalesce(new, old)
        elif c in policy.replace_if_filled:
            merged = F.when(F.size(new) > 0, new).otherwise(old)
        elif c in policy.map_merge:
            merged = _map_merge(old, new, target.schema[c].dataType, policy.guarded)
        else:
            merged = new
        first = F.lit(policy.insert_values[c]).cast(target.schema[c].dataType) if c in policy.insert_values else new
        out[c] = F.when(~old_row, first).when(~new_row, old).otherwise(merged)
    is_map = lambda c: c in policy.map_merge
    plain = lambda col, c: F.array_sort(F.map_entries(col)) if is_map(c) else col
    same = F.lit(True)
    for c in values:
        same = same & plain(out[c], c).eqNullSafe(plain(F.col(f"t.{c}"), c))
    action = F.when(~old_row, "inserted").when(~new_row, "kept").when(same, "matched").otherwise("updated")
    return both.select(*[F.when(old_row, F.col(f"t.{k}")).otherwise(F.col(f"s.{k}")).alias(k) for k in keys], *[v.alias(c) for c, v in out.items()], action.alias("action"))


def action_counts(merged: DataFrame) -> DataFrame:
    """A32."""
    return merged.groupBy("action").agg(F.count("*").alias("rows"))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of every parent in ``fresh`` are replaced by those rows; others stay."""
    stay = children.join(fresh.select(parent).distinct(), parent, "left_anti")
    return stay.unionByName(fresh.select(*children.columns))


def resume(inputs: DataFrame, stored: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """For each input the fresh result, else the stored one; ``origin`` says which, or missing."""
    a, b = stored.select(key, F.col(value).alias("_old")), fresh.select(key, F.col(value).alias("_new"))
    joined = inputs.select(key).join(a, key, "left").join(b, key, "left")
    origin = F.when(F.col("_new").isNotNull(), "refreshed").when(F.col("_old").isNotNull(), "kept").otherwise("missing")
    return joined.select(key, F.coalesce("_new", "_old").alias(value), origin.alias("origin"))


def digest_tree(rows: DataFrame, group_by: list[str], leaf: int = 4096, levels: int | None = None) -> DataFrame:
    """(group_by ..., rows, rows_sha256): a hash tree over the column ``d``, SHA-256 digests in hex, that no partitioning changes.

    A node holds the digests of one prefix. With at most ``leaf`` distinct ones its hash is that of its sorted entries ``digest:count``, else that of its
    sixteen children's hashes in order. Equal digests are counted first, and the tree grows from prefixes so long that a node there
    holds a sixteenth of a leaf; so no task gathers more than sixteen leaves of a group, however large the group or often a row is repeated.
    With ``levels`` no prefix is longer than that, and a node there is a list whatever it holds: one task then hashes the 16**levels-th part of a group.
    """
    # Digests travel as bytes, half as long as their hex, and are spelt where they are hashed; both have the same order.
    counted = staged(rows.select(*group_by, F.unhex("d").alias("d")).groupBy(*group_by, "d").agg(F.count("*").alias("c")))
    most = counted.groupBy(*group_by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    depth = 0
    while (levels is None or depth < levels) and 16**depth * leaf < 16 * most:
        depth += 1
    own = F.sha2(F.array_join(F.transform("entries", lambda x: F.concat_ws(":", F.lower(F.hex(x["d"])), x["c"].cast("string"))), ""), 256)
    at = lambda n: [F.substring("p", 1, n).alias("p")] if n else []
    prefix = F.substring(F.lower(F.hex("d")), 1, max(depth, 1))
    nodes = counted.withColumn("p", prefix).groupBy(*group_by, *at(depth)).agg(F.sum("c").alias("rows"), F.array_sort(F.collect_list(F.struct("d", "c"))).alias("entries"), F.lit(None).cast("string").alias("h"))
    if depth == levels:  # lists longer than a leaf are hashed here, as no node above may list them
        long = F.size("entries") > leaf
        nodes = nodes.withColumn("h", F.when(long, own)).withColumn("entries", F.when(~long, F.col("entries")))
    for level in range(depth - 1, -1, -1):
        children = nodes.withColumn("child", F.struct("p", "entries", F.coalesce("h", own).alias("h")))
        above = children.groupBy(*group_by, *at(level)).agg(F.sum("rows").alias("rows"), F.sum(F.coalesce(F.size("entries"), F.lit(0))).alias("n"), F.count_if(F.col("entries").isNull()).alias("split"), F.array_sort(F.collect_list("child")).alias("child"))
        whole = (F.col("split") == 0) & (F.col("n") <= leaf)
        listed = F.when(whole, F.flatten(F.transform("child", lambda x: x["entries"])))
        hashed = F.when(~whole, F.sha2(F.array_join(F.transform("child", lambda x: x["h"]), ""), 256))
        nodes = above.select(*group_by, *(["p"] if level else []), "rows", listed.alias("entries"), hashed.alias("h"))
    return nodes.select(*group_by, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("h", own, F.sha2(F.lit(""), 256)).alias("rows_sha256"))


def fingerprint(df: DataFrame, group_by: list[str] = [], leaf: int = 4096, levels: int | None = None) -> DataFrame:  # noqa: B006
    """(..., rows, rows_sha256): a digest of the rows, by group (``digest_tree``)."""
    return digest_tree(df.select(*group_by, row_fingerprint(*df.columns).alias("d")), group_by, leaf, levels)


def file_snapshot(files: DataFrame, by: str, leaf: int = 4096) -> DataFrame:
    """(by, files, bytes, content_sha256, state_sha256) of an inventory (path, size, sha256, modified): the digests of the contents, and of contents with times of change."""
    sizes = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    for name, columns in (("content_sha256", ("path", "sha256")), ("state_sha256", ("path", "sha256", "modified"))):
        own = digest_tree(files.select(by, row_fingerprint(*columns).alias("d")), [by], leaf)
        sizes = sizes.join(own.select(F.col(by).alias("_by"), F.col("rows_sha256").alias(name)), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return sizes
