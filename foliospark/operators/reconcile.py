"""Differences between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def known(rows: DataFrame, terms: DataFrame, key: str, term: str) -> DataFrame:
    """J12."""
    return rows.join(terms.select(F.col(term).alias(key)), key, "left_semi")


def overlap(left: DataFrame, right: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key_kind, shared): for every named key the number of distinct values in both batches."""
    parts = [left.select(k.alias("v")).distinct().join(right.select(k.alias("v")).distinct(), "v", "left_semi").agg(F.lit(name).alias("key_kind"), F.count("*").alias("shared")) for name, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


def key_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, as missing or extra."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    return e.join(a, key, "full_outer").where("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def field_differences(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows on both sides with the names of the fields that differ (null-safely)."""
    e, a = expected.alias("e"), actual.alias("a")
    joined = e.join(a, [F.col(f"e.{k}") == F.col(f"a.{k}") for k in keys])
    names = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    return joined.select(*[F.col(f"e.{k}").alias(k) for k in keys], names.alias("differing")).where(F.size("differing") > 0)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, differing): added, removed or changed rows between two snapshots."""
    b, a = before.select(key, *fields, F.lit(True).alias("_in")).alias("b"), after.select(key, *fields, F.lit(True).alias("_in")).alias("a")
    joined = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    names = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("b._in").isNull(), "added").when(F.col("a._in").isNull(), "removed").when(F.size(names) > 0, "changed")
    out = joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), change.alias("change"), F.when(change == "changed", names).alias("differing"))
    return out.where("change is not null")


def relationship_errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with the names of the checks that they fail; a null check is passed."""
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return rows.withColumn("errors", errors).where(F.size("errors") > 0)


def identical_copies(left: DataFrame, right: DataFrame, *, size: str, content: Column, name: str) -> DataFrame:
    """(name, copy) of files with equal size and digest and another name.

    Digests are made only for sizes that occur on both sides.
    """
    sizes = left.select(size).distinct().join(right.select(size).distinct(), size, "left_semi")
    l, r = (df.join(sizes, size, "left_semi").select(size, content.alias("sha"), F.col(name)) for df in (left, right))
    return l.alias("l").join(r.alias("r"), (F.col(f"l.{size}") == F.col(f"r.{size}")) & (F.col("l.sha") == F.col("r.sha")) & (F.col(f"l.{name}") != F.col(f"r.{name}"))).select(F.col(f"l.{name}").alias(name), F.col(f"r.{name}").alias("copy"))


def matched(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables on the keys that both have."""
    ids = left.select(key).intersect(right.select(key))
    return left.join(ids, key, "left_semi"), right.join(ids, key, "left_semi")


def first_source_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """For every key the row of the first source that has it."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)])
    first = Window.partitionBy(key).orderBy("source_order")
    return ranked.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def replay_reviews(flags: DataFrame, reviews: DataFrame, key: str, digest: str) -> DataFrame:
    """A recorded decision counts only for the same evidence; else a human must look again."""
    r = reviews.select(key, digest, F.col("decision").alias("_decision"))
    return flags.join(r, [key, digest], "left").withColumn("outcome", F.coalesce("_decision", F.lit("requires_human_review"))).drop("_decision")


def availability(expected: DataFrame, files: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, status): available, restored, changed, unavailable or manual_action, from files found and the state before."""
    e = expected.select(key, F.col("sha256").alias("_want"))
    f = files.select(key, F.col("sha256").alias("_have"))
    p = previous.select(key, F.col("status").alias("_before"))
    joined = e.join(f, key, "left").join(p, key, "left")
    here, right = F.col("_have").isNotNull(), F.col("_want").isNull() | (F.col("_have") == F.col("_want"))
    status = (
        F.when(here & right & F.coalesce(F.col("_before").isin("unavailable", "failed"), F.lit(False)), "restored")
        .when(here & right, "available").when(here, "failed").when(F.col("_before") == "manual_action", "manual_action").otherwise("unavailable")
    )
    return joined.select(key, status.alias("status"))


def preferred_or_first_ready(items: DataFrame, *, group: str, item: str, notes: Column, preferred: Column, order: str) -> DataFrame:
    """Per group the preferred item if it is ready (no notes), else the first ready one; with the reason."""
    rows = items.withColumn("_notes", notes).withColumn("_pref", preferred)
    ready = F.size("_notes") == 0
    rank = Window.partitionBy(group).orderBy(F.when(ready, 0).otherwise(1), F.when(F.col("_pref"), 0).otherwise(1), order, item)
    best = rows.withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    reason = F.when(~ready, "none_ready").when(F.col("_pref"), "preferred").otherwise("fallback")
    return best.select(group, F.when(ready, F.col(item)).alias("chosen"), reason.alias("reason"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def batch_audit(runs: DataFrame, assets: DataFrame, *, key: str, json_col: str, paths: dict[str, str]) -> DataFrame:
    """Runs with fields of their JSON and their asset; ``audit`` names what is missing. Runs and assets share ``key``."""
    projected = runs.select("*", *[F.get_json_object(json_col, path).alias(name) for name, path in paths.items()])
    lacks = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in paths])
    joined = projected.join(assets.withColumn("_known", F.lit(True)), key, "left")
    return joined.withColumn("audit", F.when(F.col("_known").isNull(), "missing_asset").when(lacks, "missing_field").otherwise("ok")).drop("_known")


def batch_union(batches: list[DataFrame], keys: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """(all rows with their batch number, refusals): a key that several rows share is refused, in one batch or across.

    Refusals are rows (rule, key, rows, batches); nulls in a key are no value to share.
    """
    whole = reduce(DataFrame.unionByName, [b.withColumn("batch", F.lit(k)) for k, b in enumerate(batches)])
    refusals = []
    for key in keys:
        value = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
        named = whole.dropna(subset=key).groupBy(value.alias("key")).agg(F.count("*").alias("rows"), F.count_distinct("batch").alias("batches")).where("rows > 1")
        refusals.append(named.select(F.lit("shared_" + "_".join(key)).alias("rule"), "key", "rows", "batches"))
    return whole, reduce(DataFrame.unionByName, refusals)


def register_tasks(planned: DataFrame, registered: DataFrame, identity: list[str]) -> DataFrame:
    """Planned rows with ``action``: register, known (already there), or refuse (planned more than once)."""
    often = planned.groupBy(*identity).agg(F.count("*").alias("_times"))
    known = registered.select(*identity).distinct().withColumn("_known", F.lit(True))
    joined = planned.join(often, identity).join(known, identity, "left")
    return joined.withColumn("action", F.when(F.col("_times") > 1, "refuse").when(F.col("_known"), "known").otherwise("register")).drop("_times", "_known")


def task_differences(planned: DataFrame, generated: DataFrame, identity: list[str], fields: list[str]) -> DataFrame:
    """Generated tasks against their plan: rows (identity, status, fields that differ)."""
    p, g = planned.select(*identity, F.struct(*fields).alias("_p")), generated.select(*identity, F.struct(*fields).alias("_g"))
    both = p.join(g, identity, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_p.{f}").eqNullSafe(F.col(f"_g.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("_g").isNull(), "not_generated").when(F.col("_p").isNull(), "not_planned").when(F.size(differ) > 0, "differs").otherwise("ok")
    return both.select(*identity, status.alias("status"), F.when(status == "differs", F.array_join(differ, ",")).otherwise("").alias("fields"))


def required(df: DataFrame, key: str, found: Column, what: str) -> DataFrame:
    """The rows, where one without ``found`` is an error that names its key.

    The check is part of the plan, in the key column, so nothing is counted on the driver: whoever reads the key of an unmatched row fails.
    """
    return df.withColumn(key, F.when(found, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(df.schema[key].dataType)))


def registration(pages: DataFrame, cache: DataFrame, repositories: DataFrame, manuscripts: DataFrame, canvases: DataFrame, assets: DataFrame) -> DataFrame:
    """The stored ids of every page (page_id, manifest_url, canvas_url, source_url): cache, repository, manuscript, canvas and asset.

    ``cache``: cache_id, manifest_url, repository_id, manuscript_id. ``repositories``: repository_id. ``manuscripts``: manuscript_id. ``canvases``: canvas_id, manuscript_id, canvas_url.
    ``assets``: asset_id, canvas_id, source_url, which compares null-safely. Of several matches the smallest ids count; a page without any is an error.
    """
    found = pages.select("page_id", "manifest_url", "canvas_url", "source_url").join(cache, "manifest_url", "left")
    found = found.join(repositories.select("repository_id", F.lit(True).alias("_repository")), "repository_id", "left").join(manuscripts.select("manuscript_id", F.lit(True).alias("_manuscript")), "manuscript_id", "left")
    found = found.join(canvases, ["manuscript_id", "canvas_url"], "left")
    a = assets.select("asset_id", F.col("canvas_id").alias("_canvas"), F.col("source_url").alias("_url"))
    found = found.join(a, (F.col("canvas_id") == F.col("_canvas")) & F.col("source_url").eqNullSafe(F.col("_url")), "left")
    whole = F.col("_repository") & F.col("_manuscript") & F.col("asset_id").isNotNull()
    ids = F.struct("cache_id", "repository_id", "manuscript_id", "canvas_id", "asset_id")
    best = found.groupBy("page_id").agg(F.min(F.when(whole, ids)).alias("row"))
    return required(best.select("page_id", "row.*"), "page_id", F.col("asset_id").isNotNull(), "page is not registered")
