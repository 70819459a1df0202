"""Plans, specifications, identities and dataset generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_digest, uuid5
from ..operators import raster
from ..operators.merge import digest_tree
from ..sources.matrix import AREA_PRESETS

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # RFC 4122, URL


def plan(levels: DataFrame, *, content_id: str | None = None, include_edge_cases: bool = False) -> DataFrame:
    """The status of every (matrix row, severity), and the share of area that stands for it.

    In order: review required, do not generate, operator missing, edge case without opt-in, eligible.
    """
    if content_id is not None:
        levels = levels.where(F.col("content_id") == content_id)
        if levels.limit(1).count() == 0:
            raise ValueError(f"unknown content id: {content_id}")
    all_issues = F.concat("issues", "level_issues")
    status = (
        F.when(F.size(all_issues) > 0, "matrix_review_required").when(F.col("cohort") == "excluded", "do_not_generate").when(F.col("family").isNull(), "operator_not_implemented")
        .when((F.col("cohort") == "edge_case") & F.lit(not include_edge_cases), "edge_case_opt_in_required").otherwise("eligible")
    )
    preset = F.element_at(F.create_map(*[F.lit(x) for p in AREA_PRESETS.items() for x in p]), F.col("severity"))
    return levels.withColumn("status", status).withColumn("area_fraction", F.when(F.col("family").isNotNull(), preset))


def cross(pages: DataFrame, families: list[str], severities: list[float]) -> DataFrame:
    """Page by family by severity; the literal lists are exploded, no join."""
    grid = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("severity")) for f in families for s in severities])
    return pages.select("*", F.explode(grid).alias("_g")).select("*", "_g.family", "_g.severity").drop("_g")


def task_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hex digits of the descriptor's digest."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(stable_digest(prefix, *parts), 1, 20))


def specification(pages: DataFrame, families: list[str], severities: list[float], *, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected): validation pages times the grid; pages with errors are listed, never replaced."""
    own = pages.where(F.col("split") == "validation")
    rejected = own.where(F.size("errors") > 0).select("page_id", "errors")
    tasks = cross(own.where(F.size("errors") == 0), families, severities)
    return tasks.withColumn("task_id", task_id(prefix, F.col("page_id"), F.col("family"), F.col("severity"))).withColumn("evidence_sha256", stable_digest(F.col("page_id"), F.col("content_sha256"))), rejected


def with_plan(pages: DataFrame, planned: DataFrame) -> DataFrame:
    """Pages (content_id, damage_id, severity) with the plan's status; a miss is no_matrix_row."""
    return pages.join(planned.select("content_id", "damage_id", "severity", "status", "family", "area_fraction"), ["content_id", "damage_id", "severity"], "left").withColumn("status", F.coalesce("status", F.lit("no_matrix_row")))


def input_manifest(selected: DataFrame) -> DataFrame:
    """Flat task rows with a 20-digit sample id."""
    return selected.select(F.substring(stable_digest(F.col("group_id"), F.col("page_id")), 1, 20).alias("sample_id"), "group_id", "page_id", "split")


def run_identity(inputs: DataFrame, model: str, settings: dict, *, key: str, checksum: str, group: str, leaf: int = 4096, levels: int | None = None) -> DataFrame:
    """(group, run_identity): a digest of model, settings and the checksums of a run's sources, as a hash tree over ``key=checksum`` (``merge.digest_tree``)."""
    entry = F.concat_ws("=", F.col(key).cast("string"), F.col(checksum))
    sources = digest_tree(inputs.select(group, F.sha2(entry, 256).alias("d")), [group], leaf, levels)
    fixed = ";".join(f"{k}={settings[k]}" for k in sorted(settings))
    return sources.select(group, F.sha2(F.concat_ws(chr(0), F.lit(model), F.lit(fixed), F.col("rows_sha256")), 256).alias("run_identity"))


def to_run(inputs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The inputs that no valid cache row covers; all of identity, size and digest must match."""
    return inputs.join(cache.select(*keys).distinct(), keys, "left_anti")


def register_ids(tasks: DataFrame, identity: list[str]) -> DataFrame:
    """Identity digest and the UUIDv5 made from it."""
    digest = stable_digest(*[F.col(c) for c in identity])
    return tasks.withColumn("identity_sha256", digest).withColumn("task_uuid", uuid5(NAMESPACE, digest))


def ordered_inputs(ids: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """C20: expected ids (key, position) with their registry row, in order; ``missing`` where there is none."""
    return ids.join(registry.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there").orderBy("position")


def geometry_method(regions: DataFrame, sample: str, mask: str) -> DataFrame:
    """Regions of a sample, those with a mask, and the method: mask, bbox or mixed."""
    by = regions.groupBy(sample).agg(F.count("*").alias("regions"), F.count(mask).alias("masks"))
    return by.withColumn("method", F.when(F.col("masks") == F.col("regions"), "segmentation_mask").when(F.col("masks") == 0, "bbox").otherwise("mixed"))


def prefix_union_area(spans: DataFrame, label: str, prefix: str) -> DataFrame:
    """Area of the union of the regions whose label starts with ``prefix``, by page."""
    return raster.area(raster.union_spans(spans.where(F.col(label).startswith(prefix)).select("page_id", "y", "x0", "x1"), ["page_id"]), ["page_id"])


def first_of_severity(records: DataFrame, page: str, severity: str, order: str) -> DataFrame:
    """C22."""
    w = Window.partitionBy(page, severity).orderBy(order)
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def isolation_errors(pages: DataFrame, *, group: str, content: str, split: str = "split") -> DataFrame:
    """(kind, key, splits): groups or equal contents in several splits; the order of rows is of no matter."""
    parts = []
    for kind, col in (("group", group), ("content", content)):
        by = pages.groupBy(F.col(col).cast("string").alias("key")).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n"))
        parts.append(by.where("n > 1").select(F.lit(kind).alias("kind"), "key", "splits"))
    return parts[0].unionByName(parts[1])


def generate(pages: DataFrame, cells: DataFrame, planned: DataFrame, families: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observed, targets, skipped) for eligible (page, damage, severity) tasks.

    Test pages are filtered before their cells are read. ``observed`` has the surviving cells,
    ``targets`` the removed ones, apart; ``skipped`` says why a page has no task.
    """
    open_pages = pages.where(F.col("split") != "test")
    tasks = with_plan(open_pages, planned)
    skipped = tasks.where("status != 'eligible'").select("page_id", "damage_id", "severity", "status").unionByName(
        pages.where(F.col("split") == "test").select("page_id", "damage_id", "severity", F.lit("frozen_test_page").alias("status"))
    )
    observed, targets = [], []
    for family, fraction in families.items():
        own = tasks.where((F.col("status") == "eligible") & (F.col("family") == family) & (F.col("area_fraction") == fraction)).select("page_id").distinct()
        done = raster.remove_share(cells.join(own, "page_id", "left_semi"), family, fraction).where("status = 'ok'")
        named = done.select(F.lit(family).alias("family"), F.lit(fraction).alias("fraction"), "page_id", "y", "x", "removed")
        observed.append(named.where("not removed").drop("removed"))
        targets.append(named.where("removed").drop("removed"))
    from functools import reduce

    return reduce(DataFrame.unionByName, observed), reduce(DataFrame.unionByName, targets), skipped
