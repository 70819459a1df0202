"""Summaries of controlled-loss experiments.

Tasks are (task_id, family, severity, manuscript, page, measured): ``severity`` is what was asked for, ``measured`` the share of the
page that went (null if nothing was measured). Regions are (task_id, label, fraction): what is left of each region of a task.
Page statistics are over tasks and region statistics over regions: the two are aggregated apart and joined afterwards, so no task counts
once for each of its regions. A task without regions counts as a task; a region whose task is missing counts nowhere.
Rows are counted by equal values first. Medians are exact, and no large group lies in one task (``profile.profile``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import survival_category
from ..session import staged
from . import profile

DIMENSIONS = {"mask_family": "family", "requested_severity": "severity", "manuscript": "manuscript", "page": "page"}
CATEGORIES = ("almost_complete", "partial", "mostly_destroyed", "fully_removed", "undefined")
RATES = {"fully_removed_rate": "fully_removed", "mostly_removed_rate": "mostly_destroyed", "partial_rate": "partial", "almost_complete_rate": "almost_complete"}


def _tall(df: DataFrame, dims: dict[str, str], measure: str, own: str | None = None) -> DataFrame:
    """(dimension, value, measure, _rows): for every dimension how many rows have a value and measure, written once; null values are one bucket.

    Rows are counted by all dimensions together before these come apart, except ``own``, which has so many values that it is counted by itself.
    """
    few = [c for c in dims.values() if c != own]
    sets = [[*few, measure]] + ([[own, measure]] if own else [])
    counted = df.groupingSets(sets, *(few + [own] if own else few), measure).agg(F.count("*").alias("_rows"), (F.grouping(own) if own else F.lit(1)).alias("_few"))
    bucket = lambda n, c: F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit(profile.MISSING)).alias("value"))
    shown = {held: F.array(*[bucket(n, c) for n, c in dims.items() if (c == own) is held]) for held in (False, True) if not held or own}
    buckets = F.when(F.col("_few") == 1, shown[False]).otherwise(shown[True]) if own else shown[False]
    return staged(counted.select(F.explode(buckets).alias("_set"), measure, "_rows").select("_set.*", measure, "_rows"))


def _beside(by: list[str], first: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins on ``by``, where null meets null."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({b: f"_on_{b}" for b in by})
        on = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_on_{b}")) for b in by])
        return left.join(right, on, "left").drop(*[f"_on_{b}" for b in by])

    return reduce(add, others, first)


def _categories(counted: DataFrame, by: list[str]) -> DataFrame:
    """Regions and those of every category, from counts (fraction, _rows)."""
    category = survival_category(F.col("fraction"))
    return counted.groupBy(*by).agg(F.sum("_rows").alias("regions"), *[F.sum(F.when(category == c, F.col("_rows")).otherwise(0)).alias(c) for c in CATEGORIES])


def _held(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """The tasks, a row for each class they hold."""
    labels = regions.groupBy("task_id").agg(F.collect_set("label").alias("_labels"), F.bool_or(F.col("label").isNull()).alias("_none"))
    held = F.when(F.col("_none"), F.array_append("_labels", F.lit(None).cast("string"))).otherwise(F.col("_labels"))
    return labels.select("task_id", held.alias("_labels")).join(tasks, "task_id").withColumn("label", F.explode("_labels")).drop("_labels")


def summary(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """(dimension, value, tasks, regions, page_*, region_*, a count and a share of every category) by family, severity, manuscript, page and class.

    Under ``layout_class`` a class counts the tasks that hold it, once each, and its own regions only.
    """
    by = ["dimension", "value"]
    tasks = tasks.withColumn("surviving", 1 - F.col("measured"))
    region_rows = _tall(regions.select("task_id", "label", "fraction").join(tasks, "task_id"), DIMENSIONS | {"layout_class": "label"}, "fraction", "page")
    task_rows = _tall(tasks, DIMENSIONS, "surviving", "page").unionByName(_tall(_held(tasks.select("task_id", "surviving"), regions), {"layout_class": "label"}, "surviving"))
    out = _beside(
        by, task_rows.groupBy(*by).agg(F.sum("_rows").alias("tasks")), _categories(region_rows, by),
        profile.profile(task_rows, by, "surviving", "page_", weight="_rows"), profile.profile(region_rows, by, "fraction", "region_", weight="_rows"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("regions", *CATEGORIES, "region_n")]
    stats = [f"{p}_{s}" for p in ("page", "region") for s in ("n", "mean", "median", "min", "max", "sd") if (p, s) != ("region", "n")]
    return out.select(*by, "tasks", *counts, *stats, *[(F.col(c) / F.nullif(F.col("regions"), F.lit(0))).alias(f"{c}_share") for c in CATEGORIES])


_LEVEL = ["level", "family", "severity", "label"]
_METRICS = ("loss", "error", "survival")


def metrics(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """A19, flat: (level, family, severity, label, tasks, regions, loss_*, error_*, survival_*, rates).

    Levels: ``overall``, ``group`` (family and severity) and ``class`` (with the label, over the tasks that hold it and its own regions).
    ``loss`` is what was measured, ``error`` its distance from what was asked for.
    """
    tasks = tasks.select("task_id", "family", "severity", F.col("measured").alias("loss"))
    level = lambda name, family, severity, label: F.struct(F.lit(name).alias("level"), family.alias("family"), severity.alias("severity"), label.alias("label"))
    none = F.lit(None)
    overall = level("overall", none.cast("string"), none.cast("double"), none.cast("string"))
    group = level("group", F.col("family"), F.col("severity").cast("double"), none.cast("string"))
    own = level("class", F.col("family"), F.col("severity").cast("double"), F.col("label"))
    # Counted within their class or group first: the levels above are made of these counts.
    count = lambda df, *by: df.groupBy("family", "severity", *by).agg(F.count("*").alias("_rows"))
    spread = lambda df, levels, *keep: df.select(F.explode(F.array(*levels)).alias("_l"), *keep, "_rows").select("_l.*", *keep, "_rows")
    error = F.abs(F.col("loss") - F.col("severity"))
    each = lambda df, levels: spread(df.withColumn("error", error), levels, "loss", "error")
    task_rows = staged(each(count(tasks, "loss"), [overall, group]).unionByName(each(count(_held(tasks, regions), "label", "loss"), [own])))
    measured = count(regions.select("task_id", "label", "fraction").join(tasks, "task_id"), "label", "fraction")
    region_rows = staged(spread(measured, [overall, group, own], "fraction"))
    out = _beside(
        _LEVEL, task_rows.groupBy(*_LEVEL).agg(F.sum("_rows").alias("tasks")), _categories(region_rows, _LEVEL),
        *[profile.profile(rows, _LEVEL, c, f"{name}_", weight="_rows") for name, rows, c in (("loss", task_rows, "loss"), ("error", task_rows, "error"), ("survival", region_rows, "fraction"))],
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("regions", "survival_n")]
    stats = [f"{m}_{s}" for m in _METRICS for s in ("n", "mean", "median", "min", "max", "sd") if (m, s) != ("survival", "n")]
    return out.select(*_LEVEL, "tasks", *counts, *stats, *[(F.col(c) / F.nullif(F.col("regions"), F.lit(0))).alias(n) for n, c in RATES.items()])


def nested_metrics(tasks: DataFrame, regions: DataFrame) -> DataFrame:
    """A row overall and for every (family, severity): its metrics, and ``layout_classes``, a map from class to the metrics within it.

    The maps hold one entry for each class, whatever the number of regions; overall has none.
    """
    flat = metrics(tasks, regions)
    values = [c for c in flat.columns if c not in _LEVEL]
    entries = F.array_sort(F.collect_list(F.struct("label", F.struct(*values).alias("metrics"))))
    classes = flat.where("level = 'class' and label is not null").groupBy("family", "severity").agg(F.map_from_entries(entries).alias("layout_classes"))
    return _beside(["family", "severity"], flat.where("level <> 'class'").drop("label"), classes)
