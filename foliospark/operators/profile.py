"""Profiles and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import ranking

MISSING = "[missing]"


def counters(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """A3: rows by key; null and blank keys are one bucket."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(key.cast("string")), F.lit("")), F.lit(MISSING)).alias(name)).agg(F.count("*").alias("rows"))


def group_sizes(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, members) for every group, also those without members."""
    n = members.groupBy(key).agg(F.count("*").alias("_n"))
    return groups.select(key).distinct().join(n, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("members"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """A5: (field, present, missing, fraction): one pass, then one row for each field."""
    filled = lambda c: F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1))
    wide = df.agg(F.count("*").alias("_rows"), *[filled(c).alias(c) for c in fields])
    tall = wide.unpivot(["_rows"], fields, "field", "present")
    return tall.select("field", "present", (F.col("_rows") - F.col("present")).alias("missing"), F.bround(F.when(F.col("_rows") > 0, F.col("present") / F.col("_rows")), 4).alias("fraction"))


def acquisition(df: DataFrame, status: str, size: str) -> DataFrame:
    """Rows, acquired = downloaded + reused, failed = the rest, bytes acquired."""
    is_in = lambda *s: F.col(status).isin(*s)
    done = is_in("downloaded", "reused")
    one = df.agg(F.count("*").alias("rows"), F.count(F.when(is_in("downloaded"), 1)).alias("downloaded"), F.count(F.when(is_in("reused"), 1)).alias("reused"), F.coalesce(F.sum(F.when(done, F.col(size))), F.lit(0)).alias("bytes"))
    return one.withColumn("acquired", F.col("downloaded") + F.col("reused")).withColumn("failed", F.col("rows") - F.col("acquired"))


def two_grains(df: DataFrame, group: str, split: str, splits: list[str]) -> DataFrame:
    """(split, groups, pages) for every split, zero-filled."""
    by = df.groupBy(F.col(split).alias("split")).agg(F.count_distinct(group).alias("_g"), F.count("*").alias("_p"))
    all_splits = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return F.broadcast(all_splits).join(by, "split", "left").select("split", F.coalesce("_g", F.lit(0)).alias("groups"), F.coalesce("_p", F.lit(0)).alias("pages"))


def shortfalls(df: DataFrame, group: str, chosen: Column, quota: int) -> DataFrame:
    """(group, selected, shortfall, status)."""
    by = df.groupBy(group).agg(F.count(F.when(chosen, 1)).alias("selected"))
    short = F.greatest(F.lit(quota) - F.col("selected"), F.lit(0))
    return by.select(group, "selected", short.alias("shortfall"), F.when(short > 0, "quota_shortfall").otherwise("complete").alias("status"))


def class_by_split(df: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """A10: a column of counts for each split, zero-filled."""
    return df.groupBy(label).pivot(split, splits).agg(F.count(F.lit(1))).na.fill(0, splits)


def missing_classes(df: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """(split, label): classes that a split lacks."""
    all_splits = df.sparkSession.createDataFrame([(s,) for s in splits], "_s string")
    grid = df.select(label).distinct().join(F.broadcast(all_splits))  # classes times a literal list
    return grid.join(df.select(label, F.col(split).alias("_s")).distinct(), [label, "_s"], "left_anti").select(F.col("_s").alias("split"), label)


def structure(df: DataFrame, group: str, owner: str, split: str) -> DataFrame:
    """Pages, groups, owners, pages by split, and the share of the largest owner."""
    per = df.groupBy(owner).agg(F.count("*").alias("_n"))
    top = per.agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"), F.count("*").alias("owners"))
    one = df.agg(F.count("*").alias("pages"), F.count_distinct(group).alias("groups"), *[F.count(F.when(F.col(split) == s, 1)).alias(f"{s}_pages") for s in ("train", "validation", "test")])
    return one.join(F.broadcast(top)).withColumn("largest_share", F.bround(F.col("_top") / F.col("_all"), 6)).drop("_top", "_all")  # one row beside one row


def run_summary(runs: DataFrame, regions: DataFrame, run: str, label: str, confidence: str) -> DataFrame:
    """Per run the regions, confidence range and labels; runs without regions stay."""
    by = regions.groupBy(run).agg(F.count("*").alias("_n"), F.min(confidence).alias("min_confidence"), F.bround(F.avg(confidence), 6).alias("avg_confidence"), F.max(confidence).alias("max_confidence"), F.array_sort(F.collect_set(label)).alias("_l"))
    return runs.select(run).join(by, run, "left").select(run, F.coalesce("_n", F.lit(0)).alias("regions"), "min_confidence", "avg_confidence", "max_confidence", F.coalesce("_l", F.array().cast("array<string>")).alias("labels"))


def run_statistics(df: DataFrame, dims: list[str], measure: str) -> DataFrame:
    """Counts and a distribution for every value of every dimension and overall."""
    sets = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias("value")) for d in dims]
    tall = df.select(F.explode(F.array(*sets, F.struct(F.lit("all").alias("dimension"), F.lit(MISSING).alias("value")))).alias("_s"), measure).select("_s.*", measure)
    by = ["dimension", "value"]
    plain = tall.groupBy(*by).agg(F.count("*").alias("rows"), F.bround(F.avg(measure), 6).alias("mean"), F.min(measure).alias("low"), F.max(measure).alias("high"))
    middle = ranking.exact_quantiles(tall, by, measure, [0.5]).select(*by, F.col("q0").alias("median"))
    return plain.join(middle, by, "left").select(*by, "rows", "mean", "median", "low", "high")


def outliers(df: DataFrame, key: str, count: str, confidence: str, *, low_confidence: float = 0.4) -> DataFrame:
    """Rows outside 1.5 IQR of the inclusive quartiles (from four rows on), without regions, or of low confidence."""
    quartiles = ranking.exact_quantiles(df, [], count, [0.25, 0.75]).select(F.array("q0", "q1").alias("_q"))
    q = df.agg(F.count("*").alias("_n")).join(quartiles, F.lit(True), "left")  # one row beside one row
    spread = F.col("_q")[1] - F.col("_q")[0]
    enough = F.col("_n") >= 4
    flags = F.array_compact(F.array(
        F.when(enough & (F.col(count) < F.col("_q")[0] - 1.5 * spread), "low_region_count"),
        F.when(enough & (F.col(count) > F.col("_q")[1] + 1.5 * spread), "high_region_count"),
        F.when(F.col(count) == 0, "zero_regions"),
        F.when(F.col(confidence) < low_confidence, "low_mean_confidence"),
    ))
    return df.join(F.broadcast(q)).select(key, count, confidence, flags.alias("flags")).where(F.size("flags") > 0)  # a one-row aggregate


def profile(df: DataFrame, by: list[str], measure: str, prefix: str = "", places: int = 10, weight: str | None = None) -> DataFrame:
    """Count, mean, exact median, min, max and population SD of the values present, by group.

    Over no values all but the count are null; the SD of fewer than two is null. The rows are read once, into counts of equal values (``weight``: they are
    such counts already), and everything comes from these (``ranking.counted_places``), so a group of any size is spread over tasks.
    """
    counts = staged(df.groupBy(*by, F.col(measure).alias("_value")).agg(F.count("*").alias("_count"))) if weight is None else df.select(*by, F.col(measure).alias("_value"), F.col(weight).alias("_count"))
    aggregates, (median,) = ranking.at_places([0.5])
    value, mean = F.col("_value").cast("double"), F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))
    found = ranking.counted_places(counts, by).groupBy(*by).agg(
        F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.max(mean).alias("mean"), *aggregates, F.min("_value").alias("min"), F.max("_value").alias("max"), F.sum(F.col("_count") * (value - mean) ** 2).alias("_squares")
    )
    sd = F.when(F.col("n") >= 2, F.bround(F.sqrt(F.col("_squares") / F.col("n")), places))
    return found.select(*by, *[c.alias(f"{prefix}{s}") for s, c in {"n": F.col("n"), "mean": F.bround("mean", places), "median": median, "min": F.col("min"), "max": F.col("max"), "sd": sd}.items()])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """A26, V6."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def storage_projection(df: DataFrame, size: str, planned: int) -> DataFrame:
    """Mean bytes times the planned pages."""
    return df.agg(F.count(size).alias("pages"), F.bround(F.avg(size), 4).alias("mean_bytes"), F.ceil(F.avg(size) * planned).cast("long").alias("projected_bytes"))


def warnings(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(warning, rows): how many rows show each soft warning."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return df.select(F.explode(found).alias("warning")).groupBy("warning").agg(F.count("*").alias("rows"))


def low_confidence_groups(df: DataFrame, key: str, confidence: str, limit: float = 0.4) -> DataFrame:
    """Groups whose mean confidence lies below the limit."""
    return df.groupBy(key).agg(F.count("*").alias("regions"), F.bround(F.avg(confidence), 6).alias("mean_confidence")).where(F.col("mean_confidence") < limit)
