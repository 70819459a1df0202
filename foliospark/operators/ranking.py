"""Numbers and ranks over orders that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged

_PLACE_BITS = 33  # monotonically_increasing_id: the partition's number above 33 bits of the place in it


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """The rows with ``name``, their number from 1 in ``order``, which must be total.

    Rows are range-partitioned and sorted, written once, and each partition starts after the rows of those before it; only one count
    for each partition meets in one task.
    """
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, place = F.shiftright("_place", _PLACE_BITS), F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = placed.withColumn("_part", part).join(before, "_part")
    return own.withColumn(name, F.col("_before") + place + 1).drop("_part", "_place", "_before")


def _range_placed(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The rows range-partitioned by group and order, written once with the number of their range, so that a large group lies in many ranges."""
    return staged(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def ranks(df: DataFrame, by: list[str], order: list[Column | str], flags: dict[str, Column]) -> DataFrame:
    """The rows with, for each name, their rank (from 1) by ``order`` among those rows of their group for which the flag holds; null for the others.

    Two-level: rows are range-partitioned by group and order, ranked within their range, and shifted by the counts of
    the group's ranges before it. No task holds a group, however large; ``order`` must be total.
    """
    held = {n: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for n, c in flags.items()}
    placed = _range_placed(df.select("*", *[c.alias(f"_is_{n}") for n, c in held.items()]), by, order)
    upto = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(f"_is_{n}").over(upto).alias(f"_at_{n}") for n in flags])
    parts = placed.groupBy("_range", *by).agg(*[F.sum(f"_is_{n}").alias(f"_n_{n}") for n in flags])
    both = _shifted(local, parts, by, {f"_n_{n}": f"_before_{n}" for n in flags})
    drop = [f"{p}{n}" for n in flags for p in ("_is_", "_at_", "_before_")]
    out = both.select("*", *[F.when(F.col(f"_is_{n}") == 1, F.col(f"_before_{n}") + F.col(f"_at_{n}")).cast("int").alias(n) for n in flags])
    return out.drop("_range", *drop)


# A group of at most so many counts is sorted in one task; larger ones are spread over ranges.
GROUP_IN_TASK = 50_000


def counted_places(counted: DataFrame, by: list[str], in_task: int = GROUP_IN_TASK) -> DataFrame:
    """Counts of values (by ..., _value, _count; any number of rows a value; read more than once) with ``_first`` and ``_last``, the places their values
    take in the group's order, and over the whole group ``_n`` and ``_sum``, the number and the sum of its values. Nulls take no place.

    Groups of at most ``in_task`` counts are shuffled once, by group. The counts of larger ones are range-partitioned by group and value and
    written once, so places are found by adding up counts, and no task holds such a group's values.
    """
    counted = counted.select(*by, "_value", F.when(F.col("_value").isNotNull(), F.col("_count")).otherwise(0).alias("_count"))
    large = staged(counted.groupBy(*by).agg(F.count("*").alias("_counts")).where(F.col("_counts") > in_task).select(*[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], "_counts"))
    value = F.col("_count") * F.col("_value").cast("double")
    if large.isEmpty():
        return _places(counted, by, value)
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    placed = _range_placed(counted.join(large, on, "left_semi"), by, ["_value"])
    upto = Window.partitionBy("_range", *by).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_upto", F.sum("_count").over(upto))
    parts = placed.groupBy("_range", *by).agg(F.sum("_count").alias("_size"), F.sum(value).alias("_part"))
    both = _shifted(local, parts, by, {"_size": "_before"}, {"_size": "_n", "_part": "_sum"})
    last = F.col("_before") + F.col("_upto")
    spread = both.select(*by, "_value", "_count", (last - F.col("_count") + 1).alias("_first"), last.alias("_last"), "_n", "_sum")
    return _places(counted.join(large, on, "left_anti"), by, value).unionByName(spread) if by else spread


def _places(counted: DataFrame, by: list[str], value: Column) -> DataFrame:
    whole = Window.partitionBy(*[F.col(b) for b in by])
    last = F.sum("_count").over(whole.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = counted.select(*by, "_value", "_count", last.alias("_last"), F.sum("_count").over(whole).alias("_n"), F.sum(value).over(whole).alias("_sum"))
    return over.select(*by, "_value", "_count", (F.col("_last") - F.col("_count") + 1).alias("_first"), "_last", "_n", "_sum")


def at_places(fractions: list[float]) -> tuple[list[Column], list[Column]]:
    """For ``counted_places``: aggregates, and over them and ``n`` the quantiles with linear interpolation between neighbours (inclusive)."""
    aggregates, mixed = [], []
    for i, p in enumerate(fractions):
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, k in (("l", F.floor(at) + 1), ("h", F.ceil(at) + 1)):
            aggregates.append(F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_value"))).alias(f"_{side}{i}"))
        at = (F.col("n") - 1) * F.lit(float(p))
        mixed.append(F.when(F.floor(at) == F.ceil(at), F.col(f"_l{i}").cast("double")).otherwise((F.ceil(at) - at) * F.col(f"_l{i}") + (at - F.floor(at)) * F.col(f"_h{i}")))
    return aggregates, mixed


def exact_quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(by ..., n, q0, q1, ...): exact quantiles with linear interpolation between neighbours (inclusive), nulls left out.

    Equal values are counted first (``counted_places``).
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_count"))
    aggregates, mixed = at_places(fractions)
    found = counted_places(staged(counted), by).groupBy(*by).agg(F.max("_n").alias("n"), *aggregates)
    return found.where("n is not null").select(*by, "n", *[q.alias(f"q{i}") for i, q in enumerate(mixed)])


def _shifted(rows: DataFrame, parts: DataFrame, by: list[str], before: dict[str, str], total: dict[str, str] | None = None) -> DataFrame:
    """The rows with sums over their group's ranges before their own (``before``: from, to) and over all its ranges (``total``).

    ``parts`` has a row for each group and range it touches, so a window holds one row for each range of a group.
    """
    own = Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy()
    ahead = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(a).over(ahead), F.lit(0)).alias(b) for a, b in before.items()] + [F.sum(a).over(own).alias(b) for a, b in (total or {}).items()]
    parts = parts.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], *sums)
    on = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    return rows.join(parts, on).drop("_r", *[f"_by_{i}" for i in range(len(by))])
