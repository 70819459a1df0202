"""Distribution aggregates with the null rules of the audit (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distribution(col: Column | str, prefix: str = "", places: int = 10) -> list[Column]:
    """A1: count, mean, exact median, min, max and population SD over the values present.

    The median holds a group's distinct values in one task: for groups of bounded size (``profile.profile`` has none of that).

    Over no values all but the count are null; the SD of fewer than two is null, never 0.
    """
    col = F.col(col) if isinstance(col, str) else col
    n = F.count(col)
    return [
        n.alias(f"{prefix}n"),
        F.bround(F.avg(col), places).alias(f"{prefix}mean"),
        F.percentile(col, F.lit(0.5)).alias(f"{prefix}median"),
        F.min(col).alias(f"{prefix}min"),
        F.max(col).alias(f"{prefix}max"),
        F.when(n >= 2, F.bround(F.stddev_pop(col), places)).alias(f"{prefix}sd"),
    ]


def share(part: Column, whole: Column) -> Column:
    """A ratio that is null over nothing."""
    return part / F.nullif(whole, F.lit(0))
