"""Registration of queries beside the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if there is one."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame, each: int) -> int:
    """How many tasks hold about ``each`` rows."""
    return max(1, math.ceil(rows.count() / each))


def tree_sql(rows: str, leaf: int) -> str:
    """CTEs that end in ``tree`` (k, rows, rows_sha256): the hash tree over ``rows`` (k, d), two levels deep, which holds 256 leaves."""
    listed = "sha256(string_agg(e, '' ORDER BY d))"
    return f"""e AS (SELECT k, d, d || ':' || count(*) AS e, count(*) AS c FROM ({rows}) GROUP BY k, d),
 n2 AS (SELECT k, substr(d, 1, 2) AS p, {listed} AS h FROM e GROUP BY ALL),
 n1 AS (SELECT k, substr(d, 1, 1) AS p, CASE WHEN count(*) <= {leaf} THEN {listed} END AS h FROM e GROUP BY ALL),
 m1 AS (SELECT n1.k, n1.p, coalesce(any_value(n1.h), sha256(string_agg(n2.h, '' ORDER BY n2.p))) AS h FROM n1 JOIN n2 ON n2.k = n1.k AND substr(n2.p, 1, 1) = n1.p GROUP BY n1.k, n1.p),
 n0 AS (SELECT k, sum(c) AS rows, CASE WHEN count(*) <= {leaf} THEN {listed} END AS h FROM e GROUP BY k),
 tree AS (SELECT n0.k, CAST(any_value(n0.rows) AS BIGINT) AS rows, coalesce(any_value(n0.h), sha256(string_agg(m1.h, '' ORDER BY m1.p))) AS rows_sha256 FROM n0 JOIN m1 ON m1.k = n0.k GROUP BY n0.k)"""
