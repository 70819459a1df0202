"""Helpers that several training-data operators share."""

from __future__ import annotations

import string
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

FOLD_FROM, FOLD_TO = string.ascii_uppercase, string.ascii_lowercase
# White space as the line and word contracts name it: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, FOLD_FROM, FOLD_TO)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Python workers also learn where this package lies, for sessions started elsewhere."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns in_0, in_1, ..., and the new name of each old one: no column of a caller can clash with one of an operator's own then, in any case."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(names: dict[str, str], wanted: str) -> str | None:
    """The new name of a column, whatever the case, or null."""
    return names.get(wanted) or next((n for c, n in names.items() if c.lower() == wanted.lower()), None)


def as_before(df: DataFrame, names: dict[str, str], keep: list[str] | None = None, results: tuple[str, ...] = ()) -> DataFrame:
    """The caller's columns (``keep``: which; default all) under their names, then ``results``, which stand for columns of the same name in any case."""
    taken = {r.lower() for r in results}
    own = [F.col(named(names, c)).alias(c) for c in (names if keep is None else keep) if c.lower() not in taken]
    return df.select(*own, *results)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``. All folders of an application
    lie in one folder named after it, to be removed when the application's results are written."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}/run_{uuid.uuid4().hex}"


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than the tasks that read from it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
