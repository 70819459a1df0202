"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, made ready for checkpoint().

    A local session without that setting gets a temporary folder of its own; on a cluster it is an error.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here, and a lost executor costs the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
