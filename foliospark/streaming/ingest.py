"""Incremental, idempotent ingest (T1): a file stream merged batch by batch into a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import Policy, merge
from ..operators.versions import commits, load_commit, put_commit, remove


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot that the newest commit below ``path`` names; empty before the first batch."""
    known = commits(spark, path)
    return _read(spark, path, load_commit(spark, path, known[-1])["buckets"] if known else {}, schema)


def _read(spark: SparkSession, path: str, folders: dict[str, str], schema: str) -> DataFrame:
    paths = [f"{path}/{folder}" for folder in sorted(folders.values())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, *, schema: str, keys: list[str], order: str, policy: Policy = Policy(), files_per_batch: int = 1000, buckets: int = 64, keep: int = 2):
    """Read what has newly landed, keep each key's last row by ``order``, and merge it.

    Runs until all files seen at its start are merged (availableNow). The snapshot lies in ``buckets`` by hash of the keys, and a commit names each
    bucket's folder. A batch merges and rewrites the buckets that its own rows fall in; the others keep their folders, so what is written follows
    the batch. Its commit is published last and names stream and batch, so a batch that is repeated after a failure changes nothing twice.
    Folders that none of the last ``keep`` commits names are removed. ``buckets`` must stay the same for a snapshot's life. Returns the ended query.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = commits(session, target)
        last = load_commit(session, target, known[-1]) if known else {"buckets": {}}
        if last.get("batch") == batch_id and last["stream"] == checkpoint:
            return  # published before the failure
        old, number = last["buckets"], known[-1] + 1 if known else 1
        newest = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in sorted(batch.columns) if c != order])
        rows = batch.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
        touched = [str(r.b) for r in batch.select(_bucket(keys, buckets).alias("b")).distinct().collect()]  # at most ``buckets``
        before = _read(session, target, {b: old[b] for b in touched if b in old}, schema)
        merged = merge(before, rows, keys, policy).drop("action")
        folder = f"merge-{number:012d}"
        merged.repartition(len(touched) or 1, _bucket(keys, buckets)).withColumn("_bucket", _bucket(keys, buckets)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/{folder}")
        put_commit(session, target, number, {"stream": checkpoint, "batch": batch_id, "buckets": old | {b: f"{folder}/_bucket={b}" for b in touched}})
        _expire(session, target, keep)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _expire(spark: SparkSession, target: str, keep: int) -> None:
    """Remove commits before the last ``keep``, and the bucket folders that only they name."""
    known = commits(spark, target)
    gone, stay = known[:-keep], known[-keep:]
    used = {f for n in stay for f in load_commit(spark, target, n)["buckets"].values()}
    for n in gone:
        for folder in set(load_commit(spark, target, n)["buckets"].values()) - used:
            remove(spark, f"{target}/{folder}")
        remove(spark, f"{target}/commits/{n:012d}.json")
