"""Tables as immutable folders behind one commit pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .merge import fingerprint


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits below ``path``, oldest first."""
    return [int(n.removesuffix(".json")) for n in _names(spark, f"{path}/commits") if n.endswith(".json")]


def load_commit(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/commits/{number:012d}.json").collect()))


def put_commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Publish commit ``number``: written beside the commits and renamed into place, which the file system does in one step. An existing number is an error."""
    fs, folder = _fs(spark, f"{path}/commits")
    fs.mkdirs(folder)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    made = jvm.org.apache.hadoop.fs.Path(f"{path}/pending-{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(made, target, gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


class VersionedTable:
    """A table whose versions are folders that never change; the newest commit says which one counts.

    A writer fills a new folder and then publishes its commit. A crash before that leaves the old version, after it the new one; folders without a commit are
    never read, and ``expire`` removes them. Of two writers that publish the same number one gets an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> dict | None:
        known = commits(self.spark, self.path)
        return load_commit(self.spark, self.path, known[-1]) | {"number": known[-1]} if known else None

    def read(self) -> DataFrame:
        last = self.latest()
        if last is None:
            raise FileNotFoundError(f"no version: {self.path}")
        return self.spark.read.parquet(f"{self.path}/{last['folder']}")

    def write(self, df: DataFrame, *, immutable: bool = False) -> bool:
        """Publish ``df`` if its rows or columns differ from the newest version, and say whether it was. S9: with ``immutable`` a difference is an error.

        The rows' digest (``fingerprint``) is compared with the one in the commit, so an unchanged rerun reads and writes nothing here.
        """
        last = self.latest()
        found = fingerprint(df).first()
        content = {"rows": found.rows, "rows_sha256": found.rows_sha256, "columns": sorted(df.columns)}
        if last is not None and all(last[k] == v for k, v in content.items()):
            return False
        if last is not None and immutable:
            raise ValueError(f"stored rows differ: {self.path}")
        content["folder"] = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{content['folder']}")
        put_commit(self.spark, self.path, last["number"] + 1 if last else 1, content)
        return True

    def expire(self, keep: int = 2) -> None:
        """Remove all but the newest ``keep`` commits, and every folder that none of those names. Not while a writer is at work."""
        known = commits(self.spark, self.path)
        stay = {load_commit(self.spark, self.path, n)["folder"] for n in known[-keep:]}
        for n in known[:-keep]:
            remove(self.spark, f"{self.path}/commits/{n:012d}.json")
        for name in _names(self.spark, self.path):
            if name.startswith(("version-", "pending-")) and name not in stay:
                remove(self.spark, f"{self.path}/{name}")
