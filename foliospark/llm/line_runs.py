"""Exact line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, as_before, ascii_lower, named, plain_columns, shared_dir, stage


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of hash as a struct, so that different lines practically never share one."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Line hashes seen so far, as sorted runs in levels: (h1, h2, docs, last).

    A batch is merge-anti-joined with the runs. Hashes that none of them has become the batch's own run of level 0, so every
    hash lies in one run; hashes known already leave a row of increments (documents, largest
    id). When a level holds ``fanout`` runs they are merged into one run of the next level, so n batches leave about
    fanout * log(n) runs and rewrite a hash that often at most. All runs are bucketed tables with
    the same number of buckets by hash, sorted within, so neither joins nor merges move a row.
    """

    def __init__(self, spark, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.increments: list[DataFrame] = []
        self.written: list[str] = []

    def _write(self, run: DataFrame) -> str:
        path = shared_dir(self.spark)
        name = path.rpartition("/")[2].replace("-", "_")
        ready = run.select("h1", "h2", "docs", "last")
        ready.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd").option("path", path).saveAsTable(name)
        self.written.append(name)
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` (h1, h2, ...) that no run has: a merge anti-join with each run."""
        return reduce(lambda left, name: left.join(self.spark.table(name), ["h1", "h2"], "left_anti"), self.names(), hashes)

    def _merge(self, names: list[str]) -> str:
        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            one = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)  # noqa: E731 a hash is in one run only
            return left.alias("a").join(right.alias("b"), ["h1", "h2"], "full_outer").select("h1", "h2", one("docs"), one("last"))

        return self._write(reduce(both, map(self.spark.table, names)))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of rows (h1, h2, doc_id); no document may come in two batches."""
        once = batch.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        run = self._write(once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
        if self.names():
            own = self.spark.table(run)
            run = self._write(self.unseen(own))
            self.increments.append(stage(own.join(self.spark.table(run), ["h1", "h2"], "left_anti")))
        at = 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fanout:
                return
            run = self._merge(self.levels[at])
            self.levels[at] = []
            at += 1

    def totals(self, least: int = 1) -> DataFrame:
        """Every hash of at least ``least`` documents once, over all runs and increments."""
        empty = self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        more = reduce(DataFrame.unionByName, self.increments, empty)
        more = more.groupBy("h1", "h2").agg(F.sum("docs").alias("more"), F.max("last").alias("later"))
        docs, last = F.col("docs") + F.coalesce("more", F.lit(0)), F.greatest("last", "later")
        each = [self.spark.table(n).join(more, ["h1", "h2"], "left").select("h1", "h2", docs.alias("docs"), last.alias("last")).where(F.col("docs") >= least) for n in self.names()]
        return reduce(DataFrame.unionByName, each, empty)

    def drop(self) -> None:
        """Forget the tables; their files lie in the shared folder."""
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Drop lines that many documents share, except in one of them.

    Texts are split at newlines; a line's key is the line without white space at its ends, A-Z lowered.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the document with the largest id. Documents go in ``batches`` (by hash of
    the id) into ``LineRuns``; the runs' totals name the repeated keys, and a document is told the places of its lines to drop.

    Returns the columns ``keep`` (default: all; the text column rewritten) and n_lines long (before),
    n_dropped long. Columns of those names in ``docs``, in any case, give way to the results; other names never clash. A null or empty text is one empty line.
    Documents of equal id count as one; rows without id count as no document and lose no line. Repeated
    rows are each returned, alike; the largest id is one, so there are no ties; an empty table gives no rows. The places of its own lines are all that is gathered for
    a document, and dropping them takes time in proportion to its lines, so very long texts do no harm.
    """
    plain, names = plain_columns(docs)
    kept = docs.columns if keep is None else keep
    found = _deduped(plain, named(names, id_col), named(names, text_col), min_chars=min_chars, min_docs=min_docs, batches=batches, fanout=fanout)
    return as_before(found, names, kept, ("n_lines", "n_dropped"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """``dedup_lines`` with the caller's columns only, all values but the text's (and its length's, where lines went) as they were."""
    plain, names = plain_columns(docs)
    found = _deduped(plain, named(names, id_col), named(names, text_col), **options)
    size = named(names, length_col)
    if size:
        found = found.withColumn(size, F.when(F.col("n_dropped") > 0, F.char_length(named(names, text_col)).cast("long")).otherwise(F.col(size)))
    return as_before(found, names)


def _deduped(docs: DataFrame, id_col: str, text_col: str, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns (of ``common.plain_columns``), the text rewritten, n_lines and n_dropped."""
    digest = F.xxhash64(F.col(text_col))
    line = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.posexplode(lines_of(F.col(text_col))).alias("place", "line")).where(F.char_length("line") >= min_chars)
    keyed = line.select("doc_id", "digest", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashes = keyed.select("doc_id", "digest", "place", key_hash(F.col("key")).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    hashes = stage(hashes.select("doc_id", "digest", "place", "h.h1", "h.h2", "batch"), partition_by=["batch"])
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        for k in range(batches):
            runs.add(hashes.where(F.col("batch") == k))
        # Staged, so that both sides of the join are plain shuffles: Spark then splits a very common line's rows.
        repeated = stage(runs.totals(min_docs))
    finally:
        runs.drop()
    gone = hashes.join(repeated, ["h1", "h2"]).where("doc_id != last").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_set("place").alias("_gone"))
    own = docs.select(*[c for c in docs.columns if c != text_col], digest.alias("_own"), F.split(text_col, "\n", -1).alias("_lines"))
    joined = own.join(gone, (F.col(id_col) == F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    count = lambda c, none: F.when(F.col(c).isNull(), none).otherwise(F.size(c))
    size = count("_lines", 1)
    stay = F.array_except(F.sequence(F.lit(0), size - 1), "_gone")
    text = F.array_join(F.coalesce(F.transform(stay, lambda k: F.get("_lines", k)), F.col("_lines")), "\n")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], size.cast("long").alias("n_lines"), count("_gone", 0).cast("long").alias("n_dropped"))
