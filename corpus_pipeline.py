"""The corpus pipeline: five stages, each one of the training-data operators, over all documents.

In every stage a null text is an empty one and keeps its null; rows with a null doc_id stay unless the stage's own rule drops their
text; repeated rows are each judged alike; an empty table stays empty; further columns of documents are carried along with their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, line_runs, packing, quality, simhash
from foliospark.llm.common import shared_dir, table
from foliospark.llm.tokens import default_tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. Empty texts are scored by their statistics; without labels every score is 0.5."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, least=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the one of largest doc_id; n_chars follows a text that changes. A text may become empty."""
    return line_runs.drop_repeated_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates stays, the one of smallest doc_id (all rows of that id, if it is repeated). Empty texts are one group."""
    return simhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go. Items without words occur nowhere."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# The classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = f"{shared_dir(spark)}-{name}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
