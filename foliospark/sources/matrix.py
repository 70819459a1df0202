"""The content by damage by severity decision matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Decisions and their cohorts; severity presets; damage ids with name, visual class and shape family.
COHORTS = {"do not generate": "excluded", "generate for general training": "general", "generate as edge case": "edge_case"}
AREA_PRESETS = {"S1": 0.025, "S2": 0.125, "S3": 0.35, "S4": 0.65}
DAMAGES = {
    "D2-01": ("Interior loss", "Absent", "internal_hole"),
    "D2-02": ("Straight edge loss", "Absent", "edge_loss"),
    "D2-03": ("Irregular edge loss", "Absent", "edge_tear"),
    "D2-04": ("Ink-following loss", "Absent", None),
    "D2-06": ("Surface coating", "Obscured", None),
    "D2-07": ("Adhesive tape", "Obscured", None),
    "D2-08": ("Discrete deposits", "Obscured", None),
    "D2-09": ("Staining / discolouration", "Obscured", None),
    "D2-10": ("Overwriting", "Obscured", None),
    "D2-11": ("Faded ink or pigment", "Degraded", None),
    "D2-12": ("Surface loss", "Degraded", None),
    "D2-13": ("Erasure", "Degraded", None),
    "D2-14": ("Offset / transfer", "Foreign signal", None),
    "D2-16": ("Corrosion haloes", "Foreign signal", None),
    "D2-17": ("Ink bleed", "Foreign signal", None),
    "D2-18": ("Folds and creases", "Distorted", None),
    "D2-19": ("Cockling / shrinkage", "Distorted", None),
}
KEYS = ["Content ID", "Content type", "Damage ID", "Damage type", "Visual class"]
LEVEL_FIELDS = {"decision": "decision", "note": "severity note", "example_url": "example (Fragmentarium)"}


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """S3: the wide matrix, cells trimmed, with ``source_row`` (the header is row 1) and ``issues``.

    Columns may come in any order and further ones are ignored. Missing columns, rows with too few
    or too many cells, an empty file and repeated (content, damage) keys are errors. Quoted cells may hold
    line breaks and doubled quotes.
    """
    wanted = [*KEYS, *[f"{s} {f}" for s in AREA_PRESETS for f in LEVEL_FIELDS.values()]]
    lines = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    header = [c.lstrip("﻿").strip() for c in lines.columns]
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"matrix lacks columns: {missing}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", `_bad` string"
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("multiLine", "true").option("escape", '"').option("columnNameOfCorruptRecord", "_bad").csv(path)
    # A matrix is one small file that a person keeps; its row numbers need its order, hence one partition.
    numbered = rows.coalesce(1).withColumn("source_row", F.monotonically_increasing_id() + 2)
    numbered = numbered.select("source_row", "_bad", *[F.trim(F.coalesce(f"`{c}`", F.lit(""))).alias(c) for c in wanted])
    if bad := numbered.where("_bad is not null").select("source_row", *KEYS[:1]).orderBy("source_row").limit(5).collect():
        raise ValueError(f"malformed rows: {[(r.source_row, r[KEYS[0]]) for r in bad]}")
    if not numbered.select("source_row", *KEYS).limit(1).collect():
        raise ValueError("empty matrix")
    twice = numbered.where("`Damage ID` != ''").groupBy("Content ID", "Damage ID").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated keys: {[(r['Content ID'], r['Damage ID']) for r in twice]}")
    return with_issues(numbered.drop("_bad"))


def with_issues(wide: DataFrame) -> DataFrame:
    """The row issues, and the shape family of the damage."""
    table = F.create_map(*[x for k, (name, cls, family) in DAMAGES.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(cls).alias("cls"), F.lit(family).cast("string").alias("family")))])
    own = F.try_element_at(table, F.col("Damage ID"))
    issues = F.array_compact(F.array(
        *[F.when(F.col(c) == "", F.lit(f"missing:{c}")) for c in KEYS],
        F.when((F.col("Damage ID") != "") & own.isNull(), "unknown_damage_id"),
        F.when(own.isNotNull() & ((own["name"] != F.col("Damage type")) | (own["cls"] != F.col("Visual class"))), "damage_taxonomy_conflict"),
    ))
    return wide.withColumn("family", own["family"]).withColumn("issues", issues)


def to_levels(wide: DataFrame) -> DataFrame:
    """One row for each (matrix row, severity): decision, cohort, note, example, and all issues."""
    level = lambda s: F.struct(F.lit(s).alias("severity"), *[F.col(f"{s} {f}").alias(n) for n, f in LEVEL_FIELDS.items()])
    names = {"Content ID": "content_id", "Content type": "content_type", "Damage ID": "damage_id", "Damage type": "damage_type", "Visual class": "visual_class"}
    long = wide.select("source_row", *[F.col(k).alias(v) for k, v in names.items()], "family", "issues", F.explode(F.array(*[level(s) for s in AREA_PRESETS])).alias("l")).select("*", "l.*").drop("l")
    cohort = F.try_element_at(F.create_map(*[F.lit(x) for p in COHORTS.items() for x in p]), F.col("decision"))
    more = F.array_compact(F.array(F.when(cohort.isNull(), "missing_or_unknown_decision"), F.when(F.col("note") == "", "missing_severity_note")))
    return long.withColumn("cohort", cohort).withColumn("level_issues", more)
