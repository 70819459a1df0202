"""Recursive walks of JSON documents as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

# The relationship terms of the pairing audit.
PAIRING_TERMS = ("leaf_id", "physical_leaf_id", "paired_canvas_id", "opposite_side", "recto_canvas_id", "verso_canvas_id", "leaf_relationship", "recto_verso_pair")


def normal_key(key: Column) -> Column:
    """Lower-cased, ``-`` as ``_``."""
    return F.replace(F.lower(key), F.lit("-"), F.lit("_"))


def truthy(value: Column) -> Column:
    """False for null, false, numbers equal to 0, and empty strings, arrays and objects."""
    kind = F.schema_of_variant(value)
    empty = F.to_json(value).isin("null", "false", '""', "[]", "{}")
    number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    return ~empty & ~F.coalesce(number & (F.try_variant_get(value, "$", "double") == 0), F.lit(False))


def json_members(docs: DataFrame, ids: list[str], json_col: str) -> DataFrame:
    """(ids ..., path, key, value): every member of every object and array, at any depth.

    ``path`` is an array of keys and places from the root to the member, ``key`` null for array elements, ``value`` a VARIANT. Each round explodes
    the containers that the round before left and writes the members once; rounds end when no container is left, so there are as many as the
    deepest document has levels. Broken JSON and null have no members; documents of equal ids are walked each.
    """
    containers = docs.select(*ids, F.array().cast("array<string>").alias("path"), F.try_parse_json(json_col).alias("value"))
    levels = []
    while True:
        spark = docs.sparkSession
        carried = ", ".join(f"t.`{i}`" for i in ids)
        members = spark.sql(f"SELECT {carried}, concat(t.path, array(coalesce(e.key, cast(e.pos AS STRING)))) AS path, e.key AS key, e.value AS value FROM {{t}} t, LATERAL variant_explode(t.value) e", t=containers)
        members = staged(members)
        levels.append(members)
        kind = F.schema_of_variant("value")
        containers = members.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select(*ids, "path", "value")
        if containers.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, levels)


def term_members(members: DataFrame, terms: tuple[str, ...] = PAIRING_TERMS) -> DataFrame:
    """The members whose normalised key is one of ``terms`` and whose value is truthy, with ``term``; array places never count."""
    own = normal_key(F.col("key"))
    return members.where(own.isin(*terms) & truthy(F.col("value"))).withColumn("term", own)


def key_catalogue(members: DataFrame, ids: list[str]) -> DataFrame:
    """(key, members, documents): every object key as it stands, how often, and in how many documents."""
    named = members.where(F.col("key").isNotNull())
    per = named.groupBy("key", *ids).agg(F.count("*").alias("_n"))
    return per.groupBy("key").agg(F.sum("_n").alias("members"), F.count("*").alias("documents"))


def label_catalogue(members: DataFrame) -> DataFrame:
    """(label, items): the labels of the objects that any ``metadata`` array lists."""
    listed = (F.col("key") == "label") & (F.try_element_at("path", F.lit(-3)) == "metadata")
    return members.where(listed).groupBy(F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")).alias("label")).agg(F.count("*").alias("items"))
