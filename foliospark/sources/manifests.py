"""IIIF v2 and v3 manifests as relational tables."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(source, raw, doc): one row for each file below ``path``; doc is null where the JSON is malformed."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse(files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw")))


def parse(rows: DataFrame) -> DataFrame:
    """Rows (source, raw) with ``doc``, a VARIANT."""
    return rows.withColumn("doc", F.try_parse_json("raw"))


def quarantine(manifests: DataFrame) -> DataFrame:
    """Malformed files, and documents of no known kind, with the reason."""
    kind = manifest_version(F.col("doc"))
    reason = F.when(F.col("doc").isNull(), "malformed_json").when(kind.isNull(), "unrecognized_manifest")
    return manifests.select("source", reason.alias("reason")).where("reason is not null")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """The schema of a value as text: OBJECT<…>, ARRAY<…>, STRING, BIGINT …"""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("ARRAY"), F.lit(False))


def items(v: Column) -> Column:
    """The elements of an array value; none of any other."""
    return F.coalesce(F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def _readers():
    """Arrow functions over JSON texts. They are made here, so that workers get them whole and need not import this package."""

    def parts(value) -> list[str]:
        if isinstance(value, list):
            return [p for v in value for p in parts(v) if p]
        if isinstance(value, dict):
            plain = not isinstance(value.get("value"), (list, dict))
            chosen = [k for k in ("@value", "value", "none", "en") if k in value and (k != "value" or plain)]
            return parts(value[chosen[0]]) if chosen else next((p for p in map(parts, value.values()) if any(p)), [])
        return [] if value is None else [str(value)]

    def readable(value) -> str | None:
        found = parts(value)
        return "; ".join(found) if found else None

    def each(raw: pd.Series, read) -> pd.Series:
        # Containers nest as deep as the JSON parser lets them, which is deeper than Python's frames do.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10000))
        return pd.Series([None if r is None else read(json.loads(r)) for r in raw], dtype=object)

    def one(raw: pd.Series) -> pd.Series:
        return each(raw, readable)

    def labelled(raw: pd.Series) -> pd.Series:
        def read(found):
            pairs = [{"label": readable(m.get("label")), "value": readable(m.get("value"))} for m in found if isinstance(m, dict)]
            return [p for p in pairs if p["label"] or p["value"]]

        return each(raw, read)

    text = StringType()
    return F.pandas_udf(one, text), F.pandas_udf(labelled, ArrayType(StructType().add("label", text).add("value", text)))


_one_text, _label_texts = _readers()


def text_value(v: Column) -> Column:
    """Readable text of a multilingual container, however deep it nests.

    A string or number is itself; a list is its filled parts, joined by "; "; an object gives its @value, a
    scalar value, none, en, or its first filled member (in the order of names, as VARIANT has no other); null without any.
    Recursion has no column form, so what is no string goes through an Arrow function.
    """
    plain = kind_of(v) == "STRING"
    return F.when(plain, F.try_variant_get(v, "$", "string")).otherwise(_one_text(F.when(~plain, F.to_json(v))))


def identifier(v: Column) -> Column:
    """P5: id, else @id; an empty one counts as absent."""
    return F.coalesce(F.nullif(get(v, "$.id"), F.lit("")), F.nullif(get(v, '$["@id"]'), F.lit("")))


def type_of(v: Column) -> Column:
    return F.coalesce(F.nullif(get(v, "$.type"), F.lit("")), F.nullif(get(v, '$["@type"]'), F.lit("")))


def integer(v: Column, path: str) -> Column:
    """P5: null for what is no number."""
    return get(v, path, "int")


def service(v: Column) -> Column:
    """P5: the address of the first service."""
    s = F.try_variant_get(v, "$.service", "variant")
    first = F.when(is_array(s), F.try_variant_get(s, "$[0]", "variant")).otherwise(s)
    return F.when(is_object(first), identifier(first)).otherwise(F.try_variant_get(first, "$", "string"))


def manifest_version(doc: Column) -> Column:
    """2, 3 or null."""
    kind = F.lower(F.coalesce(type_of(doc), F.lit("")))
    has = lambda name: F.try_variant_get(doc, f"$.{name}", "variant").isNotNull()
    return F.when(kind == "manifest", 3).when((kind == "sc:manifest") | has("sequences"), 2).when(has("items"), 3)


def metadata_of(doc: Column) -> Column:
    """array<struct<label, value>>, without items that have neither."""
    raw = F.try_variant_get(doc, "$.metadata", "variant")
    return F.coalesce(_label_texts(F.when(is_array(raw), F.to_json(raw))), F.array().cast("array<struct<label:string,value:string>>"))


def manifests_table(manifests: DataFrame) -> DataFrame:
    """One row for each recognised manifest, with its mapped fields (P13) and rights policy."""
    doc = F.col("doc")
    rights = F.when(F.col("version") == 2, get(doc, "$.license")).otherwise(get(doc, "$.rights"))
    provider = F.try_variant_get(doc, "$.provider", "variant")
    first_provider = F.when(is_array(provider), F.try_variant_get(provider, "$[0]", "variant")).otherwise(provider)
    attribution = F.when(F.col("version") == 2, text_value(F.try_variant_get(doc, "$.attribution", "variant"))).otherwise(
        F.coalesce(F.nullif(text_value(F.try_variant_get(doc, "$.requiredStatement.value", "variant")), F.lit("")), text_value(F.try_variant_get(first_provider, "$.label", "variant")))
    )
    base = manifests.withColumn("version", manifest_version(doc)).where("version is not null")
    base = base.select("source", "version", "doc", identifier(doc).alias("manifest_id"), text_value(F.try_variant_get(doc, "$.label", "variant")).alias("label"), metadata_of(doc).alias("metadata"), rights.alias("rights"), attribution.alias("attribution"))
    return base.withColumn("policy", T.rights_policy(F.col("rights")))


def standard_fields(table: DataFrame) -> DataFrame:
    """The standard fields of each manifest, from its metadata."""
    m = F.col("metadata")
    find = lambda *names: T.metadata_lookup(m, list(names))
    place = F.nullif(F.array_join(F.array_compact(F.array(F.nullif(find("location", "settlement"), F.lit("")), F.nullif(find("collection name", "repository", "holding institution"), F.lit("")))), ", "), F.lit(""))
    return table.select(
        "source", "manifest_id", F.coalesce(place, F.lit("unknown repository")).alias("repository"), find("shelfmark", "signatur", "call number").alias("shelfmark"),
        F.coalesce(F.nullif(find("title"), F.lit("")), "label").alias("title"), T.date_range(find("date", "origdate", "origin date")).alias("date"),
        F.coalesce(find("text language"), find("language")).alias("language"), T.closed(find("status"), T.OBJECT_STATES).alias("object_status"),
        T.category(find("form", "object type", "object form"), T.OBJECT_FORMS).alias("object_form"), T.categories(find("material", "support"), T.MATERIALS).alias("material_type"),
        find("place", "origin", "provenance").alias("place"), find("script", "script type").alias("script"), T.yes_no(find("decoration")).alias("decoration"), T.yes_no(find("musicnotation", "music notation")).alias("music_notation"),
    )


def canvases_table(manifests: DataFrame) -> DataFrame:
    """(source, canvas_id, label, width, height, sequence_index, images) in order.

    v2 takes the first sequence. Elements that are no objects are passed over but keep their number.
    """
    doc = F.col("doc")
    raw = F.when(F.col("version") == 2, items(F.try_variant_get(doc, "$.sequences[0].canvases", "variant"))).otherwise(items(F.try_variant_get(doc, "$.items", "variant")))
    rows = manifests.withColumn("version", manifest_version(doc)).where("version is not null")
    rows = rows.select("source", "version", F.posexplode(raw).alias("sequence_index", "canvas")).where(is_object(F.col("canvas")))
    c = F.col("canvas")
    v2 = F.filter(F.transform(F.filter(items(F.try_variant_get(c, "$.images", "variant")), is_object), lambda a: F.try_variant_get(a, "$.resource", "variant")), is_object)
    notes = F.flatten(F.transform(F.filter(items(F.try_variant_get(c, "$.items", "variant")), is_object), lambda p: F.filter(items(F.try_variant_get(p, "$.items", "variant")), is_object)))
    bodies = F.flatten(F.transform(notes, lambda a: F.when(is_array(F.try_variant_get(a, "$.body", "variant")), items(F.try_variant_get(a, "$.body", "variant"))).otherwise(F.array(F.try_variant_get(a, "$.body", "variant")))))
    v3 = F.filter(F.filter(bodies, is_object), lambda b: F.coalesce(F.lower(type_of(b)).isin("image", "dctypes:image"), F.lit(True)))
    shape = lambda i: F.struct(identifier(i).alias("source_url"), service(i).alias("service_url"), get(i, "$.format").alias("media_type"), integer(i, "$.width").alias("width"), integer(i, "$.height").alias("height"))
    name = F.concat(F.lit("unknown-v"), F.col("version").cast("string"), F.lit("-canvas-"), F.col("sequence_index").cast("string"))
    return rows.select(
        "source", F.coalesce(identifier(c), name).alias("canvas_id"), text_value(F.try_variant_get(c, "$.label", "variant")).alias("label"), integer(c, "$.width").alias("width"), integer(c, "$.height").alias("height"),
        "sequence_index", F.transform(F.when(F.col("version") == 2, v2).otherwise(v3), shape).alias("images"),
    )


def images_table(canvases: DataFrame) -> DataFrame:
    """One row for each image of a canvas."""
    return canvases.select("source", "canvas_id", F.posexplode("images").alias("image_index", "i")).select("source", "canvas_id", "image_index", "i.*")
