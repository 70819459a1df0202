"""File scans, corpus documents, vocabularies and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def inventory(spark: SparkSession, path: str, *, digest_limit: int = 1 << 30) -> DataFrame:
    """(path, size, extension, kind, framework, sha256, status) of every file below ``path``.

    Two scans without a shuffle: files up to ``digest_limit`` bytes are read and hashed where they lie; of the
    others only the listing is read, whatever their size. The limit on ``length`` reaches both scans.
    Spark's file listings leave out empty files, so they have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small, length = F.col("length") <= digest_limit, F.col("length").alias("size")
    rows = files.where(small).select("path", length, F.sha2("content", 256).alias("sha256")).unionByName(files.where(~small).select("path", length, F.lit(None).cast("string").alias("sha256")))
    ext = T.extension(F.col("path"))
    rows = rows.select("path", "size", ext.alias("extension"), "sha256")
    return rows.withColumn("kind", T.file_kind(F.col("extension"))).withColumn("framework", T.framework(F.col("extension"))).withColumn("status", F.when(F.col("sha256").isNull(), "too_large_to_hash").otherwise("hashed"))


def inventory_summary(files: DataFrame) -> DataFrame:
    """Files and bytes of every extension."""
    return files.groupBy("extension", "kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def largest(files: DataFrame, n: int = 15) -> DataFrame:
    """The n largest files (a report)."""
    return files.orderBy(F.desc("size"), "path").limit(n)


def artifact_references(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``expected`` (path) with size and sha256; a missing file is named in ``error``."""
    return expected.join(files.select("path", "size", "sha256"), "path", "left").withColumn("error", F.when(F.col("size").isNull(), F.concat(F.lit("missing_artifact:"), F.col("path"))))


def read_corpus(spark: SparkSession, path: str, schema: str, *, multi_line: bool = True) -> DataFrame:
    """(source, manuscript columns, page struct): corpus documents with manuscripts[] and their pages[].

    A file is one document, or without ``multi_line`` a document a line, which Spark can split. A manuscript without pages has one row with a null page.
    """
    docs = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path).withColumn("source", F.col("_metadata.file_path"))
    rows = docs.select("source", "corpus_id", F.explode("manuscripts").alias("m"))
    return rows.select("source", "corpus_id", F.col("m.id").alias("manuscript_id"), F.col("m.split").alias("split"), F.explode_outer("m.pages").alias("page"))


def vocabulary(rows: DataFrame, *, notation: str, group_or_uuid: str, order: str) -> DataFrame:
    """Terms of a controlled vocabulary sheet, without header, blank and divider rows.

    A second column that starts with a hex UUID is the norm id, any other the code group; the group
    falls back to the notation's letter. Row numbers are kept.
    """
    n = F.trim(F.col(notation))
    kept = rows.where(n.isNotNull() & (n != "") & ~F.lower(n).isin("notation", "code", "id") & ~n.rlike(r"^[-=_*\s]+$"))
    second = F.trim(F.col(group_or_uuid))
    is_uuid = second.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-")
    return kept.select(F.col(order).alias("source_row"), n.alias("notation"), F.when(is_uuid, second).alias("norm_uuid"), F.coalesce(F.when(~is_uuid, F.nullif(second, F.lit(""))), T.code_group(n)).alias("code_group"))


def vocabulary_counts(terms: DataFrame, expected: DataFrame) -> DataFrame:
    """(code_group, expected, actual, status)."""
    n = terms.groupBy("code_group").agg(F.count("*").alias("n"))
    both = expected.join(n, "code_group", "full_outer")
    return both.select("code_group", "expected", F.coalesce("n", F.lit(0)).alias("actual"), F.when(F.col("expected").eqNullSafe(F.coalesce("n", F.lit(0))), "ok").otherwise("differs").alias("status"))


CATALOGUE_LABELS = {
    "century": ("Century",), "typeface_or_font": ("Typeface", "Font"), "document_type": ("Document Type",), "doi": ("DOI",), "dimensions": ("Dimensions", "Physical Dimensions"), "page_count": ("Number of Pages",),
    "place_of_origin": ("Place of Origin", "Place of Origin (English)", "Origin"), "online_since": ("Online Since",), "digitized_by": ("Digitized by",), "persons": ("Persons",), "summary": ("Summary", "Summary (English)"),
}


def catalogue(manuscripts: DataFrame) -> DataFrame:
    """The public record of every manuscript, 24 fields; of several sources of one manuscript the first counts (least ``source_order``).

    ``manuscripts``: manuscript_id, repository, shelfmark, title, date_display, date_not_before, date_not_after, date_method, language, script, material,
    metadata (array of label and value), manifest_url, metadata_source, source_order. Texts are without tags, and null if blank. A field that is read from
    the metadata is the first value, in the metadata's order, under any of its labels; the manuscript's own script and material go before those.
    Languages are all values of ``Text Language``, with the manuscript's own before them unless it is among them.
    """
    given = [c for c in manuscripts.columns if c not in ("manuscript_id", "source_order")]
    first = manuscripts.groupBy("manuscript_id").agg(F.min_by(F.struct(*given), "source_order").alias("m")).select("manuscript_id", "m.*")
    # All texts are made plain in one expression each, as a field is looked up under many labels.
    texts = ("repository", "shelfmark", "title", "date_display", "date_method", "language", "script", "material")
    own = F.transform(F.array(*[F.col(c).cast("string") for c in texts]), lambda x: T.plain_html(x))
    items = F.transform("metadata", lambda x: F.struct(F.lower(x["label"]).alias("label"), T.plain_html(x["value"]).alias("value")))
    clean = first.select("manuscript_id", "date_not_before", "date_not_after", "manifest_url", "metadata_source", own.alias("own"), items.alias("items"))
    named = {c: F.col("own")[i] for i, c in enumerate(texts)}

    def values(*labels: str) -> Column:
        held = F.filter("items", lambda x: x["label"].isin(*[name.lower() for name in labels]))
        return F.array_distinct(F.array_compact(F.transform(held, lambda x: x["value"])))

    found = lambda *labels: F.try_element_at(values(*labels), F.lit(1))
    languages = F.coalesce(values("Text Language"), F.array().cast("array<string>"))
    all_languages = F.when(named["language"].isNull() | F.array_contains(languages, named["language"]), languages).otherwise(F.array_prepend(languages, named["language"]))
    read = [found(*labels).alias(c) for c, labels in CATALOGUE_LABELS.items()]
    return clean.select(
        "manuscript_id", *[named[c].alias(c) for c in texts[:5]], "date_not_before", "date_not_after", all_languages.alias("languages"),
        F.coalesce(named["script"], found("Script", "Hand")).alias("script_or_hand"), F.coalesce(named["material"], found("Material")).alias("material"), *read, "manifest_url", "metadata_source",
    )


def match_samples(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Samples (sample_id) matched to files by their parent folder's name: found, ambiguous or missing."""
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    by = files.groupBy(parent.alias("sample_id")).agg(F.count("*").alias("n"), F.min("path").alias("local_path"))
    joined = samples.join(by, "sample_id", "left")
    return joined.select("sample_id", F.when(F.col("n") == 1, F.col("local_path")).alias("local_path"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("mapping_status"))


def export_regions(regions: DataFrame, run: str, confidence: str, tie: str) -> DataFrame:
    """One row for each run: its regions as an ordered array, best confidence first, nulls last."""
    entry = F.struct(F.coalesce(-F.col(confidence), F.lit(float("inf"))).alias("rank"), F.col(tie).alias("tie"), F.struct(*[c for c in regions.columns if c != run]).alias("region"))
    return regions.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["region"]).alias("regions"))


def last_of(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
