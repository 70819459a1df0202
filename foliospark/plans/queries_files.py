"""Queries over files: suppliers, orders and nations are landed in the shared folder, then scanned as found files are."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_folder
from ..sources import files, matrix
from .base import query, table

DIGEST_LIMIT = 40  # bytes; some of the landed files are longer
FILES_A_TASK = 400


def _landing(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/landed-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def land_suppliers(spark, sf_dir) -> str:
    """A folder for each supplier: even ones hold a JSON record, odd ones and every tenth a note.

    The table is small and its files are many, so the tasks are counted by files: Spark's own split, by bytes, is one task.
    """
    rows, path = table(spark, sf_dir, "supplier"), _landing(spark)
    rows = rows.repartition(max(1, math.ceil(rows.count() / FILES_A_TASK)), "s_suppkey")
    key = F.col("s_suppkey")
    note = F.concat("s_name", F.lit(" "), F.repeat(F.lit("x"), (key % 40).cast("int")))
    rows.where(key % 2 == 0).select(key.alias("supplier"), "s_name").write.partitionBy("supplier").json(path)
    rows.where((key % 2 == 1) | (key % 10 == 0)).select(key.alias("supplier"), note.alias("value")).write.mode("append").partitionBy("supplier").text(path)
    return path


_LANDED = f"""f AS (SELECT s_suppkey AS supplier, 'json' AS extension, 'data' AS kind, '{{"s_name":"' || s_name || '"}}' || chr(10) AS content FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT s_suppkey, 'txt', 'other', s_name || ' ' || repeat('x', s_suppkey % 40) || chr(10) FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 10 = 0),
 inventory AS (SELECT supplier, extension, kind, CAST(strlen(content) AS BIGINT) AS size, CASE WHEN strlen(content) <= {DIGEST_LIMIT} THEN sha256(content) END AS sha256 FROM f)"""


def _inventory(spark, sf_dir):
    found = files.inventory(spark, land_suppliers(spark, sf_dir), digest_limit=DIGEST_LIMIT)
    return found.withColumn("supplier", F.regexp_extract("path", r"supplier=(\d+)/[^/]+$", 1).cast("long"))


@query(f"WITH {_LANDED} SELECT supplier, extension, kind, size, sha256, CASE WHEN sha256 IS NULL THEN 'too_large_to_hash' ELSE 'hashed' END AS status FROM inventory")
def file_inventory(spark, sf_dir):
    """Sizes from the listing alone, digests of the files within the limit."""
    return _inventory(spark, sf_dir).select("supplier", "extension", "kind", "size", "sha256", "status")


@query(f"WITH {_LANDED} SELECT extension, kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM inventory GROUP BY ALL")
def file_inventory_summary(spark, sf_dir):
    return files.inventory_summary(_inventory(spark, sf_dir))


_EXPECTED = "SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 7 = 0 THEN 'lost' WHEN s_suppkey % 2 = 0 THEN 'json' ELSE 'txt' END AS extension FROM supplier"


@query(f"""WITH {_LANDED} SELECT x.supplier || '.' || x.extension AS path, size, sha256, CASE WHEN size IS NULL THEN 'missing_artifact:' || x.supplier || '.' || x.extension END AS error
 FROM ({_EXPECTED}) x LEFT JOIN inventory i ON i.supplier = x.supplier AND i.extension = x.extension""")
def artifact_references(spark, sf_dir):
    """Every seventh supplier's artifact was never written."""
    key = F.col("s_suppkey")
    name = lambda supplier, extension: F.concat(supplier.cast("string"), F.lit("."), extension)
    expected = table(spark, sf_dir, "supplier").select(name(key, F.when(key % 7 == 0, "lost").when(key % 2 == 0, "json").otherwise("txt")).alias("path"))
    found = _inventory(spark, sf_dir).withColumn("path", name(F.col("supplier"), F.col("extension")))
    return files.artifact_references(expected, found).select("path", "size", "sha256", "error")


@query("""WITH s AS (SELECT unnest([s_suppkey, -1 - s_suppkey]) AS k FROM supplier) SELECT 'supplier=' || k AS sample_id, CASE WHEN k < 0 THEN 'missing' WHEN k % 10 = 0 THEN 'ambiguous' ELSE 'found' END AS mapping_status,
 CASE WHEN k < 0 OR k % 10 = 0 THEN NULL WHEN k % 2 = 0 THEN 'json' ELSE 'txt' END AS extension FROM s""")
def sample_mapping(spark, sf_dir):
    """Samples and the one file in the folder of their name."""
    key = F.col("s_suppkey")
    samples = table(spark, sf_dir, "supplier").select(F.explode(F.array(key, -1 - key)).alias("k")).select(F.concat(F.lit("supplier="), F.col("k").cast("string")).alias("sample_id"))
    return files.match_samples(samples, _inventory(spark, sf_dir)).select("sample_id", "mapping_status", T.extension(F.col("local_path")).alias("extension"))


_NAME = "CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '_' || p_partkey || '_r.png' ELSE p_name || ' ' || p_type || '!' || p_brand END"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '_' || p_partkey
 ELSE coalesce(nullif(substr(trim(regexp_replace({_NAME}, '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 1, 24), ''), 'asset') END AS page FROM part""")
def page_names(spark, sf_dir):
    """The pages that file names stand for."""
    key = F.col("p_partkey")
    name = F.when(key % 3 == 0, F.concat(F.char(65 + key % 26), F.lit("_"), key.cast("string"), F.lit("_r.png"))).otherwise(F.concat("p_name", F.lit(" "), "p_type", F.lit("!"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.page_of_file(name).alias("page"))


_CORPUS = "corpus_id string, manuscripts array<struct<id: string, split: string, pages: array<struct<page_id: string, position: long>>>>"


@query("""WITH m AS (SELECT o_orderkey AS k, unnest(['a', 'b']) AS side FROM orders)
 SELECT 'corpus-' || k % 100 AS corpus_id, 'm' || k || side AS manuscript_id, CASE side WHEN 'a' THEN 'train' ELSE 'test' END AS split, k || '-' || p AS page_id, p AS position
 FROM m LEFT JOIN range(1, 4) r(p) ON side = 'a' AND p <= k % 4""")
def corpus_documents(spark, sf_dir):
    """An order is a corpus document of two manuscripts, one with up to three pages, one without any."""
    key, path = F.col("o_orderkey"), _landing(spark)
    text = key.cast("string")
    pages = F.transform(F.filter(F.array(*[F.lit(p).cast("long") for p in (1, 2, 3)]), lambda p: p <= key % 4), lambda p: F.struct(F.concat(text, F.lit("-"), p.cast("string")).alias("page_id"), p.alias("position")))
    side = lambda name, split, own: F.struct(F.concat(F.lit("m"), text, F.lit(name)).alias("id"), F.lit(split).alias("split"), own.alias("pages"))
    docs = table(spark, sf_dir, "orders").select(F.concat(F.lit("corpus-"), (key % 100).cast("string")).alias("corpus_id"), F.array(side("a", "train", pages), side("b", "test", F.slice(pages, 1, 0))).alias("manuscripts"))
    docs.write.json(path)
    rows = files.read_corpus(spark, path, _CORPUS, multi_line=False)
    return rows.select("corpus_id", "manuscript_id", "split", "page.page_id", "page.position")


_DAMAGES = ", ".join(f"({i}, '{k}', '{n}', '{c}', {'NULL' if f is None else repr(f)})" for i, (k, (n, c, f)) in enumerate(matrix.DAMAGES.items()))
_DECISIONS = [*matrix.COHORTS, "?"]


@query(f"""WITH d(i, id, name, cls, family) AS (VALUES {_DAMAGES}),
 m AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey, i) + 1 AS BIGINT) AS source_row, n_nationkey + i AS n, n_name AS content_id, id AS damage_id, CASE WHEN n_nationkey % 5 = 0 THEN 'Other' ELSE name END AS damage_type, name, family FROM nation, d),
 l AS (SELECT m.*, 'S' || s AS severity, list_extract({_DECISIONS}, CAST((n + s) % 4 AS INTEGER) + 1) AS decision, CASE WHEN (n + s) % 7 = 0 THEN '' ELSE 'says "' || n || '",' || chr(10) || 'twice' END AS note FROM m, (VALUES (1), (2), (3), (4)) v(s))
 SELECT source_row, content_id, damage_id, damage_type, severity, decision, note, family, CASE decision WHEN 'do not generate' THEN 'excluded' WHEN 'generate for general training' THEN 'general' WHEN 'generate as edge case' THEN 'edge_case' END AS cohort,
  CASE WHEN damage_type <> name THEN 'damage_taxonomy_conflict' ELSE '' END AS issues FROM l""")
def matrix_import(spark, sf_dir):
    """S3: a matrix of nations by damages as people keep it: a BOM, other column order, a further column, blanks, quotes and line breaks in cells."""
    damage = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("id"), F.lit(n).alias("name"), F.lit(c).alias("cls")) for i, (k, (n, c, _)) in enumerate(matrix.DAMAGES.items())]))
    rows = table(spark, sf_dir, "nation").withColumn("d", damage).withColumn("n", F.col("n_nationkey") + F.col("d.i"))
    levels = []
    for s in range(4, 0, -1):
        note = F.when((F.col("n") + s) % 7 == 0, "").otherwise(F.concat(F.lit('  says "'), F.col("n").cast("string"), F.lit('",\ntwice ')))
        levels += [note.alias(f"S{s} severity note"), F.element_at(F.array(*map(F.lit, _DECISIONS)), ((F.col("n") + s) % 4 + 1).cast("int")).alias(f"S{s} decision"), F.lit("").alias(f"S{s} example (Fragmentarium)")]
    wide = rows.orderBy("n_nationkey", "d.i").select(
        F.col("d.cls").alias("﻿Visual class"), *levels, F.col("n_name").alias("Content ID"), F.lit(" text ").alias("Content type"), F.col("d.id").alias("Damage ID"),
        F.when(F.col("n_nationkey") % 5 == 0, "Other").otherwise(F.col("d.name")).alias("Damage type"), F.lit("ours").alias("Remarks"),
    )
    path = _landing(spark)
    wide.coalesce(1).write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    long = matrix.to_levels(matrix.read_matrix(spark, path))
    return long.select("source_row", "content_id", "damage_id", "damage_type", "severity", "decision", "note", "family", "cohort", F.array_join("issues", ",").alias("issues"))


@query("""WITH s AS (SELECT 'doc-' || doc_id % 400 AS manuscript_id, doc_id AS source_order, nullif(trim(source), '') AS repository, lang, n_chars, CASE WHEN doc_id % 5 = 0 THEN 'Carolingian' END AS script FROM documents),
 f AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY source_order) AS r FROM s)
 SELECT manuscript_id, repository, 'MS ' || source_order AS shelfmark, CAST(NULL AS VARCHAR) AS title, 'about ' || n_chars AS date_display, n_chars AS date_not_before, n_chars + 10 AS date_not_after, CAST(NULL AS VARCHAR) AS date_method, 'c. ' || n_chars AS century,
 concat_ws('|', CASE WHEN coalesce(lang, 'Latin') NOT IN ('Latin', 'en') THEN lang END, 'Latin', 'en') AS languages, coalesce(script, 'hand of ' || repository) AS script_or_hand, 'Roman' AS typeface_or_font, 'Parchment & ink' AS material, CAST(NULL AS VARCHAR) AS document_type,
 '10.1/' || source_order AS doi, CAST(n_chars AS VARCHAR) || ' mm' AS dimensions, CAST(n_chars AS VARCHAR) AS page_count, repository AS place_of_origin, CAST(NULL AS VARCHAR) AS online_since, repository AS digitized_by, CAST(NULL AS VARCHAR) AS persons, 'A text of ' || n_chars AS summary,
 'https://example.org/' || source_order AS manifest_url, 'documents' AS metadata_source FROM f WHERE r = 1""")
def public_catalogue(spark, sf_dir):
    """Documents are the sources' records of 400 manuscripts; the first record of each counts."""
    d, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    repository = F.nullif(F.trim("source"), F.lit(""))
    item = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    metadata = F.array(
        item("CENTURY", F.concat(F.lit("<b>c. "), n, F.lit("</b>"))), item("Text Language", F.lit("Latin")), item("text language", F.lit("en")), item("Text Language", F.lit(" Latin ")), item("Hand", F.concat(F.lit("hand of "), repository)), item("Font", F.lit("Roman")), item("Typeface", F.lit("Gothic")),
        item("Material", F.lit("Parchment &amp; ink")), item("Material note", F.lit("thin")), item("DOI", F.concat(F.lit("10.1/"), d)), item("Physical Dimensions", F.concat(n, F.lit(" mm"))), item("Number of Pages", n), item("Origin", repository), item("Digitized by", repository),
        item("Persons", F.lit("<i> </i>")), item("Summary (English)", F.concat(F.lit("A text of "), n)),
    )
    sources = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), (F.col("doc_id") % 400).cast("string")).alias("manuscript_id"), F.col("doc_id").alias("source_order"), "source", repository.alias("repository"), F.concat(F.lit("<span>MS "), d, F.lit("</span>")).alias("shelfmark"), F.lit(" ").alias("title"),
        F.concat(F.lit("about "), n).alias("date_display"), F.col("n_chars").alias("date_not_before"), (F.col("n_chars") + 10).alias("date_not_after"), F.lit(None).cast("string").alias("date_method"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 5 == 0, "Carolingian").alias("script"),
        F.lit("").alias("material"), metadata.alias("metadata"), F.concat(F.lit("https://example.org/"), d).alias("manifest_url"), F.lit("documents").alias("metadata_source"),
    )
    return files.catalogue(sources).withColumn("languages", F.array_join("languages", "|"))
