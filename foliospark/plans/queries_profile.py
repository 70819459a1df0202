"""Profile and audit queries. An order stands for a run, its lines for the regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statistics import share
from ..operators import profile, reconcile
from ..sources import files
from .base import query, table

SPLITS = ["N", "A", "R"]
_DIST = "count({0}) AS n, round_even(avg({0}), 10) AS mean, quantile_cont({0}, 0.5) AS median, min({0}) AS min, max({0}) AS max, CASE WHEN count({0}) >= 2 THEN round_even(stddev_pop({0}), 10) END AS sd"


def regions(spark, sf_dir):
    """Lines as regions: run_id, label, confidence, area, split."""
    line = table(spark, sf_dir, "lineitem")
    label = F.concat("l_returnflag", "l_linestatus")
    return line.select(F.col("l_orderkey").alias("run_id"), label.alias("label"), F.round(F.least(F.lit(1.0), F.col("l_discount") * 10), 6).alias("confidence"), F.col("l_quantity").cast("long").alias("area"), F.col("l_returnflag").alias("split"), "l_linenumber", "l_partkey", "l_suppkey")


REGIONS = "SELECT l_orderkey AS run_id, l_returnflag || l_linestatus AS label, round(least(1.0, l_discount * 10), 6) AS confidence, CAST(l_quantity AS BIGINT) AS area, l_returnflag AS split, l_linenumber, l_partkey, l_suppkey FROM lineitem"


@query(f"SELECT source, lang, {_DIST.format('n_chars')} FROM documents GROUP BY source, lang")
def distribution_by_group(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")


@query(f"WITH r AS ({REGIONS}) SELECT label, count(*) AS n, round_even(avg(confidence), 6) AS mean, quantile_cont(confidence, 0.5) AS median, min(confidence) AS min, max(confidence) AS max, CASE WHEN count(*) >= 2 THEN round_even(stddev_pop(confidence), 6) END AS sd FROM r GROUP BY label")
def confidence_summary(spark, sf_dir):
    return profile.profile(regions(spark, sf_dir), ["label"], "confidence", places=6)


@query("""WITH j AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT count(*) AS n FROM j)
 SELECT field, present, n - present AS missing, round_even(present / n, 4) AS fraction FROM n, (SELECT 'lang' AS field, count(nullif(trim(lang), '')) AS present FROM j UNION ALL SELECT 'source', count(nullif(trim(source), '')) FROM j
 UNION ALL SELECT 'quality', count(quality) FROM j UNION ALL SELECT 'toxic', count(toxic) FROM j)""")
def metadata_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.completeness(docs, ["lang", "source", "quality", "toxic"])


@query("SELECT coalesce(CAST(quality AS VARCHAR), '[missing]') AS key, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def counters_with_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.counters(docs, F.col("quality"))


@query("SELECT n_nationkey, count(s_suppkey) AS members FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def vocabulary_counts(spark, sf_dir):
    terms = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return profile.group_sizes(table(spark, sf_dir, "nation"), terms, "n_nationkey")


@query("SELECT min(n) AS least, max(n) AS most, round_even(avg(n), 3) AS mean FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def pages_per_group(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    sizes = profile.group_sizes(table(spark, sf_dir, "customer"), members, "c_custkey")
    return sizes.agg(F.min("members").alias("least"), F.max("members").alias("most"), F.bround(F.avg("members"), 3).alias("mean"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS downloaded, count(*) FILTER (WHERE o_orderstatus = 'O') AS reused, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0) AS BIGINT) AS bytes,
 count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS acquired, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders""")
def acquisition_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "downloaded").when(F.col("o_orderstatus") == "O", "reused").otherwise("failed")
    return profile.acquisition(table(spark, sf_dir, "orders").select(status.alias("status"), F.floor("o_totalprice").alias("size")), "status", "size")


@query(f"WITH r AS ({REGIONS}) SELECT label, count(*) FILTER (WHERE split = 'N') AS N, count(*) FILTER (WHERE split = 'A') AS A, count(*) FILTER (WHERE split = 'R') AS R FROM r GROUP BY label")
def class_split_pivot(spark, sf_dir):
    return profile.class_by_split(regions(spark, sf_dir), "label", "split", SPLITS)


@query(f"WITH r AS ({REGIONS}) SELECT v.split, l.label FROM (VALUES ('N'), ('A'), ('R')) v(split), (SELECT DISTINCT label FROM r) l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.label = l.label AND r.split = v.split)")
def missing_classes(spark, sf_dir):
    return profile.missing_classes(regions(spark, sf_dir), "label", "split", SPLITS)


@query("""WITH p AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM documents), o AS (SELECT lang, count(*) AS n FROM p GROUP BY lang)
 SELECT count(*) AS pages, count(DISTINCT source) AS groups, count(*) FILTER (WHERE split = 'train') AS train_pages, count(*) FILTER (WHERE split = 'validation') AS validation_pages, count(*) FILTER (WHERE split = 'test') AS test_pages,
 (SELECT count(*) FROM o) AS owners, round_even((SELECT max(n) / sum(n) FROM o), 6) AS largest_share FROM p""")
def structural_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "validation").otherwise("test")
    return profile.structure(docs.select("source", "lang", split.alias("split")), "source", "lang", "split")


@query(f"""WITH r AS ({REGIONS}) SELECT o_orderkey AS run_id, count(r.run_id) AS regions, min(confidence) AS min_confidence, round_even(avg(confidence), 6) AS avg_confidence, max(confidence) AS max_confidence,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN r ON r.run_id = o_orderkey GROUP BY o_orderkey""")
def run_left_aggregate(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).distinct()
    out = profile.run_summary(runs, regions(spark, sf_dir), "run_id", "label", "confidence")
    return out.withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH r AS ({REGIONS}) SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split' WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' ELSE 'all' END AS dimension,
 coalesce(label, split, CAST(l_linenumber AS VARCHAR), '[missing]') AS value, count(*) AS rows, round_even(avg(area), 6) AS mean, quantile_cont(area, 0.5) AS median, min(area) AS low, max(area) AS high
 FROM r GROUP BY GROUPING SETS ((label), (split), (l_linenumber), ())""")
def run_grouping_sets(spark, sf_dir):
    return profile.run_statistics(regions(spark, sf_dir), ["label", "split", "l_linenumber"], "area")


_RUNS = f"SELECT o_orderkey AS run_id, count(r.run_id) AS regions, avg(confidence) AS confidence FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN ({REGIONS}) r ON r.run_id = o_orderkey GROUP BY 1"


@query(f"""WITH t AS ({_RUNS}), q AS (SELECT quantile_cont(regions, 0.25) AS a, quantile_cont(regions, 0.75) AS b, count(*) AS n FROM t),
 f AS (SELECT run_id, regions, round_even(confidence, 6) AS confidence, concat_ws(',', CASE WHEN n >= 4 AND regions < a - 1.5 * (b - a) THEN 'low_region_count' END, CASE WHEN n >= 4 AND regions > b + 1.5 * (b - a) THEN 'high_region_count' END,
  CASE WHEN regions = 0 THEN 'zero_regions' END, CASE WHEN round_even(confidence, 6) < 0.4 THEN 'low_mean_confidence' END) AS flags FROM t, q) SELECT * FROM f WHERE flags <> ''""")
def iqr_outliers(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).distinct()
    summary = profile.run_summary(runs, regions(spark, sf_dir), "run_id", "label", "confidence").select("run_id", "regions", F.col("avg_confidence").alias("confidence"))
    return profile.outliers(summary, "run_id", "regions", "confidence").withColumn("flags", F.array_join("flags", ","))


@query(f"SELECT run_id, count(*) AS regions, round_even(avg(confidence), 6) AS mean_confidence FROM ({REGIONS}) GROUP BY run_id HAVING round_even(avg(confidence), 6) < 0.4")
def low_confidence_runs(spark, sf_dir):
    return profile.low_confidence_groups(regions(spark, sf_dir), "run_id", "confidence")


@query(f"SELECT run_id, label, area, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY area DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM ({REGIONS})) WHERE r = 1")
def largest_region_per_run(spark, sf_dir):
    best = reconcile.latest(regions(spark, sf_dir), ["run_id"], [F.desc("area"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select("run_id", "label", "area", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def top_n_largest(spark, sf_dir):
    """The report of the fifteen largest items (W10): the limit is the feature."""
    return files.largest(table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("size"), F.col("doc_id").alias("path"))).select("doc_id", "n_chars")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT event_type, count(*) AS rows, count(value) AS with_value, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count("value").alias("with_value"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(n_chars) AS pages, round_even(avg(n_chars), 4) AS mean_bytes, CAST(ceil(avg(n_chars) * 1000) AS BIGINT) AS projected_bytes FROM documents")
def storage_projection(spark, sf_dir):
    return profile.storage_projection(table(spark, sf_dir, "documents"), "n_chars", 1000)


@query("""SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS classes, count(*) AS rows, count(DISTINCT p_partkey) AS artifacts, count(*) FILTER (WHERE p_size % 4 = 0) AS s1, count(*) FILTER (WHERE p_size % 4 = 1) AS s2,
 count(*) FILTER (WHERE p_size % 4 = 2) AS s3, count(*) FILTER (WHERE p_size % 4 = 3) AS s4 FROM part GROUP BY p_type""")
def damage_taxonomy_rollup(spark, sf_dir):
    severity = [F.count_if(F.col("p_size") % 4 == k).alias(f"s{k + 1}") for k in range(4)]
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("classes"), F.count("*").alias("rows"), F.count_distinct("p_partkey").alias("artifacts"), *severity)


@query("""SELECT o_orderstatus AS label, count(*) AS rows FROM orders GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1""".replace("SELECT o_orderstatus AS label", "SELECT label, sum(rows)::BIGINT AS rows FROM (SELECT o_orderstatus AS label") + ") GROUP BY label")
def status_snapshot(spark, sf_dir):
    """Label counts summed over two batches."""
    a = profile.counters(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), "label")
    b = profile.counters(table(spark, sf_dir, "lineitem"), F.col("l_linestatus"), "label")
    return a.unionByName(b).groupBy("label").agg(F.sum("rows").alias("rows"))


@query("""SELECT warning, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN text IS NULL OR n_chars < 100 THEN 'short_text' END, CASE WHEN lang <> 'en' THEN 'not_english' END, CASE WHEN contains(text, '|') THEN 'piped' END], lambda x: x IS NOT NULL)) AS warning FROM documents) GROUP BY warning""")
def ingest_warnings(spark, sf_dir):
    checks = {"short_text": F.col("text").isNull() | (F.col("n_chars") < 100), "not_english": F.col("lang") != "en", "piped": F.contains("text", F.lit("|"))}
    return profile.warnings(table(spark, sf_dir, "documents"), checks)


@query("SELECT o_orderpriority, round_even(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) / nullif(sum(CAST(l_quantity AS BIGINT)), 0), 9) AS fraction FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def area_weighted_survival(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("long").alias("q"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority").agg(F.bround(share(F.sum(F.when(F.col("l_returnflag") == "N", F.col("q")).otherwise(0)), F.sum("q")), 9).alias("fraction"))


@query("""SELECT min(n_chars) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS least, max(n_chars) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS most FROM documents LEFT JOIN labels USING (doc_id)""")
def complete_pair_range(spark, sf_dir):
    """Extremes over rows whose pair of values is complete."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    whole = F.when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.col("n_chars"))
    return docs.agg(F.min(whole).alias("least"), F.max(whole).alias("most"))


@query("""WITH c AS (SELECT 'all' AS cohort, source FROM documents UNION ALL SELECT lang, source FROM documents)
 SELECT a.cohort, count(DISTINCT c.source) AS classes, (SELECT count(DISTINCT source) FROM documents) - count(DISTINCT c.source) AS missing FROM (SELECT DISTINCT cohort FROM c) a JOIN c USING (cohort) GROUP BY a.cohort""")
def cohort_coverage(spark, sf_dir):
    """Classes of each cohort, and how many the complete set has besides."""
    docs = table(spark, sf_dir, "documents").select("lang", "source")
    rows = docs.select(F.explode(F.array(F.lit("all"), F.col("lang"))).alias("cohort"), "source")
    by = rows.groupBy("cohort").agg(F.count_distinct("source").alias("classes"))
    total = docs.agg(F.count_distinct("source").alias("_all"))
    return by.join(F.broadcast(total)).select("cohort", "classes", (F.col("_all") - F.col("classes")).alias("missing"))  # a one-row aggregate
