"""Selection, split and rule queries. A document stands for a page, its source for the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import REJECTION_V1, REJECTION_V2, REVIEW_V2, rule_matches
from ..operators import profile, selection
from .base import query, table

QUOTA, SEED = 3, "seed"
RULES_1 = (("shouting", "!!"), ("piped", "[|]"))
RULES_2 = (*RULES_1, ("marked", "[%$#&*]{3}"))
SPLIT_NAMES = ["train", "validation", "test"]


def pages(spark: SparkSession, sf_dir: str, rules=RULES_1, review=()) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    label = F.col("text")
    codes = lambda r: F.transform(rule_matches(label, r), lambda m: m["code"])
    return docs.select(F.col("source").alias("group_id"), F.col("doc_id").alias("page_id"), F.col("doc_id").alias("sequence"), codes(rules).alias("reject_codes"), codes(review).cast("array<string>").alias("review_codes"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.where("quality = 0 or toxic = 1").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, "reject").otherwise("keep").alias("decision"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.assign_splits(table(spark, sf_dir, "documents"), "source", seed="split")


_SPLIT = """
s AS (SELECT DISTINCT source FROM documents),
o AS (SELECT source, row_number() OVER (ORDER BY sha256(concat_ws(chr(0), 'split', source)), source) AS position FROM s),
q AS (SELECT i, name, n, n * r AS want FROM (VALUES (0, 'train', 0.7::DOUBLE), (1, 'validation', 0.15::DOUBLE), (2, 'test', 0.15::DOUBLE)) v(i, name, r), (SELECT count(*) AS n FROM s)),
k AS (SELECT i, name, floor(want) + CASE WHEN row_number() OVER (ORDER BY floor(want) - want, i) <= n - sum(floor(want)) OVER () THEN 1 ELSE 0 END AS c FROM q),
b AS (SELECT name, sum(c) OVER (ORDER BY i) - c AS low, sum(c) OVER (ORDER BY i) AS high FROM k),
sp AS (SELECT source, position, name AS split FROM o JOIN b ON position > low AND position <= high)
"""
_RULED = """
p AS (SELECT source, doc_id, text AS label FROM documents),
f AS (SELECT source, doc_id, concat_ws(',', CASE WHEN regexp_matches(label, '!!') THEN 'shouting' END, CASE WHEN regexp_matches(label, '[|]') THEN 'piped' END) AS codes,
      sha256(concat_ws(chr(0), 'seed', source, CAST(doc_id AS VARCHAR))) AS digest FROM p)
"""
_SELECTED = f"""
{_RULED},
r AS (SELECT *, CASE WHEN codes = '' THEN row_number() OVER (PARTITION BY source, codes = '' ORDER BY digest, doc_id) END AS rank FROM f),
sel AS (SELECT source, doc_id, rank, CASE WHEN codes <> '' THEN 'rejected' WHEN rank <= 3 THEN 'selected' ELSE 'candidate' END AS status,
        CASE WHEN codes <> '' THEN codes WHEN rank <= 3 THEN 'deterministic_seeded_selection' ELSE 'eligible_not_selected_page_limit' END AS reasons FROM r)
"""


@query(f"WITH {_SELECTED}, {_SPLIT} SELECT sel.source, doc_id, status, reasons, CAST(rank AS INTEGER) AS rank, split FROM sel JOIN sp ON sel.source = sp.source")
def seeded_selection(spark, sf_dir):
    chosen = selection.select_pages(pages(spark, sf_dir), seed=SEED, quota=QUOTA)
    own = splits(spark, sf_dir).select(F.col("source").alias("group_id"), "split")
    return chosen.join(own, "group_id").select(F.col("group_id").alias("source"), F.col("page_id").alias("doc_id"), "status", F.array_join("reasons", ",").alias("reasons"), "rank", "split")


@query(f"WITH {_SELECTED} SELECT source, status, count(*) AS pages FROM sel GROUP BY ALL")
def seeded_selection_counts(spark, sf_dir):
    chosen = selection.select_pages(pages(spark, sf_dir), seed=SEED, quota=QUOTA)
    return chosen.groupBy(F.col("group_id").alias("source"), "status").agg(F.count("*").alias("pages"))


_REVIEWED = f"""
{_RULED},
d AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'reject' ELSE 'keep' END AS decision FROM labels WHERE quality = 0 OR toxic = 1),
j AS (SELECT f.*, decision, codes = '' AS original, codes = '' AND coalesce(decision, '') <> 'reject' AS accepted FROM f LEFT JOIN d USING (doc_id)),
r AS (SELECT *, CASE WHEN original THEN row_number() OVER (PARTITION BY source, original ORDER BY digest, doc_id) END AS original_rank,
      CASE WHEN accepted THEN row_number() OVER (PARTITION BY source, accepted ORDER BY digest, doc_id) END AS rank FROM j),
g AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY original_rank) AS gone FROM r WHERE decision = 'reject' AND original_rank <= 3 GROUP BY source),
v AS (SELECT r.*, gone, coalesce(decision = 'reject', false) AS rejected, coalesce(rank <= 3, false) AS chosen, coalesce(rank <= 3 AND original_rank > 3 AND gone IS NOT NULL, false) AS replacement FROM r LEFT JOIN g USING (source)),
out AS (SELECT source, doc_id, CAST(original_rank AS INTEGER) AS original_rank, CAST(rank AS INTEGER) AS rank, decision,
       CASE WHEN rejected OR codes <> '' THEN 'rejected' WHEN chosen THEN 'selected' ELSE 'candidate' END AS status,
       CASE WHEN rejected THEN concat_ws(',', 'explicit_manual_review_reject', nullif(codes, '')) WHEN codes <> '' THEN codes
            WHEN replacement THEN 'deterministic_seeded_selection,deterministic_same_manuscript_replacement' WHEN chosen THEN 'deterministic_seeded_selection' ELSE 'eligible_not_selected_page_limit' END AS reasons,
       CASE WHEN rejected THEN 'resolved_reject' WHEN codes <> '' THEN 'not_required' WHEN decision = 'keep' THEN 'resolved_keep' WHEN chosen THEN 'post_download_review_required' ELSE 'not_reviewed' END AS review_status,
       NOT (rejected OR codes <> '') AS eligible, CASE WHEN replacement THEN gone END AS replaces FROM v)
"""


def _reviewed(spark, sf_dir):
    return selection.select_pages(pages(spark, sf_dir), seed=SEED, quota=QUOTA, decisions=decisions(spark, sf_dir))


@query(f"WITH {_REVIEWED} SELECT source, doc_id, original_rank, rank, status, reasons, review_status, eligible, replaces FROM out")
def replacement_after_review(spark, sf_dir):
    out = _reviewed(spark, sf_dir)
    return out.select(F.col("group_id").alias("source"), F.col("page_id").alias("doc_id"), "original_rank", "rank", "status", F.array_join("reasons", ",").alias("reasons"), "review_status", "eligible", F.array_join("replaces", ",").alias("replaces"))


@query(f"""WITH {_REVIEWED}, t AS (SELECT source, count(*) FILTER (WHERE decision = 'reject' AND original_rank <= 3) AS rejected, count(*) FILTER (WHERE replaces IS NOT NULL) AS replacements,
 count(*) FILTER (WHERE status = 'selected') AS selected FROM out GROUP BY source)
 SELECT source, rejected, replacements, selected, 3 - selected AS shortfall, CASE WHEN rejected = 0 THEN 'unchanged' WHEN selected >= 3 THEN 'replaced' ELSE 'shortfall' END AS outcome FROM t""")
def decision_trace(spark, sf_dir):
    return selection.trace_rejections(_reviewed(spark, sf_dir), quota=QUOTA).withColumnRenamed("group_id", "source")


@query(f"WITH {_SPLIT} SELECT source, CAST(position AS INTEGER) AS position, split FROM sp")
def manuscript_split(spark, sf_dir):
    return splits(spark, sf_dir)


@query(f"""WITH {_SPLIT}, d AS (SELECT sha256(text) AS key, split FROM documents JOIN sp USING (source) WHERE text IS NOT NULL)
 SELECT key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS rows FROM d GROUP BY key HAVING count(DISTINCT split) > 1""")
def split_leakage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", F.sha2("text", 256).alias("content"))
    found = selection.split_leakage(docs.join(splits(spark, sf_dir), "source"), F.col("content"))
    return found.select("key", F.array_join("splits", ",").alias("splits"), "rows")


@query("""WITH p AS (SELECT doc_id, text AS label FROM documents)
 SELECT doc_id, code, evidence FROM (
  SELECT doc_id, 'shouting' AS code, regexp_extract(label, '!!', 0) AS evidence FROM p WHERE regexp_matches(label, '!!')
  UNION ALL SELECT doc_id, 'piped', regexp_extract(label, '[|]', 0) FROM p WHERE regexp_matches(label, '[|]')
  UNION ALL SELECT doc_id, 'marked', regexp_extract(label, '[%$#&*]{3}', 0) FROM p WHERE regexp_matches(label, '[%$#&*]{3}'))""")
def label_rejection_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(rule_matches(F.col("text"), RULES_2)).alias("m")).select("doc_id", "m.code", "m.evidence")


def _status_sql(codes: str) -> str:
    return f"""(SELECT doc_id, CASE WHEN bad THEN 'rejected' WHEN row_number() OVER (PARTITION BY source, bad ORDER BY digest, doc_id) <= 3 THEN 'selected' ELSE 'candidate' END AS status
      FROM (SELECT source, doc_id, coalesce(regexp_matches(text, '{codes}'), false) AS bad, sha256(concat_ws(chr(0), 'seed', source, CAST(doc_id AS VARCHAR))) AS digest FROM documents))"""


@query(f"""SELECT a.status || '->' || b.status AS transition, count(*) AS rows FROM {_status_sql('!!|[|]')} a JOIN {_status_sql('!!|[|]|[%$#&*]{3}')} b USING (doc_id) GROUP BY 1""")
def rule_transition_counts(spark, sf_dir):
    old = selection.select_pages(pages(spark, sf_dir), seed=SEED, quota=QUOTA)
    new = selection.select_pages(pages(spark, sf_dir, RULES_2), seed=SEED, quota=QUOTA)
    return selection.transitions(old, new, "page_id")


@query(f"WITH {_SELECTED}, t AS (SELECT source, count(*) FILTER (WHERE status = 'selected') AS selected FROM sel GROUP BY source) SELECT source, selected, greatest(3 - selected, 0) AS shortfall, CASE WHEN selected < 3 THEN 'quota_shortfall' ELSE 'complete' END AS status FROM t")
def quota_shortfall(spark, sf_dir):
    chosen = selection.select_pages(pages(spark, sf_dir), seed=SEED, quota=QUOTA)
    return profile.shortfalls(chosen, "group_id", F.col("status") == "selected", QUOTA).withColumnRenamed("group_id", "source")


@query(f"WITH {_SPLIT} SELECT v.split, count(DISTINCT d.source) AS groups, count(d.doc_id) AS pages FROM (VALUES ('train'), ('validation'), ('test')) v(split) LEFT JOIN (SELECT * FROM documents JOIN sp USING (source)) d ON v.split = d.split GROUP BY v.split")
def split_two_grains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source").join(splits(spark, sf_dir), "source")
    return profile.two_grains(docs, "source", "split", SPLIT_NAMES)


@query(f"""WITH {_RULED}, d AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'reject' ELSE 'keep' END AS decision FROM labels WHERE quality = 0 OR toxic = 1)
 SELECT CASE WHEN f.doc_id IS NULL THEN 'unknown_page' ELSE 'keep_overrides_rule' END AS rule, CAST(d.doc_id AS VARCHAR) AS key FROM d LEFT JOIN f USING (doc_id) WHERE f.doc_id IS NULL OR (decision = 'keep' AND codes <> '')""")
def decision_conflicts(spark, sf_dir):
    own = decisions(spark, sf_dir).withColumn("sequence", F.col("page_id"))
    return selection.decision_conflicts(pages(spark, sf_dir), own)


# Labels as catalogues write them, by part; every fourth one goes on with the part's name.
PHRASES = (
    "Front Cover", "rear  cover", "Pastedown front", "paste-down", "Binding", "Spine view", "Blank", "Empty page", "Colour chart", "color target", "Calibration image", "Test chart", "Grey scale", "digitization target",
    "Copyright notice", "administrative page", "Digital ColorChecker", "colour profile", "ruler on page", "QP card", "Fore edge", "head B", "open view", "Accompanying materials", "accompanying materials 12r", "Folio 12r", "discovery", "spines", "blanket", "recovered leaf",
)
_LABELS = f"SELECT p_partkey, [{', '.join(repr(x) for x in PHRASES)}][CAST(p_partkey % {len(PHRASES)} AS INTEGER) + 1] || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_name ELSE '' END AS label FROM part"


def _labels(spark, sf_dir) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.col("p_partkey") % len(PHRASES)).cast("int") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(phrase, F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise("")).alias("label"))


def _rules_sql(rules) -> str:
    each = [f"SELECT p_partkey, {k} AS rule, '{code}' AS code, regexp_extract(label, '{pattern}', 0, 'i') AS evidence FROM l WHERE regexp_matches(label, '{pattern}', 'i')" for k, (code, pattern) in enumerate(rules)]
    return f"WITH l AS ({_LABELS}) " + " UNION ALL ".join(each)


def _ruled(spark, sf_dir, rules) -> DataFrame:
    numbered = [(f"{k}:{code}", pattern) for k, (code, pattern) in enumerate(rules)]
    found = _labels(spark, sf_dir).select("p_partkey", F.explode(rule_matches(F.col("label"), numbered)).alias("m"))
    return found.select("p_partkey", F.substring_index("m.code", ":", 1).cast("int").alias("rule"), F.substring_index("m.code", ":", -1).alias("code"), "m.evidence")


@query(_rules_sql(REJECTION_V1))
def label_rejection_v1(spark, sf_dir):
    """P26, first version of the rules."""
    return _ruled(spark, sf_dir, REJECTION_V1)


@query(_rules_sql(REJECTION_V2))
def label_rejection_v2(spark, sf_dir):
    """P26, second version."""
    return _ruled(spark, sf_dir, REJECTION_V2)


@query(_rules_sql(REVIEW_V2))
def label_review_v2(spark, sf_dir):
    """Doubtful labels go to a person, they are not rejected."""
    return _ruled(spark, sf_dir, REVIEW_V2)


@query(f"""WITH l AS ({_LABELS}), s AS (SELECT p_partkey,
  CASE WHEN {' OR '.join(f"regexp_matches(label, '{p}', 'i')" for _, p in REJECTION_V1)} THEN 'rejected' ELSE 'candidate' END AS v1,
  CASE WHEN {' OR '.join(f"regexp_matches(label, '{p}', 'i')" for _, p in REJECTION_V2)} THEN 'rejected' WHEN {' OR '.join(f"regexp_matches(label, '{p}', 'i')" for _, p in REVIEW_V2)} THEN 'uncertain' ELSE 'candidate' END AS v2 FROM l)
 SELECT v1 || '->' || v2 AS transition, count(*) AS rows FROM s GROUP BY 1""")
def label_rule_versions(spark, sf_dir):
    """C11: what the second version of the rules changes."""
    hit = lambda rules: F.size(rule_matches(F.col("label"), rules)) > 0
    v1 = F.when(hit(REJECTION_V1), "rejected").otherwise("candidate")
    v2 = F.when(hit(REJECTION_V2), "rejected").when(hit(REVIEW_V2), "uncertain").otherwise("candidate")
    return _labels(spark, sf_dir).groupBy(F.concat_ws("->", v1, v2).alias("transition")).agg(F.count("*").alias("rows"))
