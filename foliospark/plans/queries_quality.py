"""Data-quality queries: violations as rows (rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .base import SQL, query, table, tasks

KEYS_A_TASK = 500_000
_KEY = "l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey"


def _line_key():
    return F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


@query("""SELECT 'required:' || f AS rule, CAST(doc_id AS VARCHAR) AS key, f AS detail FROM (
 SELECT doc_id, unnest(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END], lambda x: x IS NOT NULL)) AS f FROM documents LEFT JOIN labels USING (doc_id))""")
def required_fields(spark, sf_dir):
    # Of a text the first character behind its blanks stands for it, so that texts are not shuffled.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left(F.trim("text"), F.lit(1)).alias("text"), "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return Q.required(docs, F.col("doc_id"), ["text", "lang", "quality"])


@query("""SELECT 'domain:o_orderstatus' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT 'domain:o_orderpriority', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def closed_domains(spark, sf_dir):
    return Q.domains(table(spark, sf_dir, "orders"), F.col("o_orderkey"), {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")})


@query(f"""SELECT 'range:quantity' AS rule, {_KEY} AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS detail FROM lineitem WHERE CAST(l_quantity AS BIGINT) < 2 OR CAST(l_quantity AS BIGINT) > 49
 UNION ALL SELECT 'range:l_linenumber', {_KEY}, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber > 6""")
def value_ranges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return Q.ranges(line, _line_key(), {"quantity": (2, 49), "l_linenumber": (None, 6)})


@query("""SELECT 'unique:line' AS rule, l_orderkey || '|' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def uniqueness(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return Q.unique(lines, ["l_orderkey", "l_linenumber"], "line", tasks=tasks(lines, KEYS_A_TASK))


@query("""SELECT 'foreign_key:order' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""")
def foreign_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return Q.foreign_keys(lines, table(spark, sf_dir, "orders").where("o_orderstatus != 'P'"), "l_orderkey", "o_orderkey", "order", tasks=tasks(lines, KEYS_A_TASK))


@query("""SELECT 'isolation' AS rule, sha256(text) AS key, string_agg(DISTINCT s, ',' ORDER BY s) AS detail FROM (SELECT text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS s FROM documents WHERE text IS NOT NULL) GROUP BY text HAVING count(DISTINCT s) > 1""")
def split_isolation(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "validation").otherwise("test")
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha"), split.alias("split"))
    return Q.isolated(docs, F.col("sha"), "split")


@query(f"""WITH b AS (SELECT {_KEY} AS key, l_quantity - 5 AS x0, l_quantity * 0.5 AS y0, l_quantity + 10 AS x1, l_quantity * 0.5 + l_tax * 100 - 2 AS y1, CASE WHEN l_linenumber = 3 THEN 14.9 ELSE 15 END AS w, l_tax * 100 - 2 AS h FROM lineitem)
 SELECT 'box:outside' AS rule, key, 'page' AS detail FROM b WHERE x0 < 0 OR y0 < 0 OR x1 > 55 OR y1 > 40 UNION ALL SELECT 'box:empty', key, 'area' FROM b WHERE x1 <= x0 OR y1 <= y0
 UNION ALL SELECT 'box:size', key, 'w,h' FROM b WHERE abs(x1 - x0 - w) > 0.002 OR abs(y1 - y0 - h) > 0.002""")
def bounding_boxes(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").select(_line_key().alias("key"), (q - 5).alias("x0"), (q * 0.5).alias("y0"), (q + 10).alias("x1"), (q * 0.5 + t * 100 - 2).alias("y1"), F.when(F.col("l_linenumber") == 3, 14.9).otherwise(15.0).alias("w"), (t * 100 - 2).alias("h"), F.lit(55).alias("page_w"), F.lit(40).alias("page_h"))
    return Q.boxes(rows, F.col("key"))


@query("""WITH n AS (SELECT source AS key, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT * FROM (SELECT 'src' || i AS key, (SELECT count(*) FROM documents) // 20 AS expected FROM range(0, 22) t(i)) WHERE key <> 'src3')
 SELECT 'cardinality' AS rule, coalesce(n.key, e.key) AS key, 'expected ' || coalesce(CAST(expected AS VARCHAR), 'none') || ', found ' || coalesce(n, 0) AS detail FROM n FULL JOIN e ON n.key = e.key WHERE expected IS DISTINCT FROM coalesce(n, 0)""")
def expected_cardinalities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source")
    each = docs.agg(F.floor(F.count("*") / 20).alias("expected"))
    names = each.select(F.explode(F.sequence(F.lit(0), F.lit(21))).alias("i"), "expected").select(F.concat(F.lit("src"), F.col("i").cast("string")).alias("source"), "expected").where("source != 'src3'")
    return Q.cardinalities(docs, names, "source")


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'approved_for_training' WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected_for_training' ELSE 'unknown' END AS s, doc_id % 5 = 0 OR doc_id % 4 = 0 AS t, doc_id % 3 <> 0 AS has, CASE WHEN doc_id % 7 = 0 THEN '2026-01-01T10:00:00' ELSE '2026-01-01T10:00:00Z' END AS tm FROM documents)
 SELECT 'rights:status' AS rule, CAST(doc_id AS VARCHAR) AS key, s AS detail FROM a WHERE s = 'unknown' UNION ALL SELECT 'rights:flag', CAST(doc_id AS VARCHAR), CAST(t AS VARCHAR) FROM a WHERE t <> (s = 'approved_for_training')
 UNION ALL SELECT 'rights:provenance_missing', CAST(doc_id AS VARCHAR), s FROM a WHERE s IN ('approved_for_training', 'rejected_for_training') AND NOT has UNION ALL SELECT 'rights:time', CAST(doc_id AS VARCHAR), tm FROM a WHERE has AND doc_id % 7 = 0
 UNION ALL SELECT 'rights:reviewer', CAST(doc_id AS VARCHAR), 'reviewer' FROM a WHERE has AND doc_id % 11 = 0 UNION ALL SELECT 'rights:flag_differs', CAST(doc_id AS VARCHAR), CAST(NOT t AS VARCHAR) FROM a WHERE has AND doc_id % 13 = 0""")
def rights_state(spark, sf_dir):
    d = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in ("approved_for_training", "pending", "rejected_for_training", "unknown")]), (d % 4 + 1).cast("int"))
    allowed = (d % 5 == 0) | (d % 4 == 0)
    review = F.struct(F.lit("v1").alias("review_version"), F.when(d % 11 == 0, " ").otherwise("r").alias("reviewer"), F.when(d % 7 == 0, "2026-01-01T10:00:00").otherwise("2026-01-01T10:00:00Z").alias("reviewed_at"), F.lit("because").alias("decision_reason"), status.alias("rights_review_status"), F.when(d % 13 == 0, ~allowed).otherwise(allowed).alias("training_allowed"))
    rows = table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), allowed.alias("training_allowed"), F.when(d % 3 != 0, review).alias("review"))
    return Q.rights_state(rows, d)


@query("""WITH s AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE CAST(page_id // 2 AS VARCHAR) END AS id, url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS u, CASE WHEN page_id % 5 = 0 THEN 0.6 ELSE 0.7 END AS tr FROM pages)
 SELECT 'spec:id' AS rule, id AS key, id AS detail FROM s WHERE trim(id) = '' UNION ALL SELECT 'spec:training', id, 'true' FROM s WHERE page_id % 50 = 1 UNION ALL SELECT 'spec:rules', id, 'v9' FROM s WHERE page_id % 40 = 3
 UNION ALL SELECT 'unique:spec_id', id, CAST(count(*) AS VARCHAR) FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unique:spec_url', regexp_replace(trim(u), '/+$', ''), CAST(count(*) AS VARCHAR) FROM s GROUP BY regexp_replace(trim(u), '/+$', '') HAVING count(*) > 1""")
def specification_checks(spark, sf_dir):
    p = F.col("page_id")
    spec = table(spark, sf_dir, "pages").select(F.when(p % 9 == 0, " ").otherwise(F.floor(p / 2).cast("string")).alias("id"), F.concat("url", F.when(p % 2 == 0, "/").otherwise("")).alias("manifest_url"), F.lit(0.7).alias("train"), F.lit(0.15).alias("validation"), F.lit(0.15).alias("test"), (p % 50 == 1).alias("training_allowed"), F.when(p % 40 == 3, "v9").otherwise("v0.2").alias("rules_version"))
    return Q.specification(spec)


@query("""SELECT 'rejected_but_eligible' AS rule, CAST(doc_id AS VARCHAR) AS key, 'rejected' AS detail FROM labels WHERE quality = 0 AND toxic = 1 UNION ALL SELECT 'status_without_reason', CAST(doc_id AS VARCHAR), 'selected' FROM labels WHERE quality = 1 AND toxic = 1""")
def selection_invariants(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "rejected").otherwise("selected").alias("status"), ((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("eligible"), F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("reasons"))
    return Q.selection_invariants(rows, F.col("doc_id"))


@query("""SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN n_chars <> length(text) THEN 'size' END, CASE WHEN doc_id % 6 = 0 THEN 'checksum' END) AS errors FROM documents) WHERE errors <> ''""")
def recorded_checksums(spark, sf_dir):
    """Recorded against recomputed size and checksum."""
    from ..operators.reconcile import relationship_errors

    docs = table(spark, sf_dir, "documents")
    recorded = F.when(F.col("doc_id") % 6 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    rows = docs.select("doc_id", "n_chars", F.char_length("text").alias("size"), F.sha2("text", 256).alias("sha"), recorded.alias("recorded"))
    return relationship_errors(rows, {"size": F.col("n_chars") == F.col("size"), "checksum": F.col("sha") == F.col("recorded")}).select("doc_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT rule, count(*) AS violations FROM (" + " UNION ALL ".join(f"SELECT rule, key, detail FROM ({SQL[name]})" for name in ("required_fields", "closed_domains", "value_ranges", "uniqueness", "foreign_keys", "rights_state")) + ") GROUP BY rule")
def quality_violations(spark, sf_dir):
    """All row rules at once, counted by rule."""
    found = Q.violations(*[f(spark, sf_dir) for f in (required_fields, closed_domains, value_ranges, uniqueness, foreign_keys, rights_state)])
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS lines, round(sum(round(l_extendedprice * 100)) / 100, 2) AS price FROM lineitem GROUP BY 1)
 SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN coalesce(lines, 0) NOT BETWEEN 1 AND 7 THEN 'lines' END, CASE WHEN price IS DISTINCT FROM round(o_totalprice, 2) THEN 'price' END) AS differing FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) WHERE differing <> ''""")
def summary_recomputed(spark, sf_dir):
    """The totals stored with the orders against those recomputed from their lines; an order has one to seven."""
    from ..operators.reconcile import relationship_errors

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum(F.round(F.col("l_extendedprice") * 100)) / 100, 2).alias("price"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"lines": F.coalesce("lines", F.lit(0)).between(1, 7), "price": F.col("price").eqNullSafe(F.round("o_totalprice", 2))}
    return relationship_errors(rows, rules).select("o_orderkey", F.array_join("errors", ",").alias("differing"))


@query("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'F' THEN ' Keep' WHEN 'O' THEN 'reject' ELSE 'maybe' END AS decision, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'pending' END AS split,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'training_corpus_selection' WHEN o_orderpriority = '3-MEDIUM' THEN 'replacement_suitability_review' ELSE o_orderpriority END AS scope,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'audit_only_frozen_corpus' WHEN '3-MEDIUM' THEN 'review_evidence_only' WHEN '5-LOW' THEN 'later' ELSE 'batch_selection' END AS application, CAST(floor(o_totalprice) AS BIGINT) - 50000 AS seq, CAST(year(o_orderdate) AS VARCHAR) AS corpus FROM orders),
 c AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'Suitable_for_training_corpus ' WHEN 'MACHINERY' THEN 'unsuitable_for_training_corpus' ELSE c_mktsegment END AS decision, CASE WHEN c_acctbal >= 0 THEN 'manuscript_training_corpus_suitability' ELSE 'training_corpus_selection' END AS scope, CASE WHEN c_nationkey < 20 THEN 'batch_selection' ELSE 'review_evidence_only' END AS application FROM customer)
 SELECT 'page' AS kind, 'domain:decision' AS rule, key, decision AS detail FROM p WHERE decision = 'maybe' UNION ALL SELECT 'page', 'domain:split', key, split FROM p WHERE split = 'pending'
 UNION ALL SELECT 'page', 'domain:decision_scope', key, scope FROM p WHERE scope NOT IN ('training_corpus_selection', 'replacement_suitability_review') UNION ALL SELECT 'page', 'decision:not_corpus_scope', key, scope FROM p WHERE scope <> 'training_corpus_selection'
 UNION ALL SELECT 'page', 'domain:selection_application', key, application FROM p WHERE application = 'later' UNION ALL SELECT 'page', 'decision:not_batch_selection', key, application FROM p WHERE application <> 'batch_selection'
 UNION ALL SELECT 'page', 'decision:negative_sequence', key, CAST(seq AS VARCHAR) FROM p WHERE seq < 0 UNION ALL SELECT 'page', 'decision:other_corpus', key, corpus FROM p WHERE corpus <> '1996'
 UNION ALL SELECT 'group', 'domain:decision', key, decision FROM c WHERE lower(trim(decision)) NOT IN ('suitable_for_training_corpus', 'unsuitable_for_training_corpus') UNION ALL SELECT 'group', 'domain:decision_scope', key, scope FROM c WHERE scope = 'training_corpus_selection'
 UNION ALL SELECT 'group', 'decision:not_batch_selection', key, application FROM c WHERE application <> 'batch_selection'""")
def decision_rules(spark, sf_dir):
    """V3: orders as decisions on pages of the corpus 1996, customers as decisions on groups."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(status == "F", " Keep").when(status == "O", "reject").otherwise("maybe").alias("decision"), F.when(status == "F", "train").when(status == "O", "validation").otherwise("pending").alias("split"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "training_corpus_selection").when(priority == "3-MEDIUM", "replacement_suitability_review").otherwise(priority).alias("decision_scope"),
        F.when(priority == "2-HIGH", "audit_only_frozen_corpus").when(priority == "3-MEDIUM", "review_evidence_only").when(priority == "5-LOW", "later").otherwise("batch_selection").alias("selection_application"),
        (F.floor("o_totalprice") - 50000).alias("sequence_index"), F.year("o_orderdate").cast("string").alias("corpus_id"),
    )
    segment = F.col("c_mktsegment")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(segment == "BUILDING", "Suitable_for_training_corpus ").when(segment == "MACHINERY", "unsuitable_for_training_corpus").otherwise(segment).alias("decision"),
        F.when(F.col("c_acctbal") >= 0, Q.SUITABILITY_SCOPE).otherwise("training_corpus_selection").alias("decision_scope"), F.when(F.col("c_nationkey") < 20, "batch_selection").otherwise("review_evidence_only").alias("selection_application"),
    )
    found = Q.page_decisions(orders, F.col("o_orderkey"), corpus="1996", batch=True).withColumn("kind", F.lit("page"))
    return found.unionByName(Q.suitability_decisions(customers, F.col("c_custkey")).withColumn("kind", F.lit("group")))
