"""The training-data queries with production parameters, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, line_runs, multi_index, packing, paragraphs, periodic, quality, rans, secret_scan, simhash, toxicity, url_filter
from .common import table
from .tokens import default_tokenizer

URL_RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination_report(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write_token_files(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2)
    return rans.read_token_files(spark, path, with_ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, segments=7, size_ratio=0, verify_shingle=0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.spans_text(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"), "n_live", "n_example")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.plant_periods(table(spark, sf_dir, "documents")))
    best = F.col("best")
    return found.withColumn("best", periodic.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periodic.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_paragraph_dedup, op3_token_files, op4_simhash, op5_embedding_dedup, op6_url_filter, op7_quality, op8_line_dedup, op9_secret_scan, op10_packing, op11_collocations, op12_toxicity, op13_periodic_runs)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, i, s.n, list_slice(w, i, i + s.n - 1) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, (SELECT DISTINCT n FROM win) s WHERE i + s.n - 1 <= len(w)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP8_SQL = rf"""
WITH l AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, r.last IS NOT NULL AND l.doc_id <> r.last AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, ph, CAST(count(*) AS BIGINT) AS f
      FROM (SELECT lang, w[i:i + s - 1] AS ph FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, range(1, 6) x(s) WHERE len(w) >= s)) GROUP BY lang, ph HAVING count(*) >= 100),
longer AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, ph[1:len(ph) - 1] AS part FROM f WHERE len(ph) > 2 UNION ALL SELECT lang, f, ph[2:len(ph)] FROM f WHERE len(ph) > 2) GROUP BY lang, part),
cand AS (SELECT f.lang, f.ph, f.f AS a FROM f LEFT JOIN longer g ON g.lang = f.lang AND g.part = f.ph WHERE len(f.ph) > 1 AND 100 * coalesce(g.most, 0) < 100 * f.f),
cut AS (SELECT lang, ph, a, k, ph[1:k] AS lp, ph[k + 1:len(ph)] AS rp FROM (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM cand)),
scored AS (SELECT c.lang, c.ph, c.a, c.k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cut c JOIN f x ON x.lang = c.lang AND x.ph = c.lp JOIN f y ON y.lang = c.lang AND y.ph = c.rp JOIN total t ON t.lang = c.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM scored),
ranked AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank FROM low WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


# crc32 bit by bit; every repeated five-word string gives a place on the diagonal of its lag, and stretches of those are the runs.
OP13_SQL = r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
                  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
                      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM documents),
g AS (SELECT doc_id, o, h % 10 = 0 AND len(o) > 0 AS planted, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a, (h // 10) % 8 AS m FROM h),
d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END]) ELSE o END AS w FROM g),
pos AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS five FROM (SELECT doc_id, n, w, unnest(range(0, n - 4)) AS i FROM d WHERE n >= 5)),
seed AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.five = y.five WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM seed),
long AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 5 + q AS len FROM isle GROUP BY doc_id, q, part HAVING max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM long l WHERE NOT EXISTS (SELECT 1 FROM long k WHERE k.doc_id = l.doc_id AND k.q < l.q AND k.s <= l.s AND k.s + k.len >= l.s + l.len)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS o FROM run),
text AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * len // q AS BIGINT) AS exponent_milli,
       sha256(coalesce(text.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN (SELECT * FROM best WHERE o = 1) b ON b.doc_id = d.doc_id LEFT JOIN text ON text.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op8_line_dedup": OP8_SQL, "op11_collocations": OP11_SQL, "op13_periodic_runs": OP13_SQL}
