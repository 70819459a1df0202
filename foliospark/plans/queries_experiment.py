"""Experiment summaries. An order is a task, its lines the regions; what a discount takes of a line is lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment
from ..session import staged
from .base import query, table

_TASKS = """r AS (SELECT l_orderkey AS task_id, l_returnflag || l_linestatus AS label, CAST(l_quantity AS BIGINT) AS area, CAST(l_quantity AS BIGINT) * (10 - greatest(0, least(10, CAST(round(l_discount * 100) AS BIGINT)))) // 10 AS surviving FROM lineitem),
 rg AS (SELECT *, surviving / nullif(area, 0) AS fraction FROM r),
 t AS (SELECT o_orderkey AS task_id, o_orderpriority AS family, CASE o_orderstatus WHEN 'F' THEN 0.6::DOUBLE WHEN 'O' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS severity, c_nationkey AS manuscript, o_custkey AS page, 1 - s / nullif(a, 0) AS measured
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT task_id, sum(surviving) AS s, sum(area) AS a FROM r GROUP BY task_id) x ON x.task_id = o_orderkey),
 m AS (SELECT rg.label, rg.fraction, t.*, CASE WHEN fraction IS NULL THEN 'undefined' WHEN fraction = 0 THEN 'fully_removed' WHEN fraction <= 0.05 THEN 'mostly_destroyed' WHEN fraction >= 0.95 THEN 'almost_complete' ELSE 'partial' END AS category FROM rg JOIN t USING (task_id)),
 h AS (SELECT DISTINCT label, t.* FROM rg JOIN t USING (task_id))"""


def tasks_and_regions(spark, sf_dir):
    """Both written once, as every statistic reads them."""
    taken = F.greatest(F.lit(0), F.least(F.lit(10), F.round(F.col("l_discount") * 100).cast("long")))
    area = F.col("l_quantity").cast("long")
    regions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.concat("l_returnflag", "l_linestatus").alias("label"), area.alias("area"), F.floor(area * (10 - taken) / 10).alias("surviving"))
    regions = staged(regions.withColumn("fraction", F.col("surviving") / F.nullif(F.col("area"), F.lit(0))))
    left = regions.groupBy("task_id").agg((1 - F.sum("surviving") / F.nullif(F.sum("area"), F.lit(0))).alias("measured"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("manuscript"))
    asked = F.when(F.col("o_orderstatus") == "F", 0.6).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.4)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("family"), asked.alias("severity"), F.col("o_custkey").alias("page"))
    return staged(orders.join(owners, "page", "left").join(left, "task_id", "left")), regions


def _stats(col: str, prefix: str) -> str:
    return f"count({col}) AS {prefix}_n, round_even(avg({col}), 10) AS {prefix}_mean, round_even(quantile_cont({col}, 0.5), 10) AS {prefix}_median, min({col}) AS {prefix}_min, max({col}) AS {prefix}_max, CASE WHEN count({col}) >= 2 THEN round_even(stddev_pop({col}), 10) END AS {prefix}_sd"


def _rounded(df):
    return df.withColumns({c: F.bround(c, 10) for c in df.columns if c.endswith("_median")})


def _summary_sql() -> str:
    columns = {"mask_family": "family", "requested_severity": "CAST(severity AS VARCHAR)", "manuscript": "CAST(manuscript AS VARCHAR)", "page": "CAST(page AS VARCHAR)"}
    tall = lambda source, keep, names: " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce({c}, '[missing]') AS value, {keep} FROM {source}" for n, c in names.items())
    kinds = experiment.CATEGORIES
    counted = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in kinds)
    return f"""WITH {_TASKS}, tr AS ({tall('t', '1 - measured AS surviving', columns)} UNION ALL {tall('h', '1 - measured AS surviving', {'layout_class': 'label'})}),
 rr AS ({tall('m', 'fraction, category', columns | {'layout_class': 'label'})}),
 a AS (SELECT dimension, value, count(*) AS tasks, {_stats('surviving', 'page')} FROM tr GROUP BY ALL), b AS (SELECT dimension, value, count(*) AS regions, {counted}, {_stats('fraction', 'region')} FROM rr GROUP BY ALL)
 SELECT dimension, value, tasks, coalesce(regions, 0) AS regions, {', '.join(f'coalesce({c}, 0) AS {c}' for c in kinds)}, coalesce(region_n, 0) AS region_n, page_n, page_mean, page_median, page_min, page_max, page_sd, region_mean, region_median, region_min, region_max, region_sd,
 {', '.join(f'{c} / nullif(regions, 0) AS {c}_share' for c in kinds)} FROM a LEFT JOIN b USING (dimension, value)"""


@query(_summary_sql())
def experiment_summary(spark, sf_dir):
    """A18 in all five dimensions."""
    return _rounded(experiment.summary(*tasks_and_regions(spark, sf_dir)))


def _metrics_sql() -> str:
    levels = {"overall": "NULL::VARCHAR AS family, NULL::DOUBLE AS severity, NULL::VARCHAR AS label", "group": "family, severity, NULL::VARCHAR AS label", "class": "family, severity, label"}
    rows = lambda sources, keep: " UNION ALL ".join(f"SELECT {levels[n]}, {keep} FROM {s}" for n, s in sources.items())
    rates = ", ".join(f"count(*) FILTER (WHERE category = '{c}') / count(*) AS {n}" for n, c in experiment.RATES.items())
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("family", "severity", "label"))
    return f"""WITH {_TASKS}, tr AS ({rows({'overall': 't', 'group': 't', 'class': 'h'}, 'measured AS loss, abs(measured - severity) AS error')}), rr AS ({rows({'overall': 'm', 'group': 'm', 'class': 'm'}, 'fraction, category')}),
 a AS (SELECT family, severity, label, count(*) AS tasks, {_stats('loss', 'loss')}, {_stats('error', 'error')} FROM tr GROUP BY ALL), b AS (SELECT family, severity, label, count(*) AS regions, {_stats('fraction', 'survival')}, {rates} FROM rr GROUP BY ALL)
 SELECT a.*, coalesce(regions, 0) AS regions, coalesce(survival_n, 0) AS survival_n, survival_mean, survival_median, survival_min, survival_max, survival_sd, {', '.join(experiment.RATES)} FROM a LEFT JOIN b ON {on}"""


@query(_metrics_sql())
def experiment_metrics(spark, sf_dir):
    """Overall, by family and severity, and within these by class, read out of the nested maps."""
    nested = experiment.nested_metrics(*tasks_and_regions(spark, sf_dir))
    own = nested.drop("level", "layout_classes").withColumn("label", F.lit(None).cast("string"))
    classes = nested.select("family", "severity", F.explode("layout_classes").alias("label", "_m")).select("family", "severity", "label", "_m.*")
    return _rounded(own.unionByName(classes))
