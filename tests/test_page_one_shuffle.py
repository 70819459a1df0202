"""Page inspection of orders: lines are read, shuffled and sorted once; nothing of them is written."""

import random
import re

import duckdb
import pytest

from foliospark.operators import audit
from foliospark.plans import base, queries_audit

QUERIES = ("page_inspection", "segmentation_audit_counts", "segmentation_audit_distributions")
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines that repeat, differ in one column only, lack values or a page, and spans that end where they begin or before."""
    r, folder = random.Random(3), tmp_path_factory.mktemp("odd")
    lines = [(r.randrange(60), r.randrange(9), 0, r.randrange(1, 4), float(r.randrange(1, 9)), r.choice([-0.03, 0.0, 0.02, 0.05, 0.1]), r.choice([0.0, 0.01, 0.04, 0.08])) for _ in range(120)]
    lines += r.choices(lines, k=40) + [(*x[:2], 1, *x[3:]) for x in lines[:5]] + [(70, 1, 0, 1, 5.0, 0.1, 0.0)] * 3 + [(71, 2, 0, 1, 5.0, 0.1, 0.0), (71, 3, 0, 1, 7.0, 0.1, 0.0), (71, 4, 0, 2, 6.0, 0.1, 0.0)]
    lines += [(72, None, None, None, None, None, None)] * 2 + [(73, 1, 0, None, 5.0, 0.1, 0.0), (None, 1, 0, 1, 5.0, 0.1, 0.0), (74, 1, 0, 1, None, 0.1, 0.0), (99, 1, 0, 1, 5.0, 0.1, 0.0)]
    orders = [(i, i % 12, r.choice("OFP"), r.choice([1500.0, 9000.0, 480000.0]) if i % 3 == 0 else 9000.0, r.choice(["1-URGENT", "5-LOW"])) for i in range(76)]
    spark.createDataFrame(lines, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, -5.0 if i == 4 else None if i == 5 else 5.0) for i in range(11)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_lines_against_the_sql(spark, odd, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    got = base.QUERIES[name](spark, odd)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({base.SQL[name]})").fetchall()
    near = lambda rows: sorted(str([round(x, 9) if isinstance(x, float) else x for x in row]) for row in rows)
    assert near(got.collect()) == near(want)


def test_lines_are_read_shuffled_and_sorted_once(spark, odd, monkeypatch):
    monkeypatch.setattr(queries_audit, "LINES_A_TASK", 50, raising=False)
    plan = queries_audit._inspected(spark, odd)._jdf.queryExecution().executedPlan().toString()
    # Before, the lines were written and read three times, and shuffled once more each time.
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1 and "staged-" not in plan
    assert len(re.findall(r"Sort \[page_id\S* ASC NULLS FIRST, \w+#", plan)) == 1
    lines = plan[plan.index("Window [max(") : plan.index("FileScan parquet [l_orderkey")]
    assert re.findall(r"Exchange (\w+)\((\w+)#", lines) == [("hashpartitioning", "page_id")]


def test_a_span_beside_its_detection(spark):
    r = random.Random(8)
    rows = [(r.randrange(30), r.randrange(40), r.choice([0.2, 0.8, None]), r.choice([20, 20, 20, 21]), 9, r.randrange(1, 4), r.randrange(3), a := r.randrange(12), a + r.randrange(4)) for _ in range(90)]
    found = spark.createDataFrame(rows, "page_id long, index int, confidence double, width int, height int, area int, y int, x0 int, x1 int")
    pages = spark.createDataFrame([(i, "train", 20, 9, 5, "a", 20, 9, 5, "a") for i in range(32)], "page_id long, split string, width int, height int, size long, sha256 string, found_width int, found_height int, found_size long, found_sha256 string")
    n = {i: sum(x[0] == i for x in rows) for i in range(31)}
    runs = spark.createDataFrame([(i, i, "success", "train", 20, 9, 0 if i == 3 else n[i], n[i]) for i in n], "page_id long, run_id long, status string, split string, width int, height int, declared int, stored int")
    apart = audit.inspect_pages(pages, runs, found.drop("y", "x0", "x1"), found.where("x1 > x0").select("page_id", "index", "y", "x0", "x1"))
    assert n[3] and sorted(audit.inspect_pages(pages, runs, found).collect()) == sorted(apart.collect())
    flagged = found.selectExpr("*", "1 AS stored", "int(page_id != 3) AS declared")
    assert sorted(audit.inspect_pages(pages, runs.drop("declared", "stored"), flagged).collect()) == sorted(apart.collect())
