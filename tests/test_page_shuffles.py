"""Page inspection: one shuffle by page of detections and of spans; the union is measured in one window."""

import random
import re

from pyspark.sql import functions as F

from foliospark.operators import audit, raster


def inspected(spark, detections, spans):
    ids = sorted({d[0] for d in detections} | {s[0] for s in spans} | {90})
    pages = spark.createDataFrame([(i, "train", 20, 9, 5, "a", 20, 9, 5, "a") for i in ids if i != 7], "page_id long, split string, width int, height int, size long, sha256 string, found_width int, found_height int, found_size long, found_sha256 string")
    n = {i: sum(d[0] == i for d in detections) for i in ids}
    runs = spark.createDataFrame([(i, i, "success", "train", 20, 9, n[i], n[i]) for i in ids], "page_id long, run_id long, status string, split string, width int, height int, declared int, stored int")
    found = spark.createDataFrame(detections, "page_id long, index int, confidence double, width int, height int, area int")
    return audit.inspect_pages(pages, runs, found, spark.createDataFrame(spans, "page_id long, index int, y int, x0 int, x1 int"))


def test_covered_cells_add_up_to_the_union(spark):
    r = random.Random(5)
    spans = [(r.randrange(6), r.randrange(4), a := r.randrange(-5, 30), a + r.randrange(1, 9)) for _ in range(600)]
    df = spark.createDataFrame(spans, "page_id long, y int, x0 int, x1 int")
    got = df.withColumn("n", raster.newly_covered(["page_id"])).groupBy("page_id").agg(F.sum("n").alias("n")).collect()
    cells = {(p, y, x) for p, y, a, b in spans for x in range(a, b)}
    assert {x.page_id: x.n for x in got} == {p: sum(c[0] == p for c in cells) for p in {s[0] for s in spans}}


def test_faults_and_shuffles(spark):
    detections = [
        (1, 1, 0.5, 20, 9, 5), (1, 2, 0.7, 20, 9, 4),  # right
        (2, 1, 0.5, 20, 9, 5), (2, 2, None, 20, 9, 9), (2, 3, 0.1, 21, 9, 1), (2, 4, 0.3, 20, 9, 2),  # missing, other size, other area
        (3, 1, 0.5, 20, 9, 3), (3, 1, 0.9, 20, 9, 3),  # an index twice
        (4, None, 0.5, 20, 9, 3),  # no index
        (7, 1, 0.5, 20, 9, 3),  # no page
        (8, 1, 0.5, 20, 9, None), (8, 2, 0.5, None, 9, 1),
    ]
    spans = [(1, 1, 0, 2, 7), (1, 2, 0, 5, 7), (1, 2, 1, 5, 7), (2, 1, 0, 0, 5), (2, 3, 0, 0, 1), (2, 4, 0, 0, 1), (3, 1, 0, 0, 3), (4, None, 0, 0, 3), (5, 1, 2, 3, 9), (8, 1, 0, 0, 1), (8, 2, 0, 0, 1), (7, 1, 0, 0, 3)]
    out = inspected(spark, detections, spans)
    dims, area, gone, twice = "segmentation_mask_dimensions_mismatch", "invalid_segmentation_mask_area", "missing_segmentation_mask", "duplicate_region_index"
    assert {x.page_id: (x.errors, x.detections, x.confidence, x.valid_masks, x.mask_area, x.union_area) for x in out.collect()} == {
        1: ([], 2, 0.6, 2, 9, 7), 2: ([area, gone, dims], 4, 0.3, 1, 5, None), 3: ([twice], 2, None, 0, None, None), 4: ([twice], 1, None, 0, None, None),
        5: ([], 0, None, 0, None, 6), 8: ([area, dims], 2, 0.5, 0, None, None), 90: ([], 0, None, 0, None, 0),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # Before, masks were shuffled by page and index, then by page; spans by page and index, and by page and row.
    assert keys and all(re.fullmatch(r"page_id#\d+L?, \d+", k) for k in keys) and "collect_set" not in plan
