import random
from statistics import mean, median, pstdev

import pytest
from pyspark.sql import functions as F

from foliospark.operators import audit, experiment
from foliospark.plans import queries_audit, queries_raster  # noqa: F401

CATEGORIES = [(None, "undefined"), (0.0, "fully_removed"), (0.03, "mostly_destroyed"), (0.5, "partial"), (0.97, "almost_complete")]
KIND = dict(CATEGORIES)


@pytest.fixture(scope="module")
def trial(spark):
    r = random.Random(5)
    tasks = [(i, "hot" if i % 3 else r.choice(["a", "b"]), r.choice([0.3, 0.6]), r.choice(["m1", "m2", None]), f"p{i % 7}", r.choice([0.25, 0.5, 0.625, None])) for i in range(60)]
    regions = [(r.randrange(50), r.choice(["x", "y", None]), r.choice(CATEGORIES)[0]) for _ in range(300)] + [(999, "x", 0.5)]
    return tasks, regions, spark.createDataFrame(tasks, "task_id int, family string, severity double, manuscript string, page string, measured double"), spark.createDataFrame(regions, "task_id int, label string, fraction double")


def stats(values):
    v = [x for x in values if x is not None]
    return (len(v), *(pytest.approx(x, abs=1e-9) if x is not None else None for x in ((mean(v), median(v), min(v), max(v)) if v else (None,) * 4)), pytest.approx(pstdev(v), abs=1e-9) if len(v) > 1 else None)


def found(row, prefix):
    return tuple(row[f"{prefix}_{s}"] for s in ("n", "mean", "median", "min", "max", "sd"))


def test_summary_against_loops(trial):
    tasks, regions, t, g = trial
    rows = experiment.summary(t, g).collect()
    got = {(r.dimension, r.value): r for r in rows}
    names = {"mask_family": 1, "requested_severity": 2, "manuscript": 3, "page": 4}
    of = {k[0]: k for k in tasks}
    want = {}
    for name, at in names.items():
        for k in tasks:
            want.setdefault((name, "[missing]" if k[at] is None else str(k[at])), set()).add(k[0])
    for k, label, _ in regions:
        if k in of:
            want.setdefault(("layout_class", "[missing]" if label is None else label), set()).add(k)
    assert len(rows) == len(want) and set(got) == set(want)
    for key, ids in want.items():
        own = [f for k, label, f in regions if k in ids and (key[0] != "layout_class" or (label or "[missing]") == key[1])]
        r = got[key]
        assert (r.tasks, r.regions) == (len(ids), len(own))
        assert found(r, "page") == stats([None if of[i][5] is None else 1 - of[i][5] for i in ids]) and found(r, "region") == stats(own)
        for c in experiment.CATEGORIES:
            n = sum(KIND[f] == c for f in own)
            assert r[c] == n and r[f"{c}_share"] == (pytest.approx(n / len(own)) if own else None)


def test_nested_metrics_against_loops(trial):
    tasks, regions, t, g = trial
    rows = experiment.nested_metrics(t, g).collect()
    groups = {(None, None): tasks}
    for k in tasks:
        groups.setdefault((k[1], k[2]), []).append(k)
    assert len(rows) == len(groups)

    def check(row, members, own):
        assert (row.tasks, row.regions) == (len(members), len(own))
        assert found(row, "loss") == stats([k[5] for k in members]) and found(row, "survival") == stats(own)
        assert found(row, "error") == stats([None if k[5] is None else abs(k[5] - k[2]) for k in members])
        for name, c in experiment.RATES.items():
            assert row[name] == (pytest.approx(sum(KIND[f] == c for f in own) / len(own)) if own else None)

    for row in rows:
        members = groups[row.family, row.severity]
        ids = {k[0] for k in members}
        check(row, members, [f for k, _, f in regions if k in ids])
        if row.family is None:
            assert row.layout_classes is None
            continue
        labels = {label for k, label, _ in regions if k in ids and label is not None}
        assert set(row.layout_classes) == labels
        for label in labels:
            held = [k for k in members if any(i == k[0] and x == label for i, x, _ in regions)]
            check(row.layout_classes[label], held, [f for k, x, f in regions if k in ids and x == label])


def test_summaries_of_nothing(trial):
    _, _, t, g = trial
    assert experiment.summary(t.limit(0), g).count() == 0 and experiment.metrics(t.limit(0), g).count() == 0
    alone = {(r.dimension, r.value): r for r in experiment.summary(t, g.limit(0)).collect()}
    r = alone["mask_family", "hot"]
    assert (r.tasks, r.regions, r.partial, r.partial_share, r.region_n, r.region_mean) == (40, 0, 0, None, 0, None)
    assert experiment.nested_metrics(t, g.limit(0)).where("layout_classes is not null").count() == 0


def test_page_inspection(spark):
    good = dict(split="train", width=10, height=4, size=5, sha256="s", found_width=10, found_height=4, found_size=5, found_sha256="s")
    changes = {1: {}, 2: {"found_sha256": "other", "found_size": 9}, 3: {"found_width": 11}, 4: {"found_size": 6}, 5: {"sha256": None}, 6: {}, 7: {}, 8: {}, 9: {}, 10: {}, 11: {}, 12: {"found_size": 6}}
    pages = spark.createDataFrame([{"page_id": k, **good, **v} for k, v in changes.items()], "page_id int, split string, width int, height int, size int, sha256 string, found_width int, found_height int, found_size int, found_sha256 string")
    fine = dict(run_id=1, status="success", split="train", width=10, height=4, declared=2, stored=2)
    runs = {1: {}, 2: {"declared": 0, "stored": 0}, 3: {"declared": 0, "stored": 0}, 4: {"declared": 0, "stored": 0}, 5: {"declared": 0, "stored": 0}, 6: {"status": "failed"}, 7: {"split": "test"}, 8: {"height": 5}, 9: {"stored": 3}, 10: {}, 12: {}}
    runs = spark.createDataFrame([{"page_id": k, **fine, **v} for k, v in runs.items()], "page_id int, run_id int, status string, split string, width int, height int, declared int, stored int")
    both = [(k, i, 0.25 * i, 10, 4, 6) for k in (1, 6, 7, 8, 9) for i in (1, 2)]
    odd = [(10, 1, 0.5, 10, 4, 6), (10, 1, 0.5, 10, 4, 6), (12, 1, 0.1, 10, 4, 6), (12, 2, None, 9, 4, 3)]
    detections = spark.createDataFrame(both + odd, "page_id int, index int, confidence double, width int, height int, area int")
    spans = [(k, i, y, i, i + 3) for k in (1, 6, 9, 10) for i in (1, 2) for y in (0, 1)] + [(12, 2, 0, 0, 3)]
    rows = audit.inspect_pages(pages, runs, detections, spark.createDataFrame(spans, "page_id int, index int, y int, x0 int, x1 int"))
    got = {r.page_id: (r.errors, r.detections, r.valid_masks, r.mask_area, r.union_area) for r in rows.collect()}
    assert got[1] == ([], 2, 2, 12, 8)  # columns 1 to 4 of two rows, counted once
    assert got[2] == (["source_checksum_mismatch"], 0, 0, None, 0) and got[3][0] == ["source_dimensions_mismatch"] and got[4][0] == ["source_size_mismatch"]
    assert got[5][0] == ["source_checksum_mismatch"]
    assert got[6] == (["missing_successful_stored_segmentation"], None, 0, None, None) and got[11][0] == got[6][0]
    assert got[7][0] == ["segmentation_source_or_split_mismatch"] and got[8][0] == ["segmentation_source_dimensions_mismatch"]
    assert got[9] == (["segmentation_detection_count_mismatch"], 2, 0, None, None) and got[10] == (["duplicate_region_index"], 2, 0, None, None)
    assert got[12] == (["missing_segmentation_mask", "segmentation_mask_dimensions_mismatch", "source_size_mismatch"], 2, 0, None, None)
    one = audit.segmentation_counts(rows).first()
    assert (one.pages, one.regions, one.valid_masks, one.zero_region_pages, one.low_confidence_pages, one.failed_pages) == (12, 8, 2, 0, 2, 11)
    by = {r.measure: (r.n, r.max) for r in audit.segmentation_distributions(rows).collect()}
    assert by == {"regions_per_page": (8, 2.0), "mask_area": (1, 12.0), "union_fraction": (5, 0.2)}
    assert audit.segmentation_counts(rows.limit(0)).first().pages == 0 and audit.segmentation_distributions(rows.limit(0)).count() == 0


def test_image_audit(spark):
    rows = [(10, 5, 100, "a", "a", 10, 5), (10, 0, 50, "", "b", None, None), (4, 8, None, "c", "d", 4, 9), (4, 8, 7, None, "d", 5, 8)]
    images = spark.createDataFrame(rows, "width int, height int, size int, recorded string, found string, recorded_width int, recorded_height int")
    assert tuple(audit.image_counts(images).first()) == (4, 2, 1, 2)
    by = {r.measure: r for r in audit.image_distributions(images).collect()}
    assert (by["aspect_ratio"].n, by["aspect_ratio"].max, by["size"].n, by["size"].median, by["width"].median) == (3, 2.0, 3, 50.0, 7.0)


def test_decision_rules(spark):
    from pyspark.sql import functions as F

    from foliospark.operators import quality

    good = (" KEEP ", "training_corpus_selection", "batch_selection", 0, "test", "c")
    rows = [(1, *good), (2, "drop", *good[1:]), (3, "keep", "other", "later", -1, "pilot", "d"), (4, *[None] * 4, None, None), (5, "reject", "replacement_suitability_review", "review_evidence_only", 3, "train", "c")]
    df = spark.createDataFrame(rows, "id int, decision string, decision_scope string, selection_application string, sequence_index int, split string, corpus_id string")
    got = lambda found: {(int(r.key), r.rule.split(":")[1]) for r in found.collect()}
    plain = {(2, "decision"), (3, "decision_scope"), (3, "selection_application"), (3, "split"), (3, "negative_sequence")}
    assert got(quality.page_decisions(df, F.col("id"))) == plain
    batch = {(k, r) for k in (3, 5) for r in ("not_batch_selection", "not_corpus_scope")} | {(3, "other_corpus"), (4, "other_corpus")}
    assert got(quality.page_decisions(df, F.col("id"), corpus="c", batch=True)) == plain | batch
    own = spark.createDataFrame([(1, "Suitable_for_training_corpus", quality.SUITABILITY_SCOPE, "batch_selection"), (2, "keep", "x", "later")], "id int, decision string, decision_scope string, selection_application string")
    assert got(quality.suitability_decisions(own, F.col("id"))) == {(2, "decision"), (2, "decision_scope"), (2, "not_batch_selection")}


def test_catalogue(spark):
    from foliospark.sources import files

    fields = "manuscript_id string, source_order int, repository string, shelfmark string, title string, date_display string, date_not_before int, date_not_after int, date_method string, language string, script string, material string, metadata array<struct<label:string,value:string>>, manifest_url string, metadata_source string"
    items = [("text language", "<i>la</i>"), ("Text Language", "de"), ("TEXT LANGUAGE", "la"), ("Font", " "), ("Typeface", "A &amp; B"), ("Hand", "h"), ("Origin", "Rome"), ("Place of Origin", "Pisa"), (None, "x"), ("Persons", None), ("Material", "paper")]
    rows = [("m", 2, "late", *[None] * 11, "b"), ("m", 1, "<b>R</b>", "s", " ", "d", 1, 2, None, "en", None, "vellum", items, "u", "a"), ("n", 1, *[None] * 12, "a"), ("o", 1, *[None] * 7, "de", None, None, items, None, "a")]
    got = {r.manuscript_id: r for r in files.catalogue(spark.createDataFrame(rows, fields)).collect()}
    m = got["m"]
    assert len(m) == 24 and (m.repository, m.title, m.languages, m.script_or_hand, m.material, m.typeface_or_font) == ("R", None, ["en", "la", "de"], "h", "vellum", "A & B")
    assert (m.place_of_origin, m.persons, m.doi, m.manifest_url, m.metadata_source) == ("Rome", None, None, "u", "a")
    assert got["n"].languages == [] and got["n"].script_or_hand is None and got["o"].languages == ["la", "de"] and got["o"].material == "paper"


def test_line_spans_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(queries_raster, "SPANS_A_TASK", 500)
    spans = queries_raster._line_spans(spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id())
    held = spans.groupBy("page_id").agg(F.count_distinct("task").alias("n")).agg(F.max("n").alias("n")).first().n
    assert held == 1 and spans.select("task").distinct().count() >= 10
