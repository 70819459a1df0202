import json

import pytest
from pyspark.sql import functions as F

from foliospark.plans import planning as P
from foliospark.plans import queries_files
from foliospark.sources import files, manifests, matrix
from foliospark.streaming import ingest

V2 = {
    "@id": "urn:m2", "@type": "sc:Manifest", "label": "Codex", "license": "https://creativecommons.org/publicdomain/mark/1.0/", "attribution": ["A", "B"],
    "metadata": [{"label": "Shelfmark", "value": "MS 1"}, {"label": "Date of Origin", "value": "12th century"}, {"label": "Material", "value": "Pergament"}, "no object", {"label": None, "value": None}],
    "sequences": [{"canvases": [{"@id": "c1", "label": "fol. 1r", "width": 1200, "height": 1800, "images": [{"resource": {"@id": "i1", "format": "image/jpeg", "width": 1200, "height": "x", "service": {"@id": "s1"}}}]}, 5, {"label": "no id", "images": []}]}, {"canvases": [{"@id": "other"}]}],
}
V3 = {
    "id": "urn:m3", "type": "Manifest", "label": {"de": ["Blatt"], "en": ["Leaf", "Two"]}, "rights": "http://x", "provider": [{"id": "p", "label": {"none": ["Library"]}}], "metadata": [{"label": {"en": ["Text Language"]}, "value": {"none": ["Latin"]}}],
    "items": [{"id": "c", "type": "Canvas", "label": {"none": ["1v"]}, "width": 10, "height": 20, "items": [{"items": [{"body": [{"id": "i", "type": "Image", "service": [{"id": "s"}]}, {"id": "t", "type": "Text"}]}]}]}],
}


def read(spark, *docs):
    return manifests.parse(spark.createDataFrame([(str(k), d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "source string, raw string"))


def test_both_manifest_versions_flatten(spark):
    rows = read(spark, V2, V3, "{broken", {"x": 1}, {"items": []})
    assert {r.source: r.reason for r in manifests.quarantine(rows).collect()} == {"2": "malformed_json", "3": "unrecognized_manifest"}
    top = {r.source: r for r in manifests.manifests_table(rows).collect()}
    assert (top["0"].label, top["0"].attribution, top["0"].policy.publication_allowed, top["0"].policy.training_allowed) == ("Codex", "A; B", True, False)
    assert (top["1"].label, top["1"].attribution, top["1"].policy.access_level) == ("Leaf; Two", "Library", "internal") and top["4"].version == 3
    assert len(top["0"].metadata) == 3
    fields = {r.source: r for r in manifests.standard_fields(manifests.manifests_table(rows)).collect()}
    assert (fields["0"].shelfmark, fields["0"].date.not_before, fields["0"].material_type, fields["1"].language) == ("MS 1", 1101, ["parchment"], "Latin")
    canvases = {(r.source, r.canvas_id): r for r in manifests.canvases_table(rows).collect()}
    assert set(canvases) == {("0", "c1"), ("0", "unknown-v2-canvas-2"), ("1", "c")}
    first, leaf = canvases["0", "c1"], canvases["1", "c"]
    assert (first.label, first.width, first.images[0].source_url, first.images[0].service_url, first.images[0].height) == ("fol. 1r", 1200, "i1", "s1", None)
    assert [i.source_url for i in leaf.images] == ["i"] and leaf.images[0].service_url == "s"
    assert manifests.images_table(manifests.canvases_table(rows)).count() == 2


def test_containers_nest_at_any_depth(spark):
    deep = "end"
    for _ in range(200):
        deep = [{"x": [], "y": {"none": [deep]}}]
    cases = ["a", "", 5, None, [], {}, ["a", "", ["b", {"de": "c"}]], {"value": {"en": "v"}}, {"value": 3, "none": "n"}, {"none": "", "en": "e"}, {"de": "", "fr": ["f"]}, deep]
    rows = read(spark, *[{"items": [], "label": c, "metadata": [{"label": c, "value": "w"}, {"label": None}, 7]} for c in cases], {"items": [], "metadata": "none"})
    out = {int(r.source): r for r in manifests.manifests_table(rows).collect()}
    assert [out[k].label for k in range(len(cases))] == ["a", "", "5", None, None, None, "a; b; c", "v", "3", "", "f", "end"]
    assert [out[k].metadata[0].label for k in range(len(cases))] == [out[k].label for k in range(len(cases))] and all(len(out[k].metadata) == 1 for k in range(len(cases)))
    assert out[len(cases)].metadata == [] and out[len(cases)].label is None


def test_files_by_digest_and_reference(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.tar.gz").write_bytes(b"1234567890")
    (tmp_path / "b.png").write_bytes(b"12")
    found = files.inventory(spark, str(tmp_path), digest_limit=5).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))
    out = {r.path: r for r in found.collect()}
    assert out["x.tar.gz"].sha256 is None and out["x.tar.gz"].kind == "archive" and out["b.png"].size == 2 and len(out["b.png"].sha256) == 64
    wanted = spark.createDataFrame([("b.png",), ("lost",)], "path string")
    assert {r.path: r.error for r in files.artifact_references(wanted, found).collect()} == {"b.png": None, "lost": "missing_artifact:lost"}
    assert [r.path for r in files.largest(found, 1).collect()] == ["x.tar.gz"]


def test_inventory_reads_no_contents_over_the_limit(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x" * 5000)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/s.txt").write_bytes(b"1")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # reading more is an error
    try:
        out = {r.path[-7:]: (r.size, r.status) for r in files.inventory(spark, str(tmp_path), digest_limit=100).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert out == {"big.bin": (5000, "too_large_to_hash"), "a/s.txt": (1, "hashed")}


def test_corpus_documents_of_many_lines_and_in_arrays(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "corpus_id": "c",\n "manuscripts": [{"id": "m1", "split": "train", "pages": [{"page_id": "p1", "position": 1},\n {"page_id": "p2"}]}, {"id": "m2", "pages": []}]\n}')
    (tmp_path / "two.json").write_text('[{"corpus_id": "d", "manuscripts": [{"id": "m3", "more": 1}]}, {"corpus_id": "e", "manuscripts": []}]')
    rows = files.read_corpus(spark, str(tmp_path), queries_files._CORPUS).collect()
    assert sorted((r.corpus_id, r.manuscript_id, r.split or "", r.page.page_id if r.page else "") for r in rows) == [("c", "m1", "train", "p1"), ("c", "m1", "train", "p2"), ("c", "m2", "", ""), ("d", "m3", "", "")]
    assert {r.source.rsplit("/", 1)[1] for r in rows} == {"one.json", "two.json"}


def header(extra=""):
    return ",".join(["Damage ID", "Content ID", "Content type", "Damage type", "Visual class", *[f"S{s} {f}" for s in range(1, 5) for f in matrix.LEVEL_FIELDS.values()]]) + extra


def line(damage, content="c", name="Interior loss", cls="Absent", levels=(("generate for general training", "n"),) * 4):
    return ",".join([damage, content, "text", name, cls, *[f"{d},{n}," for d, n in levels]])


def test_matrix_import_and_plan(spark, tmp_path):
    path = tmp_path / "m.csv"
    mixed = (("do not generate", "n"), ("generate as edge case", " n "), ("??", "n"), ("generate for general training", ""))
    path.write_text("﻿" + "\n".join([header(), line("D2-01", levels=mixed), line("D2-06", name="Surface coating", cls="Obscured"), line("D2-02", name="Wrong"), line("X")]), encoding="utf-8")
    planned = P.plan(matrix.to_levels(matrix.read_matrix(spark, str(path))))
    got = {(r.source_row, r.severity): (r.status, r.area_fraction) for r in planned.collect()}
    assert [got[2, f"S{k}"][0] for k in range(1, 5)] == ["do_not_generate", "edge_case_opt_in_required", "matrix_review_required", "matrix_review_required"]
    assert got[2, "S2"][1] == 0.125 and {got[3, s][0] for s in ("S1", "S4")} == {"operator_not_implemented"} and {got[r, "S1"][0] for r in (4, 5)} == {"matrix_review_required"}
    assert P.plan(matrix.to_levels(matrix.read_matrix(spark, str(path))), include_edge_cases=True).where("status = 'eligible'").count() == 1
    with pytest.raises(ValueError, match="unknown content"):
        P.plan(matrix.to_levels(matrix.read_matrix(spark, str(path))), content_id="none")
    path.write_text("\n".join([header(), line("D2-01", levels=((' do not generate ', '"a ""b"",\nc"'),) * 4)]))
    assert {(r.decision, r.note, r.source_row) for r in matrix.to_levels(matrix.read_matrix(spark, str(path))).collect()} == {("do not generate", 'a "b",\nc', 2)}
    for bad, why in ((header() + "\nD2-01,c", "malformed"), (header() + "\n" + line("D2-01") + ",more", "malformed"), ("Content ID\nx", "lacks"), (header() + "\n" + line("D2-01") + "\n" + line("D2-01"), "repeated"), (header(), "empty")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            matrix.read_matrix(spark, str(path))


def test_vocabulary_rows(spark):
    rows = spark.createDataFrame([(1, "Notation", "x"), (2, "HSP-A01", "123e4567-e89b-12d3-a456-426614174000"), (3, " ", None), (4, "---", None), (5, "HSP-B02", "Group"), (6, "HSP-C3", None)], "row int, n string, g string")
    out = {r.notation: (r.source_row, r.norm_uuid is not None, r.code_group) for r in files.vocabulary(rows, notation="n", group_or_uuid="g", order="row").collect()}
    assert out == {"HSP-A01": (2, True, "A-code"), "HSP-B02": (5, False, "Group"), "HSP-C3": (6, False, "C-code")}


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    kind = "k int, v string, t int"
    land, snap, off = (str(tmp_path / x) for x in ("land", "snap", "off"))
    run = lambda: ingest.ingest(spark, land, snap, off, schema=kind, keys=["k"], order="t")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], kind).write.parquet(land)
    run()
    assert {(r.k, r.v) for r in ingest.current(spark, snap, kind).collect()} == {(1, "b"), (2, "c")}
    run()  # nothing new
    spark.createDataFrame([(2, "d", 5), (3, "e", 1)], kind).write.mode("append").parquet(land)
    run()
    assert {(r.k, r.v) for r in ingest.current(spark, snap, kind).collect()} == {(1, "b"), (2, "d"), (3, "e")}


def test_generation_skips_test_pages(spark):
    pages = spark.createDataFrame([(1, "c", "D2-02", "S3", "train"), (2, "c", "D2-02", "S3", "test"), (3, "x", "D2-02", "S3", "train")], "page_id int, content_id string, damage_id string, severity string, split string")
    cells = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i")).select("page_id", (F.col("i") / 10).cast("int").alias("y"), (F.col("i") % 10).alias("x"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    planned = spark.createDataFrame([("c", "D2-02", "S3", "eligible", "edge_loss", 0.35)], "content_id string, damage_id string, severity string, status string, family string, area_fraction double")
    seen, gone, skipped = P.generate(pages, cells, planned, {"edge_loss": 0.35})
    assert (seen.count(), gone.count(), {r.page_id for r in seen.collect()}) == (65, 35, {1})
    assert {(r.page_id, r.status) for r in skipped.collect()} == {(2, "frozen_test_page"), (3, "no_matrix_row")}


def test_ingest_rewrites_touched_buckets_only(spark, tmp_path):
    from foliospark.operators.versions import commits, load_commit

    land, snap, kind = str(tmp_path / "in"), str(tmp_path / "snap"), "k long, v string, t long"
    put = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(land)
    run = lambda off: ingest.ingest(spark, land, snap, str(tmp_path / off), schema=kind, keys=["k"], order="t", buckets=16)
    put([(k, "a", 1) for k in range(200)])
    run("off")
    first = load_commit(spark, snap, commits(spark, snap)[-1])["buckets"]
    put([(7, "b", 2)])
    run("off")
    second = load_commit(spark, snap, commits(spark, snap)[-1])["buckets"]
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    assert {(r.k, r.v) for r in ingest.current(spark, snap, kind).collect()} == {(k, "b" if k == 7 else "a") for k in range(200)}
    run("other")  # a stream that starts anew reads everything again and merges it to the same snapshot
    assert ingest.current(spark, snap, kind).count() == 200 and len(commits(spark, snap)) == 2


def test_json_members_at_any_depth(spark):
    import json

    from foliospark.sources import json_tree as J

    def walk(value, path, out):
        for key, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            out.append((tuple(path + [str(key)]), key if isinstance(value, dict) else None, json.dumps(child, separators=(",", ":"))))
            walk(child, path + [str(key)], out)
        return out

    deep = {"Leaf-ID": "x"}
    for k in range(12):
        deep = [deep] if k % 2 else {"metadata": [deep, {"label": f"l{k}"}], "paired_canvas_id": 0}
    texts = [json.dumps(deep), "[1,[2,{\"opposite_side\":false}],{}]", '"plain"', "broken{", None, "{}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    members = J.json_members(docs, ["id"], "body")
    got = sorted((r.id, tuple(r.path), str(r.key), r.v) for r in members.selectExpr("id", "path", "key", "to_json(value) v").collect())
    assert got == sorted((i, p, str(k), v) for i, t in enumerate(texts[:3]) for p, k, v in walk(json.loads(t), [], []))
    assert [r.term for r in J.term_members(members).collect()] == ["leaf_id"]
    assert {r.label: r["items"] for r in J.label_catalogue(members).collect()} == {f"l{k}": 1 for k in range(0, 12, 2)}
    assert {r.key: (r.members, r.documents) for r in J.key_catalogue(members, ["id"]).collect()}["paired_canvas_id"] == (6, 1)


def test_landing_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"S{k}") for k in range(60)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(queries_files, "FILES_A_TASK", 10)
    landed = queries_files.land_suppliers(spark, str(tmp_path))
    found = files.inventory(spark, landed).select(F.regexp_extract("path", r"/part-(\d+)-", 1).alias("task")).collect()
    assert len(found) == 66 and len({r.task for r in found}) > 3
