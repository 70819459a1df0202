import pytest
from pyspark.sql import functions as F

from foliospark.functions.statistics import distribution
from foliospark.operators import merge as M
from foliospark.operators import quality as Q
from foliospark.operators import raster as R
from foliospark.operators import reconcile as C
from foliospark.operators import selection as S


def pages(spark, rows):
    return spark.createDataFrame(rows, "group_id string, page_id string, sequence int, reject_codes array<string>, review_codes array<string>")


def plain(spark, n=7):
    return pages(spark, [("m", f"p{k}", k, [], []) for k in range(n)] + [("m", "cover", 90, ["cover"], []), ("m", "target", 91, ["color_target"], [])])


def test_selection_fills_the_quota_and_explains_each_page(spark):
    out = {r.page_id: r for r in S.select_pages(plain(spark), seed=99, quota=3).collect()}
    by = [r.status for r in out.values()]
    assert (by.count("selected"), by.count("candidate"), by.count("rejected")) == (3, 4, 2) and all(r.reasons for r in out.values())
    assert not out["cover"].eligible and out["cover"].review_status == "not_required"
    again = S.select_pages(plain(spark).repartition(7), seed=99, quota=3)
    assert {r.page_id: r.rank for r in again.collect()} == {k: r.rank for k, r in out.items()}


def test_a_rejection_is_replaced_and_traced(spark):
    first = next(r.page_id for r in S.select_pages(plain(spark), seed=99, quota=3).collect() if r.rank == 1)
    told = spark.createDataFrame([(first, "reject")], "page_id string, decision string")
    out = S.select_pages(plain(spark), seed=99, quota=3, decisions=told)
    new = [r for r in out.collect() if r.replaces]
    assert len(new) == 1 and new[0].replaces == [first] and new[0].original_rank == 4 and "deterministic_same_manuscript_replacement" in new[0].reasons
    assert S.trace_rejections(out, quota=3).first().outcome == "replaced"
    few = S.select_pages(plain(spark, 3), seed=99, quota=3, decisions=spark.createDataFrame([("p1", "reject")], "page_id string, decision string"))
    assert S.trace_rejections(few, quota=3).first().outcome == "shortfall"


def test_keep_clears_a_doubt(spark):
    """A kept page counts against the quota and is selected; recording it as unselected would contradict the decision."""
    df = pages(spark, [("m", "a", 1, [], ["uncertain"]), ("m", "b", 2, ["blank"], []), ("n", "c", 1, [], [])])
    plainly = {r.page_id: r for r in S.select_pages(df, seed=1, quota=1).collect()}
    assert plainly["a"].review_status == "needs_manual_review" and plainly["a"].status == "candidate"
    told = spark.createDataFrame([("a", "keep")], "page_id string, decision string")
    kept = {r.page_id: r for r in S.select_pages(df, seed=1, quota=1, decisions=told, unsuitable=spark.createDataFrame([("n",)], "group_id string")).collect()}
    assert kept["a"].status == "selected" and kept["a"].review_status == "resolved_keep" and kept["c"].review_status == "manuscript_excluded"


def test_decisions_that_cannot_hold(spark):
    df = pages(spark, [("m", "a", 1, ["blank"], []), ("m", "b", 2, [], [])])
    told = spark.createDataFrame([("a", "keep", 1), ("b", "reject", 9), ("z", "reject", 1), ("b", "maybe", 2)], "page_id string, decision string, sequence int")
    assert {(r.rule, r.key) for r in S.decision_conflicts(df, told).collect()} == {("keep_overrides_rule", "a"), ("sequence_differs", "b"), ("unknown_page", "z"), ("unknown_decision", "b"), ("repeated_decision", "b")}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 33])
def test_splits_have_largest_remainder_sizes(spark, n):
    out = S.assign_splits(spark.range(n).select(F.col("id").cast("string").alias("k")), "k", seed=5).collect()
    sizes = S.split_sizes(n)
    assert {s: sum(r.split == s for r in out) for s in sizes} == sizes and sum(sizes.values()) == n
    order = [r.split for r in sorted(out, key=lambda r: r.position)]
    assert order == sorted(order, key=list(sizes).index)


def test_merge_is_idempotent_and_keeps_what_policies_protect(spark):
    kind = "id int, a string, tags array<string>, meta map<string,string>, allowed boolean"
    old = spark.createDataFrame([(1, "x", ["t"], {"review": "human", "z": "1"}, True), (2, "y", [], {}, False), (None, "n", [], {}, False)], kind)
    new = spark.createDataFrame([(1, None, [], {"review": "machine", "z": "2"}, False), (3, "w", ["u"], {}, True), (None, "m", [], {}, True)], kind)
    policy = M.Policy(coalesce=("a",), replace_if_filled=("tags",), map_merge=("meta",), guarded=("review",), frozen=("allowed",), insert_values={"allowed": False})
    out = {r.id: r for r in M.merge(old, new, ["id"], policy).collect()}
    assert (out[1].a, out[1].tags, out[1].meta, out[1].allowed, out[1].action) == ("x", ["t"], {"review": "human", "z": "2"}, True, "updated")
    assert (out[3].allowed, out[3].action) == (False, "inserted") and out[2].action == "kept" and (out[None].a, out[None].action) == ("m", "updated")
    again = M.merge(M.merge(old, new, ["id"], policy).drop("action"), new, ["id"], policy)
    assert {r.action for r in again.where("id is null or id != 2").collect()} == {"matched"}


def test_fingerprint_follows_rows_only(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    a = M.fingerprint(df).first()
    assert a == M.fingerprint(df.repartition(9).orderBy(F.desc("id"))).first() and a.rows == 300
    assert M.fingerprint(df.withColumn("s", F.coalesce("s", F.lit("")))).first().rows_sha256 != a.rows_sha256


def test_digest_tree_by_hand(spark):
    import hashlib
    from collections import Counter

    def brute(digests, leaf):
        def node(prefix, own):
            if len(own) <= leaf:
                return hashlib.sha256("".join(f"{d}:{c}" for d, c in sorted(own.items())).encode()).hexdigest()
            parts = [{d: c for d, c in own.items() if d[len(prefix)] == x} for x in "0123456789abcdef"]
            return hashlib.sha256("".join(node(prefix + x, p) for x, p in zip("0123456789abcdef", parts, strict=True) if p).encode()).hexdigest()

        return node("", Counter(digests))

    rows = [("big", hashlib.sha256(str(k % 900).encode()).hexdigest()) for k in range(2000)] + [("small", hashlib.sha256(b"x").hexdigest())] * 500 + [(None, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, d string").repartition(5)
    got = {r.g: (r.rows, r.rows_sha256) for r in M.digest_tree(df, ["g"], leaf=20).collect()}
    assert got == {g: (sum(k == g for k, _ in rows), brute([d for k, d in rows if k == g], 20)) for g in ("big", "small", None)}
    assert tuple(M.digest_tree(df.limit(0).select("d"), []).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_digest_tree_of_given_levels_lists_what_lies_below(spark):
    import hashlib

    digests = sorted(hashlib.sha256(str(k).encode()).hexdigest() for k in range(700))
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    prefixes = lambda n: sorted({d[:n] for d in digests})
    listed = lambda p: sha(f"{d}:1" for d in digests if d.startswith(p))
    df = spark.createDataFrame([(d,) for d in digests], "d string").repartition(3)
    one = M.digest_tree(df, [], leaf=4, levels=1).first()
    assert (one.rows, one.rows_sha256) == (700, sha(listed(p) for p in prefixes(1)))
    two = M.digest_tree(df, [], leaf=4, levels=2).first()
    assert two.rows_sha256 == sha(sha(listed(p) for p in prefixes(2) if p[0] == q) for q in prefixes(1))
    assert two.rows_sha256 != M.digest_tree(df, [], leaf=4).first().rows_sha256
    assert M.digest_tree(df, [], leaf=700, levels=2).first().rows_sha256 == M.digest_tree(df, [], leaf=700).first().rows_sha256 == listed("")


def test_versioned_table_survives_crashes(spark, tmp_path, monkeypatch):
    from foliospark.operators import versions as V

    home, df = V.VersionedTable(spark, str(tmp_path / "t")), spark.range(5).toDF("x")
    with pytest.raises(FileNotFoundError):
        home.read()
    assert home.write(df) and not home.write(df.repartition(3), immutable=True)
    files = lambda: sorted(str(p) for p in tmp_path.rglob("*"))
    before = files()
    assert not home.write(df) and files() == before  # an unchanged rerun writes nothing
    with pytest.raises(ValueError, match="differ"):
        home.write(df.limit(3), immutable=True)
    assert files() == before
    put = V.put_commit
    monkeypatch.setattr(V, "put_commit", lambda *a: 1 / 0)  # the driver is lost after the data and before the commit
    with pytest.raises(ZeroDivisionError):
        home.write(df.limit(3))
    assert home.read().count() == 5
    monkeypatch.setattr(V, "put_commit", put)
    assert home.write(df.limit(3)) and home.read().count() == 3
    with pytest.raises(Exception, match="2"):
        V.put_commit(spark, home.path, 2, {})  # another writer has published this number
    home.expire(keep=1)
    assert home.read().count() == 3 and len(V.commits(spark, home.path)) == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 1


def test_file_snapshot(spark):
    rows = [("a", "p1", 3, "x", 1), ("a", "p2", 4, "y", 2), (None, "p3", 5, "z", 3)]
    df = spark.createDataFrame(rows, "kind string, path string, size long, sha256 string, modified long")
    one = {r.kind: r for r in M.file_snapshot(df, "kind").collect()}
    two = {r.kind: r for r in M.file_snapshot(df.withColumn("modified", F.col("modified") + (F.col("path") == "p1").cast("long")), "kind").collect()}
    assert (one["a"].files, one["a"].bytes, one[None].files) == (2, 7, 1) and one[None] == two[None]
    assert one["a"].content_sha256 == two["a"].content_sha256 and one["a"].state_sha256 != two["a"].state_sha256


def test_distribution_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), ("c", None)], "k string, v double")
    out = {r.k: r for r in df.groupBy("k").agg(*distribution("v")).collect()}
    assert (out["a"].n, out["a"].mean, out["a"].median, out["a"].sd) == (2, 1.5, 1.5, 0.5)
    assert out["b"].sd is None and out["c"].n == 0 and out["c"].mean is None


def test_quality_rules_find_each_violation(spark):
    df = spark.createDataFrame([(1, "a", 5, None), (1, " ", 50, "x"), (2, "q", None, "y")], "id int, s string, n int, o string")
    found = Q.violations(Q.required(df, F.col("id"), ["s", "o"]), Q.domains(df, F.col("id"), {"s": ("a", " ")}), Q.ranges(df, F.col("id"), {"n": (1, 10)}), Q.unique(df, ["id"], "id"))
    assert {(r.rule, r.key) for r in found.collect()} == {("required:s", "1"), ("required:o", "1"), ("domain:s", "2"), ("range:n", "1"), ("unique:id", "1")}
    with pytest.raises(ValueError, match="required"):
        Q.enforce(found.orderBy(F.desc("rule")))
    Q.enforce(found.limit(0))


def test_rights_states(spark):
    kind = "asset_id int, status string, training_allowed boolean, review struct<review_version string, reviewer string, reviewed_at string, decision_reason string, rights_review_status string, training_allowed boolean>"
    good = ("v1", "r", "2026-01-01T00:00:00+01:00", "why", "approved_for_training", True)
    rows = [(1, "approved_for_training", True, good), (2, "pending", False, None), (3, "approved_for_training", True, None), (4, "pending", True, None), (5, "approved_for_training", True, (*good[:2], "2026-01-01T00:00:00", *good[3:])), (6, "approved_for_training", True, (*good[:4], "pending", True))]
    df = spark.createDataFrame(rows, kind)
    assert {(r.key, r.rule) for r in Q.rights_state(df, F.col("asset_id")).collect()} == {("3", "rights:provenance_missing"), ("4", "rights:flag"), ("5", "rights:time"), ("6", "rights:status_differs")}
    assert [r.asset_id for r in Q.approved(df).collect()] == [1]


def test_reconciliation(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", None)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 1), (2, "Y", None), (4, "w", 4)], "k int, s string, n int")
    assert {(r.k, r.side) for r in C.key_difference(a, b, "k").collect()} == {(3, "missing"), (4, "extra")}
    assert [(r.k, r.differing) for r in C.field_differences(a, b, ["k"], ["s", "n"]).collect()] == [(2, ["s", "n"])]
    assert {(r.k, r.change) for r in C.snapshot_changes(a, b, "k", ["s", "n"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert [r.k for r in C.orphans(a, b, "k", "k").collect()] == [3]


def grid(spark, w, h):
    return spark.range(w * h).select(F.lit(1).alias("page_id"), (F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), F.lit(w).alias("width"), F.lit(h).alias("height"))


@pytest.mark.parametrize("family", ["edge_loss", "edge_tear", "corner_loss", "internal_hole", "strip_loss", "connected_piece_loss"])
@pytest.mark.parametrize("severity", [0.3, 0.6])
def test_loss_is_calibrated_and_one_piece(spark, family, severity):
    done = R.remove_share(grid(spark, 40, 30), family, severity).cache()
    report = R.removal_report(done, severity).first()
    assert report.status == "ok" and report.error <= R.SEVERITY_TOLERANCE and report.removed_cells == round(1200 * severity)
    assert R.complement_errors(done, done.where("removed"), done.where("not removed")).count() == 0
    gone = R.spans_from_cells(done.where("removed"), ["page_id"])
    assert R.span_components(gone).select("component").distinct().count() == 1
    touched = R.topology(done).first().touched_edges.split(",")
    assert {"edge_loss": 1, "edge_tear": 1, "corner_loss": 2}.get(family, len(touched)) == len(touched)
    assert family != "internal_hole" or touched == [""]


def test_loss_that_cannot_be_is_rejected(spark):
    assert R.removal_report(R.remove_share(grid(spark, 2, 2), "internal_hole", 0.5), 0.5).first().status == "requested_area_exceeds_capacity"
    assert R.removal_report(R.remove_share(grid(spark, 2, 1), "strip_loss", 0.1), 0.1).first().status == "target_too_small_or_empty"


def test_spans(spark):
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 3, 8), (1, 0, 8, 9), (1, 0, 20, 22), (1, 1, 0, 1)], "page_id int, y int, x0 int, x1 int")
    merged = R.union_spans(spans, ["page_id"])
    assert sorted((r.y, r.x0, r.x1) for r in merged.collect()) == [(0, 0, 9), (0, 20, 22), (1, 0, 1)]
    back = R.spans_from_cells(R.cells_from_spans(merged).select("page_id", "y", "x"), ["page_id"])
    assert sorted((r.y, r.x0, r.x1) for r in back.collect()) == [(0, 0, 9), (0, 20, 22), (1, 0, 1)]
    regions = spark.createDataFrame([(1, "mask", y, 5, 15) for y in range(5, 15)] + [(1, "mask", y, 90, 110) for y in range(80, 90)] + [(1, "gone", 50, 0, 4)], "page_id int, region_id string, y int, x0 int, x1 int")
    left = spark.createDataFrame([(1, y, 0, 10) for y in range(5, 15)] + [(1, 7, 2, 12)], "page_id int, y int, x0 int, x1 int")
    out = {r.region_id: r for r in R.span_overlap(regions, left).collect()}
    assert (out["mask"].area, out["mask"].surviving, out["gone"].surviving, out["gone"].category) == (300, 52, 0, "fully_removed")
    doubled = R.scale_spans(merged, F.lit(10), F.lit(2), F.lit(20), F.lit(4))
    assert R.area(doubled, ["page_id"]).first().area == 4 * R.area(merged, ["page_id"]).first().area
    boxes = spark.createDataFrame([(1, "e", 3, 3, 3, 9), (1, "b", 0, 5, 20, 7)], "page_id int, region_id string, x0 int, y0 int, x1 int, y1 int")
    old = {r.region_id: r for r in R.box_survival(boxes, left).collect()}
    assert old["e"].fraction == 0.0 and old["e"].completely_lost and old["b"].fraction == 0.5


def test_components_of_a_comb(spark):
    comb = [(1, y, 4 * k, 4 * k + 1) for k in range(6) for y in range(9)] + [(1, 9, 0, 24)] + [(2, 0, 0, 1), (2, 0, 5, 6), (2, 1, 1, 2)]
    out = R.span_components(spark.createDataFrame(comb, "page_id int, y int, x0 int, x1 int"))
    assert {r.page_id: r.n for r in out.groupBy("page_id").agg(F.count_distinct("component").alias("n")).collect()} == {1: 1, 2: 3}


def test_a_seeded_cut_has_three_fair_pieces(spark):
    out = R.three_way_partition(grid(spark, 30, 30)).first()
    assert out.area_1 + out.area_2 + out.area_3 == 900 and min(out.area_1, out.area_2, out.area_3) >= 0.18 * 900
    again = R.three_way_partition(grid(spark, 30, 30).repartition(5)).first()
    assert again == out
    # One cell of fifty has ink: below the least, above half of the page's own.
    sparse = F.expr("(x * 7 + y * 3) % 50 = 0")
    assert R.three_way_partition(grid(spark, 30, 30), ink=sparse).count() == 0
    assert R.three_way_partition(grid(spark, 30, 30), ink=sparse, ink_shares=(0.85, 0.5)).count() == 1
    # Both layouts are drawn first for some of twenty pages.
    many = grid(spark, 30, 30).crossJoin(spark.range(1, 21).withColumnRenamed("id", "k")).withColumn("page_id", F.concat("page_id", F.lit("-"), "k"))
    assert {r.layout for r in R.three_way_partition(many).collect()} == {"T", "L"}
    assert R.three_way_partition(many, ink=F.lit(False)).count() == 0 and R.three_way_partition(many.limit(0)).count() == 0


def test_batches_and_tasks(spark):
    from foliospark.operators import reconcile

    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, url string")
    two = spark.createDataFrame([(2, "d"), (3, "a"), (None, "e")], "id int, url string")
    whole, refused = reconcile.batch_union([one, two], [["id"], ["url"]])
    assert whole.count() == 6 and {tuple(r) for r in refused.collect()} == {("shared_id", "2", 2, 2), ("shared_url", "a", 2, 2)}
    assert reconcile.batch_union([one.limit(0), two.limit(0)], [["id"]])[1].count() == 0
    planned = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 8)], "task int, n int")
    out = reconcile.register_tasks(planned, spark.createDataFrame([(3,), (3,)], "task int"), ["task"])
    assert sorted((r.n, r.action) for r in out.collect()) == [(5, "refuse"), (6, "refuse"), (7, "register"), (8, "known")]
    made = spark.createDataFrame([(2, 7), (3, 9), (4, 1)], "task int, n int")
    out = reconcile.task_differences(planned.where("task > 1 or n = 5"), made, ["task"], ["n"])
    assert sorted(map(tuple, out.collect())) == [(1, "not_generated", ""), (2, "ok", ""), (3, "differs", "n"), (4, "not_planned", "")]
    runs = spark.createDataFrame([(1, 10, '{"a": {"b": "x"}}'), (2, 11, "{}"), (3, 12, None)], "run int, asset int, props string")
    out = reconcile.batch_audit(runs, spark.createDataFrame([(10, "p"), (11, "q")], "asset int, name string"), key="asset", json_col="props", paths={"b": "$.a.b"})
    assert sorted((r.run, r.b, r.audit) for r in out.collect()) == [(1, "x", "ok"), (2, None, "missing_field"), (3, None, "missing_asset")]


def test_a_page_without_registration_is_an_error(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    sides = [
        make([(5, "m1", 1, 10), (4, "m1", 1, 10), (6, "m2", 2, 11)], "cache_id long, manifest_url string, repository_id long, manuscript_id long"),
        make([(1,)], "repository_id long"), make([(10,), (11,)], "manuscript_id long"),
        make([(100, 10, "c1"), (101, 10, "c2"), (102, 11, "c1")], "canvas_id long, manuscript_id long, canvas_url string"),
        make([(1000, 100, "u"), (1001, 101, None), (1002, 102, "u")], "asset_id long, canvas_id long, source_url string"),
    ]
    kind = "page_id string, manifest_url string, canvas_url string, source_url string"
    good = C.registration(make([("p1", "m1", "c1", "u"), ("p2", "m1", "c2", None)], kind), *sides).collect()
    assert sorted(map(tuple, good)) == [("p1", 4, 1, 10, 100, 1000), ("p2", 4, 1, 10, 101, 1001)]
    for page in (("p3", "m2", "c1", "u"), ("p4", "m1", "c1", None), ("p5", "none", "c1", "u")):
        with pytest.raises(Exception, match=f"not registered: {page[0]}"):
            C.registration(make([page], kind), *sides).collect()


def test_cells_dealt_by_page_are_counted_without_another_shuffle(spark):
    docs = spark.createDataFrame([(k, "\n".join(" ".join(["w"] * (3 + (k + y) % 5)) for y in range(4 + k % 3))) for k in range(40)], "id long, t string")
    seed = R.damage_seed("edge_tear", F.col("page_id"), 0.3)
    dealt = R.remove_share(R.text_cells(docs, "id", "t", tasks=3, seed=seed), "edge_tear", 0.3, content=F.col("y") % 2 == 0, seed="seed")
    plain = R.remove_share(R.text_cells(docs, "id", "t"), "edge_tear", 0.3, content=F.col("y") % 2 == 0)
    assert dealt.columns == plain.columns and sorted(dealt.collect()) == sorted(plain.collect())
    report = R.removal_report(dealt, 0.3)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert sorted(report.collect()) == sorted(R.removal_report(plain, 0.3).collect()) and {r.status for r in report.collect()} >= {"ok"}


def test_span_pieces_of_both_kinds_give_the_overlap_of_whole_lines(spark):
    cells = spark.createDataFrame([(1, 0, x, x in (2, 3, 7)) for x in (0, 1, 2, 3, 4, 7, 9)] + [(1, 1, x, True) for x in (0, 1)], "page_id long, y int, x int, removed boolean").withColumn("region_id", F.col("y"))
    pieces = R.spans_from_cells(cells, ["page_id", "region_id", "removed"])
    out = R.span_overlap(pieces, pieces.where("not removed").select("page_id", "y", "x0", "x1"))
    assert sorted((r.region_id, r.area, r.surviving) for r in out.collect()) == [(0, 7, 4), (1, 2, 0)]


def test_partition_counts_runs_as_it_would_cells(spark):
    from foliospark.functions.hashing import choice, stable_seed

    places = [(p, y, x, w, h) for p, (w, h) in enumerate([(9, 7), (16, 8), (31, 12), (40, 3), (1, 1)]) for y in range(h) for x in range(w) if (x * 5 + y * 3 + p) % 11]
    cells = spark.createDataFrame(places, "page_id long, y int, x int, width int, height int")
    marked = (F.col("x") * 7 + F.col("y") * 3) % 4 == 0
    out = R.three_way_partition(cells, attempts=12, ink=marked, ink_shares=(0.85, 0.5))
    got = {r.page_id: tuple(r)[1:] for r in out.collect()}
    lines = [(F.lit(low) + F.lit(high - low) * R._draw(f"{layout}{k}", "a")).alias(f"{layout}{k}") for layout, cuts in R.LAYOUTS.items() for k, (low, high) in enumerate(cuts)]
    drawn = spark.range(5).toDF("page_id").select("page_id", choice(stable_seed("layout", F.col("page_id")), ["T", "L"]).alias("drawn"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("a")).select("page_id", "drawn", "a", *lines).collect()
    want = {}
    for d in drawn:
        own = [((y + 0.5) / h, (x + 0.5) / w, (x * 7 + y * 3) % 4 == 0) for p, y, x, w, h in places if p == d.page_id]
        for layout in "TL":
            n, i = [0, 0, 0], [0, 0, 0]
            for v, u, inked in own:
                one, two = (v < d.T0, u < d.T1) if layout == "T" else (u < d.L0, v < d.L1)
                k = 0 if one else 1 if two else 2
                n[k], i[k] = n[k] + 1, i[k] + inked
            if min(n) == 0 or min(n) < len(own) * R.PIECE_AREA:
                continue
            least, dense = min(a / b for a, b in zip(i, n, strict=True)), sum(i) / sum(n)
            for level, s in enumerate((0.85, 0.5)):
                if least >= min(R.PIECE_INK, s * dense):
                    want.setdefault(d.page_id, []).append((level, layout != d.drawn, d.a, layout, *n))
                    break
    assert got == {p: (c[3], c[2], *c[4:]) for p, c in ((p, min(cs)) for p, cs in want.items())} and len(got) > 2
    assert "x0" in out._jdf.queryExecution().analyzed().toString()  # runs, not cells, meet the attempts
