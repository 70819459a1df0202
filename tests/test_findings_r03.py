"""Findings of round 3: results and bounds that only show on larger tables."""

import hashlib
import random
import statistics

from foliospark.operators import merge, profile, ranking
from foliospark.operators import quality as Q
from foliospark.operators import raster as R


def test_unique_counts_fields_as_they_are(spark):
    rows = spark.createDataFrame([("null", "a"), (None, "a"), ("x|y", "z"), ("x", "y|z"), ("d", "e"), ("d", "e"), (None, "b"), (None, "b")], "p string, q string")
    want = {("unique:k", "d|e", "2"), ("unique:k", "null|b", "2")}
    for tasks in (None, 3):
        assert {tuple(r) for r in Q.unique(rows, ["p", "q"], "k", tasks=tasks).collect()} == want


def test_foreign_keys_dealt_to_tasks(spark):
    children = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,), (None,)], "c int")
    parents = spark.createDataFrame([(2,), (2,), (None,)], "p int")
    for tasks in (None, 3):
        found = Q.foreign_keys(children, parents, "c", "p", "f", tasks=tasks)
        assert {tuple(r) for r in found.collect()} == {("foreign_key:f", "1", "2"), ("foreign_key:f", "3", "3")}


def test_required_fields_shuffles_no_text(spark, tmp_path):
    from foliospark.plans.queries_quality import required_fields

    docs = [(1, "  ", "en"), (2, " a b", " "), (3, None, "en"), (4, "c", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = required_fields(spark, str(tmp_path))
    assert {(r.key, r.detail) for r in found.collect()} == {("1", "text"), ("2", "lang"), ("3", "text"), ("4", "quality")}
    joined = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].splitlines() if "Project" in line)
    assert "left(" in joined or "substring" in joined.lower()


def _values():
    rows = [("a", float(i * 7 % 23)) for i in range(200)] + [("b", 1.5), ("b", None), (None, 2.0), (None, 4.0), ("n", None)]
    return rows, {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None, "n")}


def test_profile_of_counts(spark):
    rows, values = _values()
    df = spark.createDataFrame([(*r, 3) for r in rows] + [("b", 9.0, 1)], "g string, v double, c long")
    got = {r.g: r for r in profile.profile(df, ["g"], "v", weight="c").collect()}
    assert set(got) == set(values) and got["n"][1:] == (0, None, None, None, None, None)
    for g, v in (("a", values["a"] * 3), ("b", [1.5] * 3 + [9.0]), (None, [2.0, 4.0] * 3)):
        assert got[g][1:] == (len(v), round(statistics.fmean(v), 10), statistics.median(v), min(v), max(v), round(statistics.pstdev(v), 10))


def test_places_in_one_task_and_in_ranges(spark):
    rows, values = _values()
    counted = spark.createDataFrame(rows, "g string, _value double").groupBy("g", "_value").count().withColumnRenamed("count", "_count")
    places = lambda n: sorted((tuple(r) for r in ranking.counted_places(counted, ["g"], n).collect()), key=str)
    assert places(0) == places(5) == places(1000)
    whole = counted.drop("g")
    assert sorted(map(tuple, ranking.counted_places(whole, [], 0).where("_value > 20").collect())) == sorted(map(tuple, ranking.counted_places(whole, [], 1000).where("_value > 20").collect()))


def test_profile_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i % 3, float(i)) for i in range(60)], "g int, v double").mapInArrow(count, "g int, v double")
    assert profile.profile(df, ["g"], "v").count() == 3
    assert reads.value == 60


def _spans(seed: int) -> list[tuple]:
    """Twelve pages of random cells as runs, some of whose rows are empty."""
    draw, out = random.Random(seed), []
    for page in range(12):
        for y in range(15):
            row = "".join(draw.choice("##. ") if y % 6 != 5 else "." for _ in range(20)).replace(" ", ".") + "."
            x = 0
            for part in row.split("."):
                if part:
                    out.append((page, y, x, x + len(part)))
                x += len(part) + 1
    return out


def test_components_in_tasks_equal_those_in_rounds(spark):
    spans = spark.createDataFrame(_spans(1) + [(20, 0, 0, 4), (20, 0, 2, 6), (20, 1, 5, 7)], "page_id int, y int, x0 int, x1 int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sorted(map(tuple, R.span_components(spans).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted(map(tuple, R.span_components(spans, in_task=0).collect()))
    assert len(found) == spans.count() and len({r[2] for r in found if r[0] == 3}) > 3


def test_components_of_usual_pages_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(R, "_components_in_rounds", lambda *_: 1 / 0)
    snake = [(1, y, 0, 9) if y % 2 == 0 else (1, y, 8 if y % 4 == 1 else 0, 9 if y % 4 == 1 else 1) for y in range(400)]
    out = R.span_components(spark.createDataFrame(snake, "page_id int, y int, x0 int, x1 int"))
    assert {r.component for r in out.collect()} == {1}


def test_digests_travel_as_bytes(spark, monkeypatch):
    kinds, plain = [], merge.staged
    monkeypatch.setattr(merge, "staged", lambda df: kinds.append(df.schema["d"].dataType.simpleString()) or plain(df))
    digests = [hashlib.sha256(str(i % 300).encode()).hexdigest() for i in range(400)]
    counted = sorted((d, digests.count(d)) for d in set(digests))
    listed = lambda p: hashlib.sha256("".join(f"{d}:{c}" for d, c in counted if d.startswith(p)).encode()).hexdigest()
    rows = spark.createDataFrame([(d,) for d in digests], "d string")
    assert tuple(merge.digest_tree(rows, [], leaf=300).first()) == (400, listed(""))
    assert tuple(merge.digest_tree(rows, [], leaf=100).first()) == (400, hashlib.sha256("".join(listed(p) for p in "0123456789abcdef").encode()).hexdigest())
    assert kinds == ["binary", "binary"]
