import uuid

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry, hashing, rules
from foliospark.functions import text as T


def one(spark, col, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(col.alias("v")).first().v


def test_uuid5_matches_the_standard(spark):
    names = ["", "a", "é ü", "x" * 500]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", hashing.uuid5(str(uuid.NAMESPACE_URL), F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_null_parts_of_a_digest_are_told_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(hashing.stable_digest(F.col("x"), F.col("y")).alias("d"))
    assert df.distinct().count() == 2


@pytest.mark.parametrize("display,want", [
    (None, (None, None, "unavailable")), ("", (None, None, "unavailable")), ("9th century", (801, 900, "broad_century_range_inferred_from_source_display")),
    ("12th or 13th century", (1201, 1300, "broad_century_range_inferred_from_source_display")), ("ca. 1450", (None, None, "comparator_language_preserved_unparsed")), ("1440-1450", (1440, 1450, "year_tokens_extracted_from_source_display")),
    ("12345", (None, None, "display_preserved_unparsed")), ("Carolingian", (None, None, "display_preserved_unparsed")),
])
def test_date_ranges(spark, display, want):
    got = spark.createDataFrame([(display,)], "d string").select(T.date_range(F.col("d")).alias("v")).first().v
    assert (got.not_before, got.not_after, got.method) == want


@pytest.mark.parametrize("fraction,want", [(0.0, "fully_removed"), (0.01, "mostly_destroyed"), (0.05, "mostly_destroyed"), (0.0500001, "partial"), (0.9499, "partial"), (0.95, "almost_complete"), (1.0, "almost_complete"), (None, "undefined")])
def test_survival_boundaries(spark, fraction, want):
    assert spark.createDataFrame([(fraction,)], "f double").select(T.survival_category(F.col("f")).alias("v")).first().v == want


def test_survival_outside_the_unit_interval_is_refused(spark):
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.5,)], "f double").select(T.survival_category(F.col("f"))).collect()


def test_label_rules_by_version(spark):
    labels = {"Front cover": ["cover"], "paste-down": ["paste_down"], "Colour target": ["color_target"], "fol. 1r": [], "Ruler on page": [], "Digital ColorChecker": [], None: []}
    newer = {**labels, "Ruler on page": ["digitization_target"], "Digital ColorChecker": ["color_target"]}
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    for own, want in ((rules.REJECTION_V1, labels), (rules.REJECTION_V2, newer)):
        got = {r.l: [m.code for m in r.m] for r in df.select("l", rules.rule_matches(F.col("l"), own).alias("m")).collect()}
        assert got == want
    assert df.select(rules.rule_matches(F.lit("the cover"), rules.REJECTION_V1).alias("m")).first().m[0].evidence == " cover"
    assert [m.code for m in one(spark, rules.rule_matches(F.lit("Accompanying materials 2r"), rules.REVIEW_V2))] == ["uncertain_accompanying_materials"]


def test_rights_follow_the_licence_but_training_never(spark):
    for licence, public in (("https://creativecommons.org/publicdomain/mark/1.0/", True), ("https://creativecommons.org/licenses/by-nc/4.0/", False), (None, False)):
        got = spark.createDataFrame([(licence,)], "l string").select(T.rights_policy(F.col("l")).alias("v")).first().v
        assert (got.training_allowed, got.publication_allowed, got.access_level) == (False, public, "public" if public else "internal")


def test_small_texts(spark):
    assert one(spark, T.slug(F.lit("--a b/c.--"))) == "a-b-c" and one(spark, T.slug(F.lit("???"))) == "asset"
    assert one(spark, T.extension(F.lit("/x/y.TAR.GZ"))) == "tar.gz" and one(spark, T.path_stem(F.lit("/x/y.z.png"))) == "y.z"
    assert one(spark, T.plain_html(F.lit("<b>a &amp;lt; b</b>"))) == "a &lt; b" and one(spark, T.plain_html(F.lit("<br>"))) is None
    assert one(spark, T.leaf_side(F.lit("fol. 3V"))) == "verso" and one(spark, T.page_of_file(F.lit("A_12_x.png"))) == "A_12"
    assert one(spark, T.human_bytes(F.lit(1536))) == "1.5 KB" and one(spark, T.code_group(F.lit("HSP-C012"))) == "C-code"
    assert one(spark, T.json_keys(F.lit('{"a-B": {"c": 1}}'))) == ["a_b", "c"]
    assert one(spark, T.image_request(F.lit("https://x/iiif/1/"), F.lit(None))) == "https://x/iiif/1/full/full/0/default.jpg"
    assert one(spark, T.image_request(F.lit(""), F.lit("https://x/a.jpg"))) == "https://x/a.jpg"
    with pytest.raises(Exception, match="neither"):
        one(spark, T.image_request(F.lit(None).cast("string"), F.lit("")))


def test_boxes_and_transforms(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geometry.clip_box(*n(5, 5, 5, 9), F.lit(10), F.lit(10))) is None
    box = one(spark, geometry.clip_box(*n(-5, 2, 20, 4), F.lit(10), F.lit(10)))
    assert (box.x0, box.y0, box.x1, box.y1, box.w) == (0, 2, 10, 4, 10)
    cell = one(spark, geometry.pixel_rectangle(*n(1.2, -3, 4.1, 50), F.lit(10), F.lit(10)))
    assert (cell.x0, cell.y0, cell.x1, cell.y1) == (1, 0, 5, 10)
    m = geometry.placement(F.lit(10.0), F.lit(20.0), 90, 2.0)
    there = one(spark, geometry.apply(m, F.lit(3.0), F.lit(4.0)))
    assert (round(there.x, 6), round(there.y, 6)) == (32, 6)
    same = one(spark, geometry.apply(geometry.compose(geometry.invert(m), m), F.lit(3.0), F.lit(4.0)))
    assert (round(same.x, 6), round(same.y, 6)) == (3, 4)
    assert one(spark, geometry.invert(geometry.affine(1, 2, 0, 2, 4, 0))) is None


def test_character_references_are_undone_once(spark):
    import html

    texts = ["M&uuml;nchen &amp; K&ouml;ln", "&amp;lt;b&amp;gt;", "&#233;&#xE9;&#x1F600;", "&unknown; & &&amp;", "&copy 1900", "no reference", "", "&nbsp;x&NotEqualTilde;", "a;b&#0;", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.unescape_html(F.col("t")).alias("u")).collect()
    for r in rows:
        if texts[r.k] is None:
            assert r.u is None
        elif "&#0;" not in texts[r.k]:  # not a character: stays as it is
            assert r.u == html.unescape(texts[r.k]), texts[r.k]
    assert spark.createDataFrame([("<p> S&ouml;hne </p>",), ("<br>",)], "t string").select(T.plain_html(F.col("t")).alias("p")).collect() == [("S\xf6hne",), (None,)]


def test_references_without_a_semicolon_stay_when_closed_ones_are_asked_for(spark):
    for text, plain, closed in (("a&am<style>p{margin:0}", "a&{margin:0}", "a&amp{margin:0}"), ("&lt;&lt x&#39;&#39 &amp;lt;", "<< x'' &lt;", "<&lt x'&#39 &lt;"), ("&unknown; &", "&unknown; &", "&unknown; &")):
        assert (one(spark, T.plain_html(F.lit(text))), one(spark, T.plain_html(F.lit(text), closed=True))) == (plain, closed)


def test_sizes_stop_at_the_largest_unit(spark):
    sizes = F.array(*[F.lit(n).cast("long") for n in (5, 1 << 10, 3 << 19, (1 << 40) - 1, 1 << 40, 5 << 42)])
    shown = lambda **k: one(spark, F.transform(sizes, lambda n: T.human_bytes(n, **k)))
    assert shown() == ["5 B", "1.0 KB", "1.5 MB", "1024.0 GB", "1.0 TB", "20.0 TB"]
    assert shown(largest="GB") == ["5 B", "1.0 KB", "1.5 MB", "1024.0 GB", "1024.0 GB", "20480.0 GB"]


def test_json_keys_of_odd_texts(spark):
    texts = ['{"a-B": 1, "c\\"d": {"x": 2}}', '{"s": "\\"y\\": 1"}', "[1]", "broken", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.json_keys(F.col("t")).alias("keys")).orderBy("k").collect()
    assert [r["keys"] for r in rows] == [["a_b", 'c"d', "x"], ["s"], [], [], []]
