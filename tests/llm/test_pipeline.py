"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import defaultdict

import corpus_pipeline
from foliospark.llm import quality
from foliospark.llm.tokens import default_tokenizer, load

from .test_text_operators import brute_hits, brute_lines
from .test_vector_operators import brute_components


def tables(spark, home, words):
    shared = "This line stands in very many of the documents here"
    rows = [(k, f"{words(k, 90)}\n{shared}\n{words(k + 500, 30)}") for k in range(60)]
    rows += [(k, words(k, 60).upper().replace(" ", "!! ")) for k in range(100, 130)]
    near = rows[5][1].split(" ")  # an edit in a hundred words
    near[20] = "edited"
    rows += [(200, rows[7][1]), (201, " ".join(near)), (202, words(8, 40) + " " + words(900, 12) + " end"), (203, ""), (204, None), (205, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 130), 0) for i, _ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, words(900, 12)), (2, "not to be found anywhere")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return docs


def test_each_stage_matches_brute_force(spark, tmp_path, words):
    home = str(tmp_path / "sf")
    docs = tables(spark, home, words)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "line_dedup", "simhash", "decontamination", "packing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = quality.train(docs, spark.read.parquet(f"{home}/labels.parquet"))
    kept = rows(steps["quality"](spark, docs, home))
    assert kept == {r.doc_id: r.text for r in docs.collect() if model.score(*quality.features(None if r.text is None else r.text.encode(), r.n_chars)) >= 0.3}
    assert set(range(60)) <= set(kept) and not set(kept) & set(range(100, 130))

    one = docs.where(docs.doc_id.isin(list(kept)))
    two_df = steps["line_dedup"](spark, one, home)
    two = rows(two_df)
    assert sorted((i, t or "") for i, t in two.items()) == [(i, t) for i, _, _, t in brute_lines(list(kept.items()))]
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in two_df.collect())

    def shingles(text):
        own = (text or "").encode().lower().split()
        return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    sets = {i: shingles(t) for i, t in two.items()}

    def linked(a, b):
        return sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    ids = sorted(two)
    roots = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(a, b)])
    three = rows(steps["simhash"](spark, two_df, home))
    assert set(three) == {i for i in ids if roots[i] == i}
    assert 200 not in three

    items = [(1, words(900, 12)), (2, "not to be found anywhere")]
    three_df = two_df.where(two_df.doc_id.isin(list(three)))
    four_df = steps["decontamination"](spark, three_df, home)
    four = rows(four_df)
    assert set(four) == {i for i, t in three.items() if not brute_hits(t, items)[1]} and 202 not in four and 202 in three
    assert four_df.columns == docs.columns

    tokenizer, by, pieces = load(default_tokenizer()), defaultdict(list), defaultdict(int)
    for r in steps["packing"](spark, four_df, home).collect():
        by[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in four.items()}
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.doc_id for r in corpus_pipeline.run(spark, home).select("doc_id").distinct().collect()} == set(four)

CLASHING = ("_id", "_gone", "_length", "_lines", "_own", "_digest", "Score", "N_WORDS", "items", "n_lines", "N_dropped", "hit_words", "Component_ID", "gone", "in_0", "length", "unit")


def test_stages_keep_clashing_columns(spark, tmp_path, words):
    """Columns named like an operator's own, in any case, come out of every stage with the values that went in."""
    home = str(tmp_path / "sf")
    plain = tables(spark, home, words)
    # Values follow the document, so that a value that stands for another one shows.
    more = plain.selectExpr(*[f"concat('{c}', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHING[:8]], "*", *[f"array(doc_id, {k}) AS `{c}`" for k, c in enumerate(CLASHING[8:])])
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, more, home)
        assert out.columns == more.columns and out.schema == more.schema, name
        got = {r.doc_id: r for r in out.collect()}
        assert got and set(got) == {r.doc_id for r in step(spark, plain, home).collect()}, name
        for r in more.collect():
            for c in more.columns:
                if r.doc_id in got and not (name == "line_dedup" and c in ("text", "n_chars")):
                    assert got[r.doc_id][c] == r[c], (name, c)
    packed = corpus_pipeline.STAGES[-1][1](spark, more, home)
    assert packed.count() >= more.count()


def test_operators_replace_results_in_any_case(spark, docs, words):
    from pyspark.sql import functions as F

    from foliospark.llm import decontaminate, line_runs

    odd = docs([(k, words(k, 30)) for k in range(6)]).withColumn("_gone", F.lit("g")).withColumn("_lines", F.lit("l")).withColumnRenamed("n_words", "N_Words").withColumnRenamed("score", "SCORE").withColumn("N_LINES", F.lit(9)).withColumn("Items", F.lit(8))
    lines = line_runs.dedup_lines(odd)
    assert {r.n_lines for r in lines.collect()} == {1} and {(r["_gone"], r["_lines"]) for r in lines.collect()} == {("g", "l")}
    found = decontaminate.find_contamination(odd, spark.createDataFrame([(1, "none of it")], "item_id long, text string"))
    assert {r.n_words for r in found.collect()} == {30}
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score_documents(odd, model).collect()} == {0.5}
