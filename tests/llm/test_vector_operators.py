import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import multi_index, quality, simhash, url_filter
from foliospark.llm.components import connected_components


def brute_components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7), (-3, -9)]
    ids = {x for p in links for x in p}
    edges = spark.createDataFrame([*links, (None, 4), *links[:10]], "a long, b long").repartition(7)
    got = {x.node: x.root for x in connected_components(edges).collect()}
    want = brute_components(ids, links)
    assert {i: got.get(i, i) for i in ids} == want
    assert connected_components(edges.limit(0)).count() == 0


def brute_print(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    h = [xxhash.xxh64_intdigest(b" ".join(words[a : a + k]), 42) for a in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links_all_close_fingerprints(spark, docs, words, monkeypatch):
    r = random.Random(1)
    rows = [(k, words(k, 40)) for k in range(40)]
    for k in range(40, 120):
        own = rows[r.randrange(40)][1].split()
        own[r.randrange(40)] = "edit"
        rows.append((k, " ".join(own)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (5, rows[5][1]), (None, rows[6][1]), (210, "w " * 30_000)]
    for bits, m, small in ((2, 7, 32), (5, 11, 0), (5, 11, 32)):
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        monkeypatch.setattr(simhash, "BLOCK_ROWS", 5)
        out = simhash.simhash_groups(docs(rows), shingle=3, max_bits=bits, segments=m, size_ratio=0, verify_shingle=0).collect()
        assert len(out) == len(rows)
        prints = {i: brute_print(t, 3) for i, t in rows if i is not None}
        assert {x.doc_id: x.fp % (1 << 64) for x in out if x.doc_id is not None} == prints
        ids = sorted(prints)
        links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= bits]
        assert {x.doc_id: x.component_id for x in out if x.doc_id is not None} == brute_components(ids, links)
    assert simhash.simhash_groups(docs([])).count() == 0


def test_ring_never_loses_a_pair():
    r = random.Random(5)
    for bits, m in ((2, 7), (7, 15), (8, 17), (3, 5)):
        exact, chains = simhash.ring(bits, m)
        assert exact >= 1
        for _ in range(500):
            diff = sum(1 << b for b in r.sample(range(64), r.randrange(bits + 1)))
            assert any(all((diff & mask).bit_count() <= budget for mask, budget in chain) for chain in chains)


def test_near_copies_lose_all_but_one(spark, docs, words):
    rows = [(k, words(k, 200)) for k in range(20)]
    for k in range(20, 40):
        own = rows[k - 20][1].split()
        own[50], own[150] = "edit", "other"
        rows.append((k, " ".join(own)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (None, "free"), (60, None)]
    kept = simhash.keep_one_of_each(docs(rows))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs(rows).columns and {*range(20), None, 60} <= ids and not ids & {50, 51}
    assert len(ids & set(range(20, 40))) <= 2


def block_edits(words, seed, n, share):
    """(kind, text, other) with one contiguous block replaced, appended or deleted, as similar as ``share`` of the words make it."""
    for k in range(n):
        own, new = words(seed + k, 150 + 20 * (k % 40)).split(), words(seed + 500 + k, 400).split()
        size, at = int(len(own) * share), (7 * k) % 50
        yield "replaced", own, own[:at] + new[:size] + own[at + size :]
        yield "appended", own[::-1], own[::-1] + new[: 2 * size]
        yield "deleted", own[1::2] + own[::2], (own[1::2] + own[::2])[:at] + (own[1::2] + own[::2])[at + 2 * size :]


def test_near_copies_by_one_block_are_found(spark, docs, words, monkeypatch):
    def jaccard(a, b):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        return len(a & b) / len(a | b)

    rows, want, apart = [], defaultdict(list), []
    for seed, share in ((3000, 0.07), (5000, 0.14)):
        for kind, a, b in block_edits(words, seed, 40, share):
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
            (want[kind] if jaccard(a, b) >= 0.8 else apart).append(len(rows) - 2)
    hub = words(1, 100).split()  # many near copies of one text
    first = len(rows)
    rows += [(first + k, " ".join([*hub[:k], "edit", *hub[k + 1 :]])) for k in range(60)]
    for block in (1024, 8):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        kept = {r.doc_id for r in simhash.keep_one_of_each(docs(rows)).collect()}
        for kind, pairs in want.items():
            assert len(pairs) >= 30 and sum(k + 1 not in kept for k in pairs) >= 0.95 * len(pairs), kind
        assert len(apart) >= 30 and all(k + 1 in kept for k in apart)
        assert {k for k in kept if k >= first} == {first}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    vectors = [base[k % 30] + rng.standard_normal(16) * 0.08 * (k // 30) for k in range(150)]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(200, rows[4][1]), (201, rows[4][1]), (202, [x * 3 for x in rows[4][1]]), (300, None), (301, [0.0] * 16), (302, [math.nan] * 16), (303, [None] * 16), (304, [math.inf] * 16), (306, []), (305, [1.0, 2.0, 0.0])]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 4.0]), (402, [2.0, -1.0]), (410, [5.0]), (411, [7.0]), (412, [-7.0]), (420, rows[9][1]), (420, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")
    for small in ({}, {"cell_rows": 20, "block_rows": 8}):
        out = {r.vec_id: r for r in multi_index.embedding_groups(df, **small).collect()}
        good = [(i, np.array(v)) for i, v in rows if i < 300]
        assert [(out[i].n_links, out[i].component_id) for i in (400, 401, 402, 410, 411, 412)] == [(1, 400), (1, 400), (0, 402), (1, 410), (1, 410), (0, 412)]
        x = np.array([v / np.linalg.norm(v) for _, v in good])
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        ids = [i for i, _ in good]
        twice = np.array([rows[9][1], rows[40][1]])  # the two rows of id 420 count for others
        more = (x @ (twice / np.linalg.norm(twice, axis=1, keepdims=True)).T >= 0.9).sum(axis=1)
        want = dict(zip(ids, (near.sum(axis=1) + more).tolist(), strict=True))
        got = {i: out[i].n_links for i in ids}
        assert all(got[i] <= want[i] for i in ids) and sum(got.values()) >= 0.9 * sum(want.values())
        if not small:
            links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
            assert got == want and {i: out[i].component_id for i in ids} == brute_components(ids, links)
        assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(300, 307))
    # Every row of a repeated id has the links of its own vector.
    twice = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.99, 0.01, 0.0]), (3, [0.01, 0.99, 0.0]), (4, [0.0, 0.99, 0.05]), (1, [1.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [0.5, 0.5, 0.5])]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in twice])
    rows_of = spark.createDataFrame(twice, "vec_id long, embedding array<double>")
    got = multi_index.embedding_groups(rows_of).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((i, int((unit @ u >= 0.9).sum()) - 1) for (i, _), u in zip(twice, unit, strict=True))
    assert {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert multi_index.embedding_groups(df.limit(0)).count() == 0
    assert multi_index.embedding_groups(df.where("vec_id between 300 and 399")).count() == 7
    assert df.where("vec_id = 420").count() == multi_index.embedding_groups(df).where("vec_id = 420").count() == 2


def test_recall_of_every_fiftieth_vector(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 64))
    vectors = np.concatenate([base[k % 300 : k % 300 + 1] + rng.standard_normal((1, 64)) * rng.uniform(0.05, 0.6) for k in range(6000)]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r.n_links for r in multi_index.embedding_groups(df, cell_rows=64, block_rows=50).collect()}
    x = multi_index.unit_rows(vectors)
    want = (x[::50] @ x.T >= 0.9).sum(axis=1) - 1
    got = np.array([out[k] for k in range(0, 6000, 50)])
    assert want.sum() > 500 and (got <= want).all() and got.sum() >= 0.95 * want.sum()


def test_links_near_the_threshold_beside_a_dense_group(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((4000, 64)))
    aside = rng.standard_normal((800, 64))
    aside = unit(aside - (aside * base[:800]).sum(axis=1, keepdims=True) * base[:800])
    cosine = rng.uniform(0.901, 0.92, (800, 1))
    partners = cosine * base[:800] + np.sqrt(1 - cosine**2) * aside
    dense = unit(unit(rng.standard_normal((1, 64))) + 0.02 * rng.standard_normal((400, 64)))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, partners, dense]))]
    out = {r.vec_id: r.n_links for r in multi_index.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=80).collect()}
    found = np.array([out[4000 + k] > 0 for k in range(800)])
    for lo, hi in ((0.901, 0.91), (0.91, 0.92)):
        assert found[(cosine[:, 0] >= lo) & (cosine[:, 0] < hi)].mean() >= 0.9, (lo, hi)
    assert min(out[4800 + k] for k in range(400)) == 399


def test_multi_sequence_is_nearest_first():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    got = multi_index.multi_sequence(a, b, 35)
    assert [a[i] + b[j] for i, j in got] == sorted((x + y for x in a for y in b)) and len(set(got)) == 35


RULES = [url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"), url_filter.Rule("allow", "www.example.com/en/"), url_filter.Rule("block", "net/es/")]


def test_url_rules_and_propagation(spark):
    link = lambda h: f'<a href="https://{h}/x">x</a>'
    rows = [
        (1, "http://good.com/a?b", link("friend.org") * 3), (2, "HTTP://WWW.Example.com/en/x#y", None), (3, "http://example.com/en/", ""), (4, "http://example.com", ""), (5, "http://bad.net/es/1", link("friend.org")),
        (6, "https://friend.org/p", ""), (7, "https://shady.org/p", link("bad.net") + link("shady.org")), (8, None, link("bad.net")), (9, "no scheme", ""), (10, "http://lone.org", ""), (10, "http://lone.org", ""), (11, "x://a://b/c", "<img src='//pics.org/i.png'>"), (12, "http://bad.net/fr/", ""),
    ]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")
    out = {r.page_id: r for r in url_filter.judge_urls(df, RULES).collect()}
    assert url_filter.judge_urls(df, RULES).count() == len(rows)
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (out[3].rule, out[3].verdict) == ("example.com/en/", "block") and out[4].rule is None
    assert (out[5].rule, out[5].verdict) == ("net/es/", "block") and out[12].rule is None and out[12].verdict == "block"
    assert out[6].verdict == "allow" and out[6].trust > 0 and out[7].verdict == "block" and out[10].verdict == "allow"
    assert (out[8].host, out[8].path, out[8].verdict) == ("", "", "allow") and (out[9].host, out[9].path) == ("", "") and (out[11].host, out[11].path) == ("a:", "//b/c")
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def brute_rank(n, links, seeds, damping, rounds):
    out = np.zeros((n, n))
    for a, b, w in links:
        out[a, b] += w
    total = out.sum(axis=1, keepdims=True)
    step = np.divide(out, total, out=np.zeros_like(out), where=total > 0) * damping
    ranks = seeds.copy()
    for _ in range(rounds):
        ranks = seeds * (1 - damping) + ranks @ step
    return ranks


def test_propagation_over_hosts_against_numpy(spark):
    r = random.Random(6)
    hosts = [f"h{k}.{r.choice(['com', 'net', 'org', 'org', 'org'])}" for k in range(300)]
    pages, links = [], Counter()
    for k in range(900):
        src = k % 300
        targets = [0 if r.random() < 0.2 else r.randrange(300) for _ in range(r.randrange(5))]  # host 0 is a hub
        for t in targets:
            if t != src:
                links[src, t] += 1
        path = r.choice(["/es/a", "/fr/b", "/c"])
        pages.append((k, f"https://{hosts[src]}{path}", "".join(f"<a href='http://{hosts[t].upper()}/x'>" for t in targets)))
    rules = [url_filter.Rule("allow", "com/"), url_filter.Rule("block", "net/es/"), url_filter.Rule("block", "net/fr/")]

    def rule(url):
        host, path = re.fullmatch(r"https://([^/]*)(.*)", url).groups()
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        return max(fits, key=lambda x: len(x.text), default=None)

    trust, distrust = np.zeros(300), np.zeros(300)
    for k, url, _ in pages:
        own = rule(url)
        if own:
            (trust if own.verdict == "allow" else distrust)[k % 300] += 1
    t = brute_rank(300, [(a, b, w) for (a, b), w in links.items()], trust / trust.sum(), 0.85, 15)
    d = brute_rank(300, [(b, a, w) for (a, b), w in links.items()], distrust / distrust.sum(), 0.85, 15)
    out = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert len(out) == 900
    for x in out:
        host, own = x.page_id % 300, rule(pages[x.page_id][1])
        assert math.isclose(x.trust, t[host], rel_tol=1e-9, abs_tol=1e-15) and math.isclose(x.distrust, d[host], rel_tol=1e-9, abs_tol=1e-15)
        assert x.rule == (own.text if own else None) and x.verdict == (own.verdict if own else "block" if d[host] > t[host] else "allow")
    assert {x.verdict for x in out if x.rule is None} == {"allow", "block"}


def test_factorisation_machine_identity_and_learning(spark, docs, words):
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine.blank(0.5)
    model.weights, model.factors = rng.normal(size=model.weights.shape), rng.normal(size=model.factors.shape)
    index, value = quality.features(b"one two three TWO | !!", 5)
    pairs = sum(float(model.factors[index[i]] @ model.factors[index[j]]) * value[i] * value[j] for i in range(len(index)) for j in range(i + 1, len(index)))
    assert math.isclose(model.margin(index, value)[0], model.bias + float(model.weights[index] @ value) + pairs, rel_tol=1e-9)

    rows = [(k, words(k, 60) if k % 3 else words(k, 60).upper().replace(" ", "!! ")) for k in range(300)]
    table = docs([*rows, (1000, None), (1001, ""), (1002, "x " * 50_000), (1002, "x " * 50_000)])
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, 0, 0), (7, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    fitted = quality.train(table, labels, sample_rows=200)
    out = quality.score_documents(table, fitted)
    assert out.columns == [c for c in table.columns if c != "score"] + ["score"]
    score = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == 303
    held = [r.doc_id for r in table.where(quality.held_out(F.col("doc_id"))).select("doc_id").collect() if r.doc_id < 300]
    assert sum((score[k] >= 0.3) == (k % 3 > 0) for k in held) >= 0.95 * len(held)
    blank = quality.train(table, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score_documents(table, blank).collect()} == {0.5}
    assert quality.score_documents(docs([]), fitted).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, docs, words):
    rows = [(k, words(k, 30)) for k in range(100)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs(rows), labels), quality.train(docs(rows), flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()
