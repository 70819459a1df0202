import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm import collocations as C
from foliospark.llm import entry
from foliospark.llm import periodic as R
from foliospark.llm import toxicity as X


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_phrases(rows, least, top=2000, covered=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(g == lang and len(q) > len(p) and b >= least and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-cut[0], -a, " ".join(p).encode(), a, f[lang, p[: cut[1]]], f[lang, p[cut[1] :]], n[lang]))
    return sorted((lang, r, p.decode(), a, lc, rc, nn, -s) for lang, v in out.items() for r, (s, _, p, a, lc, rc, nn) in enumerate(sorted(v)[:top], 1))


def phrase_rows():
    r = random.Random(4)
    say = ["new york city hall", "of the", "a a a a a a", "É,É É", "The\tend of The", "x\x01y x", "one two three four five six"]
    rows = [(i, r.choice(["en", "fr", None]), " ".join(r.choice(say) + r.choice([" ", ". ", "\n", ", "]) for _ in range(r.randrange(1, 40)))) for i in range(60)]
    return rows + [(None, "en", None), (7, "en", ""), (8, "en", " ,, \t"), (9, "fr", "new york " * 3000), (9, "fr", "new york " * 3000)]


@pytest.mark.parametrize("block_words", [50, 2_000_000])
def test_collocations(spark, block_words, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, g, t, 5, "x", -1) for i, g, t in rows], "doc_id long, lang string, text string, n long, Phrase string, f int").repartition(3)
    whole = C.phrase_counts
    monkeypatch.setattr(C, "phrase_counts", lambda *a, **k: whole(*a, **k, block_words=block_words))
    for options in ({}, {"top": 3}, {"covered": 60}):
        got = sorted(tuple(r) for r in C.collocations(docs, least=5, **options).collect())
        assert got == brute_phrases([(g, t) for _, g, t in rows], 5, options.get("top", 2000), options.get("covered", 100)) and got
    assert C.collocations(docs.limit(0)).count() == 0 and C.collocations(docs, least=10**6).count() == 0


def brute_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)  # periods go up, so the first one is the smallest
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_find_runs_against_brute_force():
    r = random.Random(9)
    for case in range(400):
        kinds = r.choice([1, 2, 3, 5])
        w = [r.randrange(kinds) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(3)):
            unit = [r.randrange(kinds + 1) for _ in range(r.randrange(1, 12))]
            at = r.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[: r.randrange(len(unit) * 3, len(unit) * 8)]
        assert R.find_runs(np.array(w, np.int64)) == brute_runs(w), (case, w)
        assert R.find_runs(np.array(w, np.int64), 9, 3) == brute_runs(w, 9, 3), (case, w)
    w = [r.randrange(3) for _ in range(40)]
    v = (w + w[::-1] + w) * 5  # every k-gram of few words comes more than once in a period
    assert R.find_runs(np.array(v)) == brute_runs(v)
    assert R.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_op13_columns(spark, tmp_path):
    r = random.Random(2)
    texts = [None, "", " \t\n", "a", "b " * 50, "x y z " * 9 + "q", "é\x1cé " * 7, " ".join(r.choice("ab") for _ in range(300)), " ".join(str(k) for k in range(3000))]
    rows = [(k, r.choice(texts) if k > 20 else texts[k % len(texts)]) for k in range(160)] + [(None, "c " * 8), (5, "d d d d d d"), (5, "d d d d d d")]
    spark.createDataFrame([(i, t, "o", 3) for i, t in rows], "doc_id long, text string, runs string, N_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(x) for x in entry.op13_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for i, t in rows:
        w = planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(map(str, want)) and sum(x[1] for x in want) > 40
    empty = R.periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def toxic_rows():
    r = random.Random(6)
    plain = ["word%d" % k for k in range(400)]
    bad = ["vile", "rotten", "zorkamen", "zorkatul", "zorkapex", "zorkalin"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        w = [r.choice(plain) for _ in range(r.randrange(5, 80))]
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity(spark, tmp_path):
    rows = toxic_rows()
    more = [(None, "vile", 1), (901, None, 0), (902, "", 0), (903, "zorkanew " * 4000, None), (6, rows[6][1], 1), (6, rows[6][1], 1)]
    everything = [(i, t) for i, t, _ in rows + more]
    docs = spark.createDataFrame([(i, t, "s", "old") for i, t in everything], "doc_id long, text string, Score string, _id string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + more[:3]] + [(3, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = entry.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(everything) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(y for y, _ in held) > 30 and all(p == 0 for y, p in held if not y) and sum(p for y, p in held if y) >= 0.95 * sum(y for y, _ in held)
    by = {r.doc_id: r for r in got}
    assert by[903].predicted == 1 and by[901].score == by[902].score < 0.5 and len({r.score for r in got if r.doc_id == 6}) == 1
    # The scores are those of the whole procedure without Spark: same sample, same order, plain sums over the features' weights.
    known = defaultdict(set)
    for i, y in [(i, y) for i, _, y in rows + more[:3]] + [(3, None), (4, 0), (4, 1)]:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i].add(y)
    sample = [(str(i), t.encode() if t else b"", min(known[i])) for i, t in everything if len(known.get(i, ())) == 1]
    made = sorted((i, f.astype("<i4").tobytes(), y) for (i, _, y), f in zip(sample, X.batch_features([t for _, t, _ in sample]), strict=True))
    learner = X.FollowTheRegularisedLeader()
    learner.fit([(np.frombuffer(f, "<i4").astype(np.int64), y) for _, f, y in made])
    weight = dict(zip(learner.compact().index.tolist(), learner.compact().weight.tolist(), strict=True))
    want = {}
    for (i, _), f in zip(everything, X.batch_features([t.encode() if t else None for _, t in everything]), strict=True):
        want[i] = 1 / (1 + np.exp(-(learner.bias() + sum(weight.get(k, 0.0) for k in f.tolist()))))
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    blank = X.score_documents(docs, X.train(docs, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5} and X.score_documents(docs.limit(0), learner.compact()).count() == 0


def test_features_by_hand():
    f = list(X.batch_features([b"Alpha beta alpha gamma", b"", None, b"beta"]))
    assert len(f[1]) == len(f[2]) == 0 and set(f[3]) < set(f[0])
    # alpha beta gamma with stems of 4 (alpha, gamma); pairs ab, ba, ag; skips aa, bg.
    assert len(f[0]) == 3 + 2 + 3 + 2
