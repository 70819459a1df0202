import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from foliospark.llm import decontaminate as D
from foliospark.llm import line_runs as L
from foliospark.llm import paragraphs as P
from foliospark.llm import secret_scan as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute_hits(text, items, window=10):
    own = WORD.findall(low(text))
    hit, found = set(), set()
    for item_id, t in items:
        words = WORD.findall(low(t))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == words[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item_id))
    return len(own), len(hit), sorted(found)


def test_decontamination(spark, docs, words):
    items = [(1, words(1, 14)), (2, "Short item, É!"), (3, ""), (4, None), (10, words(1, 14)), (5, words(5, 10))]
    rows = [(0, None), (1, ""), (2, "x " + words(1, 14).upper() + " y"), (3, words(1, 14)[:60]), (4, "a SHORT--item é b short item É"), (4, "a SHORT--item é b short item É"), (5, words(5, 10) + "\n" + words(5, 10)), (None, "short item É"), (6, words(6, 3000) + " " + words(1, 14))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 120):  # one automaton, and several
        found = D.find_contamination(docs(rows), bench, block_bytes=block)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.hit_words), tuple(r["items"])) for r in found.collect())
        want = []
        for i, t in rows:
            n, hit, ids = brute_hits(t, items)
            want.append((-1 if i is None else i, n, hit, tuple(ids)))
        assert got == sorted(want)
        for r in found.where("size(hit_spans) > 0").collect():
            for s in r.hit_spans:
                assert WORD.findall(low(r.text[s["start"] : s["end"]]))
    report = D.contamination_report(D.find_contamination(docs(rows), bench))
    assert {r.doc_id: r.items_sha256 for r in report.collect()}[2] == hashlib.sha256(b"1,10").hexdigest()
    assert D.find_contamination(docs([]), bench).count() == 0
    assert D.find_contamination(docs(rows), bench.limit(0)).where("size(items) > 0").count() == 0
    kept = D.drop_contaminated(docs(rows), bench)
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {0, 1, 3}


def brute_lines(rows, chars=40, least=5):
    key = lambda l: low(l.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= least and i != max(holders[key(x)]))]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_line_dedup(spark, docs):
    common, rare = "This Line is shared by very many documents É", "this one is only in four of the documents!!!"
    rows = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\n{rare if i < 4 else ''}\n{common}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, common), (3, rows[3][1]), (30, "x" * 39 + "\n" + "y" * 200_000), (31, (common + "\n") * 5000), (3, f"another text of one id\n{common}")]
    out = L.dedup_lines(docs(rows), batches=3, fanout=2)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == brute_lines(rows)
    assert out.columns[: len(docs(rows).columns)] == docs(rows).columns
    assert L.dedup_lines(docs([])).count() == 0


def test_line_runs_compact_and_find_unseen(spark):
    runs = L.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, 0, k * 10), (7, 7, k), (7, 7, k)], "h1 long, h2 long, doc_id long")
        fresh = {r.h1 for r in runs.unseen(batch).collect()}
        assert fresh == ({0, 7} if k == 0 else {k})
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.docs, r.last) for r in runs.totals().collect()} == {(k, 1, k * 10) for k in range(5)} | {(7, 5, 4)}
    assert [(r.h1, r.docs) for r in runs.totals(2).collect()] == [(7, 5)]
    runs.drop()


def brute_secrets(text):
    t, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    own, copied = "AKIA" + "Q7" * 9, "0123456789abcdef0123456789abcdef"
    rows = [
        (0, None, "a"), (1, "", "a"), (2, f"é 😀 token = '{copied}' tail", "a"), (3, f"API_KEY:abc password=hunter22, secret : x", "b"), (4, f"{copied}\n{own} AKIASHORT", "c"), (5, f"{copied} {copied}", "d"),
        (5, f"{copied} {copied}", "d"), (None, f"passwd=abcdefg1 {copied}", None), (7, "token: password=abcd1234 " * 300, "e"), (8, f"x{copied}g", "f"),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, n_live int, kind string")
    out = S.scan_secrets(df).collect()
    assert len(out) == len(rows)
    want = Counter((i, tuple((k, a, b) for a, _, k, b in brute_secrets(t))) for i, t, _ in rows)
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base_spans)) for r in out) == want
    by = {r.doc_id: r for r in out}
    assert by[4].n_live == 1 and by[4].spans[-1].kind == "live" and df.where("doc_id = 4").first().text[by[4].spans[-1].start : by[4].spans[-1].end] == own
    assert by[2].n_live == 0 and by[2].n_example >= 1
    assert S.scan_secrets(df.limit(0)).count() == 0


def test_ownership_against_brute_force(spark):
    r = random.Random(2)
    values = ["".join(r.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(28)) for _ in range(40)] + ["onlyletters" * 3, "1234567890" * 3]
    rows = []
    for k in range(150):
        parts = [r.choice(["token=", "key ", "", "secret: "]) + (values[0] if r.random() < 0.3 else r.choice(values)) for _ in range(r.randrange(4))]
        rows.append((k, "word " + " | ".join(parts) + " é", r.choice(["a", "b", "c", None])))
    rows += [rows[3], rows[3], (3, rows[3][1], "z"), (400, "x " * 100_000 + "token=" + values[1], "a")]
    kinds = [*S.BASE_KINDS, S.OPEN_KIND]
    found, repositories, owners = {}, defaultdict(set), defaultdict(set)
    for i, t, o in rows:
        spans = set()
        for kind in kinds:
            for m in re.finditer(kind.pattern, t, re.A):
                if len(m[kind.value]) >= kind.least:
                    spans.add((kind.name, m.start(), m.end(), m.end() - len(m[kind.value]), m[kind.value]))
                    repositories[m[kind.value]].add((i, t, o or ""))
                    owners[m[kind.value]].add(o or "")
        found[i, t, o] = spans
    live = lambda v: len(owners[v]) <= 1 and len(repositories[v]) <= 3 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    want = Counter()
    for key in rows:
        spans = found[key]
        base = sorted((a, ["assign", "access", "hex"].index(k), k, b) for k, a, b, _, _ in spans if k != "open")
        extra = {(v, b) for _, _, b, v, x in spans if live(x)}
        want[key[0], tuple((k, a, b) for a, _, k, b in base), tuple(sorted(extra)), sum(not live(x) for k, _, _, _, x in spans if k != "open")] += 1
    out = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = Counter((x.doc_id, tuple((s.kind, s.start, s.end) for s in x.base_spans), tuple(sorted((s.start, s.end) for s in x.spans if s.kind == "live")), x.n_example) for x in out)
    assert got == want and any(k[2] for k in want) and any(k[3] for k in want)


def brute_cuts(own, radius=4):
    """Paragraphs of a list of words, by looking at every place."""
    h = [zlib.crc32(w.encode()) for w in own]
    mask = (1 << 64) - 1

    def pair(i):
        x = (h[i - 1] * 0x9E3779B97F4A7C15 & mask) ^ (h[i] * 0xC2B2AE3D27D4EB4F & mask)
        x = (x ^ x >> 29) * 0x9E3779B97F4A7C15 & mask
        return x ^ x >> 32

    pairs = [mask, *map(pair, range(1, len(h)))]
    edges = [0] + [i + 1 for i in range(radius, len(h) - radius - 1) if all(pairs[i] < x for x in pairs[i - radius : i]) and all(pairs[i] <= x for x in pairs[i + 1 : i + radius + 1])] + [len(h)]
    return [tuple(own[a:b]) for a, b in zip(edges, edges[1:]) if b > a]


def test_paragraphs_against_all_pairs(spark, docs, words, monkeypatch):
    """Documents of many paragraphs, all pairs of which are compared."""
    r = random.Random(9)
    texts = [words(k, 90).split() for k in range(40)]
    rows = []
    for k in range(120):
        own = [w for _ in range(3) for w in texts[r.randrange(40)][r.randrange(30) : r.randrange(50, 90)]]
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = "edit"
        for at in sorted((r.randrange(len(own)) for _ in range(6)), reverse=True):
            own[at] += r.choice([".", "\n", ";\n\n", "! "])
        rows.append((k, " ".join(own)))
    rows += [(500, "x y z " * 40_000)]
    cut = {i: brute_cuts(WORD.findall(low(t))) for i, t in rows}
    units = sorted({u for c in cut.values() for u in c})
    sets = [{u[k : k + 5] for k in range(len(u) - 4)} for u in units]
    up = list(range(len(units)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(units)):
        for b in range(a + 1, len(units)):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    root = {u: find(k) for k, u in enumerate(units)}
    holders = defaultdict(set)
    for i, c in cut.items():
        for u in c:
            holders[root[u]].add(i)
    want = set()
    for i, c in cut.items():
        own = [k for k, u in enumerate(c) if len(holders[root[u]]) > 1]
        runs = []
        for k in own:
            if runs and k - runs[-1][-1] <= P.BRIDGE + 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        want |= {(i, k) for run in runs if sum(len(c[k]) for k in run) >= 20 for k in run}
    assert len(want) > 1000 and len({root[u] for u in units}) < len(units)
    text = dict(rows)
    for small, block in ((16, 256), (1, 7)):
        monkeypatch.setattr(P, "SMALL_GROUP", small)
        out = P.repeated_passages(docs(rows), block_units=block).collect()
        got = {(x.doc_id, x.paragraph) for x in out}
        assert len(got) == len(out) and len(got ^ want) <= 0.01 * len(want)
        cluster, of = defaultdict(set), defaultdict(set)
        for x in out:
            assert tuple(WORD.findall(low(text[x.doc_id][x.start : x.end]))) == cut[x.doc_id][x.paragraph] and x.n_words == len(cut[x.doc_id][x.paragraph])
            cluster[x.cluster].add(root[cut[x.doc_id][x.paragraph]])
            of[root[cut[x.doc_id][x.paragraph]]].add(x.cluster)
        assert all(len(v) == 1 for v in cluster.values()) and sum(len(v) > 1 for v in of.values()) <= 0.01 * len(of)


def test_passages_at_any_place_are_found(spark, docs, words):
    """Passages of 50 to 200 words, pasted at any word of two other texts."""
    r, rows, pasted = random.Random(4), [], {}
    for n in (50, 60, 80, 120, 200):
        for k in range(60):
            passage = words(n * 1000 + k, n).split()
            for side in (0, 1):
                i = len(rows)
                own = words(500_000 + i, r.randrange(120, 400)).split()
                at = r.randrange(len(own))
                end = r.choice([".", "", "\n", "!\n\n"])
                rows.append((i, " ".join([*own[:at], *passage]) + end + " " + " ".join(own[at:])))
                pasted[i] = (n, at, at + n)
    rows += [(len(rows) + k, words(900_000 + k, 300)) for k in range(50)]
    found = defaultdict(int)
    for x in P.repeated_passages(docs(rows)).collect():
        assert x.doc_id in pasted
        at = len(dict(rows)[x.doc_id][: x.start].split())
        # Similar ones may begin or end with another word or two.
        assert pasted[x.doc_id][1] - 3 <= at and at + x.n_words <= pasted[x.doc_id][2] + 3
        found[x.doc_id] += x.n_words
    for n in (50, 60, 80, 120, 200):
        own = [i for i, p in pasted.items() if p[0] == n]
        assert sum(found[i] > 0 for i in own) >= 0.95 * len(own), n
        assert sum(found[i] for i in own) >= (n - 24) * 0.95 * len(own), n
    short = [(k, "\n".join(words(700 + j, 4) for j in range(20)) + "\n" + words(800 + k, 60)) for k in range(2)]  # lines of four words each
    assert {x.doc_id for x in P.repeated_passages(docs(short)).collect()} == {0, 1}


def test_repeated_rows_are_no_repeated_passages(spark, docs, words):
    line = words(77, 20)
    one, two = (1, words(1, 40) + "\n" + line), (2, words(2, 40) + "\n" + line)
    assert P.repeated_passages(docs([one, two])).count() == P.repeated_passages(docs([one, one, two, two])).count() == 0
    found = [P.repeated_passages(docs(rows), passage_words=5).orderBy("doc_id", "paragraph").collect() for rows in ([one, two], [one, one, two])]
    assert found[0] == found[1] and {x.doc_id for x in found[0]} == {1, 2}
    other = (1, words(3, 40) + "\n" + words(78, 20) + "\n" + line)  # another text of document 1
    out = P.repeated_passages(docs([one, other, two]), passage_words=5).collect()
    n = [sum(x.n_words for x in out if x.doc_id == i) for i in (1, 2)]
    assert n[0] == 2 * n[1] > 10 and sum(x.kept for x in out) == len({x.cluster for x in out})


def test_paragraphs(spark, docs, words):
    sentence = lambda seed, n: words(seed, n).capitalize() + ". "
    passage = "".join(sentence(9000 + k, 15) for k in range(5))
    edited = passage.replace(passage.split()[32], "changed", 1)
    rows = [(i, "".join(sentence(i * 50 + k, 14) for k in range(8))) for i in range(12)]
    rows += [(20, words(20, 30) + " " + passage + words(21, 12)), (21, "start\n" + passage), (22, words(22, 9) + " " + edited), (23, None), (24, ""), (None, passage), (25, "Same short line.\n" + words(25, 40)), (26, "Same short line.\n" + words(26, 40)), (27, words(27, 50) + "\n" + words(27, 50))]
    out = P.repeated_passages(docs(rows)).collect()
    assert {r.doc_id for r in out} == {20, 21, 22}
    assert sum(r.n_words for r in out if r.doc_id == 22) >= 45
    text = dict(rows)
    for r in out:
        assert text[r.doc_id][r.start : r.end].strip() in (passage + edited + text[r.doc_id])
    kept = defaultdict(list)
    for r in out:
        kept[r.cluster].append(r.kept)
    assert all(sum(v) == 1 for v in kept.values())
    assert P.repeated_passages(docs([])).count() == 0
    assert P.repeated_passages(docs([(1, passage), (1, passage)])).count() == 0


def test_bands_reach_the_recall(words):
    bands = P.tune_bands(0.8, 0.97, 3)
    assert 1 - (1 - 0.8**3) ** bands >= 0.97 > 1 - (1 - 0.8**3) ** (bands - 1)
    hasher = P.MinHasher(bands, 3)
    met = 0
    for k in range(200):
        a = words(k, 60).split()
        b = [*a[:57], "x", "y", "z"]
        _, _, keys = hasher.run(np.array([zlib.crc32(w.encode()) for w in a + b], np.uint64), np.array([60, 60]))
        met += bool((keys[0] == keys[1]).any())
    assert met >= 190


def test_shared_bands_over_many_batches():
    import pyarrow as pa

    rows = sorted([(1, 5), (1, 5), (2, 1), (2, 9), (2, 9), (3, 4), (4, 1), (4, 2), (4, 3), (9, 9)])
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + size]]), pa.array([r[1] for r in rows[k : k + size]])], ["band", "unit"]) for k in range(0, len(rows), size)]
        got = [t for b in P._shared(iter(batches)) for t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert sorted(got) == [(2, 1), (2, 9), (4, 1), (4, 2), (4, 3)], (size, got)
