import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliospark.llm import packing, rans
from foliospark.llm.tokens import ChunkEncoder, default_tokenizer, load

TEXTS = ["", None, "Hello, world!! it's <|endoftext|> ok", "  a\tb\nc\x0bd ", "ÉÉ é, naïve… «q»; 12.5% x*** y$$$ #", "日本語 テスト。", "A" * 5000, "don't WE'LL .,; ''' ...", "e\u0301 x\u00a0y\u2003z \x1c\x85 end", "İ ΑΣ ß"]


def plain(text):
    return load(default_tokenizer()).encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_ids_of_whole_texts():
    encoder = ChunkEncoder(default_tokenizer(), max_chunks=3)
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in encoder.encode(TEXTS)] == [plain(t) for t in TEXTS]
    assert encoder.encode([]) == [] and encoder.by_chunks


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    home = str(tmp_path / "t.json")
    odd = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a b": 3, "a ": 4, "b</w>": 5}, merges=[("a", " "), ("a ", "b")]))
    odd.save(home)
    encoder = ChunkEncoder(home)
    assert not encoder.by_chunks and [x.tolist() for x in encoder.encode(["a b", None, "", "a a"])] == [[3], [], [], [4, 0]]
    odd.pre_tokenizer = pre_tokenizers.Whitespace()
    odd.save(home)
    assert [x.tolist() for x in ChunkEncoder(home).encode(["a b"])] == [[0, 2]]


@pytest.mark.parametrize("n", [0, 1, 7, 1023, 1024, 1025, 300_000])
def test_rans_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).pareto(1.0, n) * 3).astype(np.int64).clip(0, 999).astype(np.uint32)
    freq = rans.scale_frequencies(np.bincount(ids, minlength=1000))
    tables = freq, *rans.lookup_tables(freq)
    for lanes, every in ((1024, 16), (64, 5), (4096, 128)):
        marks, stream = rans.encode_block(ids, *tables[:2], lanes, every)
        assert len(marks) == -(-n // (lanes * every))
        for k, mark in enumerate(marks):  # each checkpoint up to the next one, on into that one's part, and to the end
            at = k * lanes * every
            for size in {min(lanes * every, n - at), min(lanes * every + 10, n - at), n - at}:
                assert (rans.decode_from(mark, stream[4 * mark.word :], size, n - at, *tables, lanes, every) == ids[at : at + size]).all()
        if n > 1100:
            assert len(stream) < 3 * n
            for at in (0, len(stream) // 2, len(stream) - 1):  # a broken stream raises, or the ids never depended on the broken bit
                broken = bytearray(stream)
                broken[at] ^= 128
                for k, mark in enumerate(marks):
                    left = n - k * lanes * every
                    try:
                        got = rans.decode_from(mark, bytes(broken)[4 * mark.word :], min(left, lanes * every), left, *tables, lanes, every)
                    except (ValueError, IndexError):
                        continue
                    assert (got == ids[n - left :][: len(got)]).all()


def test_frequencies_add_up():
    counts = np.array([10**9, 1, 0, 5] + [1] * 3000)
    freq = rans.scale_frequencies(counts)
    assert freq.sum() == 1 << rans.SCALE and (freq[counts > 0] > 0).all() and freq[2] == 0


@pytest.mark.parametrize(("block", "lanes", "every"), [(100, 4096, 128), (1000, 8, 4), (10**6, 16, 3)])
def test_token_files(spark, docs, block, lanes, every):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id"), (50, "long text, " * 20_000)]
    clashing = docs(rows).selectExpr("*", "1 as start", "2 as ids", "3 as crc", "4 as counts", "5 as block")
    path = rans.write_token_files(clashing, default_tokenizer(), end_id=2, block_ids=block, lanes=lanes, every=every)
    got = rans.read_token_files(spark, path).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0])):
        ids = np.array([*plain(t), 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == want
    assert sorted(tuple(r) for r in rans.read_token_files(spark, path, with_ids=False).collect() if r.doc_id is not None) == sorted((i, a, n, c) for a, i, n, c, _ in want if i is not None)


def test_token_files_of_an_empty_table(spark, docs):
    path = rans.write_token_files(docs([]), default_tokenizer(), end_id=2)
    assert rans.read_token_files(spark, path).count() == 0


def packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, words):
    rows = [(i, words(i, 3 + i * i % 90)) for i in range(80)] + [(0, words(0, 3)), (None, None), (99, words(99, 400)), (98, 'long, text ' * 20_000)] + [(i, "same words here") for i in range(100, 140)]
    clashing = docs(rows).selectExpr("*", "1 as piece", "2 as start", "3 as length", "4 as sequence_id", "5 as offset")
    out = packing.pack_documents(clashing, default_tokenizer(), end_id=0, capacity=64).collect()
    want = sorted((-1 if i is None else i, k, n, zlib.crc32(ids[k * 64 : k * 64 + 64].tobytes())) for i, t in rows for ids in [np.array([*plain(t), 0], "<u4")] for k, n in enumerate([len(ids[a : a + 64]) for a in range(0, len(ids), 64)]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == want
    total = sum(r.length for r in out)
    assert packed(out, 64) <= -(-total // 64) * 1.1 + 1
    assert packing.pack_documents(docs([]), default_tokenizer()).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        opened += gap == capacity
        if gap > x:
            insort(gaps, gap - x)
    return opened


def test_rounds_place_every_piece_once(spark):
    rng = np.random.default_rng(1)
    cases = [(60, rng.integers(1, 61, 400)), (64, rng.integers(1, 9, 900)), (50, [1] * 500), (30, [16] * 40), (30, [10] * 30 + [11] * 30), (2048, rng.integers(1, 2049, 1500)), (7, [7, 7, 1]), (100, [3] * 700 + [70] * 20), (1, [1, 1, 1])]
    for capacity, lengths in cases:
        count = Counter(int(x) for x in lengths)
        rounds, done = packing.match_classes(spark.createDataFrame(list(count.items()), "length long, n long"), capacity=capacity)
        used, ranks = defaultdict(list), defaultdict(list)
        for r in done.collect():
            for k in range(r.n):
                ranks[r.length].append(r["rank"] + k)
                used[r.seq + k // r.slots].append((r.offset + k % r.slots * r.length, r.length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in count.items()}
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) <= best_fit_decreasing(lengths, capacity) * 1.02 + 2, (capacity, len(rounds))
