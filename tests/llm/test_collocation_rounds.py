from collections import Counter

import numpy as np
import pyarrow as pa

from foliospark.llm import collocations as C


def pair_questions(seq, buckets):
    pairs = C._Pairs(seq, buckets)
    return C._asked("en", 7, pairs.bucket, lambda a, b: C._pack_pairs(pairs.first[a:b], pairs.second[a:b], pairs.counts[a:b], buckets))


def test_pairs_travel_once_a_block_and_packed():
    r = np.random.default_rng(3)
    seq = np.minimum(r.zipf(1.3, 100_000), 30_000)
    seq[r.random(len(seq)) < 0.1] = 0
    asked = pair_questions(seq, 8).to_pylist()
    got = Counter()
    for q in asked:
        for a, b, c in zip(*C._unpack_pairs(q["keys"], q["n"], q["bucket"], 8), strict=True):
            assert (a + b) % 8 == q["bucket"]
            got[int(a), int(b)] += int(c)
    want = Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True) if a and b)
    assert got == want and sum(q["n"] for q in asked) == len(want)
    # A row of a window took 24 bytes and its count.
    assert sum(len(q["keys"]) for q in asked) < 6 * len(want)


def test_longer_phrases_are_asked_for_only_if_both_shorter_ones_are_frequent():
    # 1 2 3 is often, 2 4 and 4 5 are not.
    own = np.array([1, 2, 3, 0] * 9 + [2, 4, 5, 0])
    ids = np.array([0, 11, 12, 13, 14, 15])
    words = [{"m": 1, "at": 0, "ids": C._pack(C._planes(ids[1:]))}]
    block = pa.table({"owner": [7], "lang": ["en"], "seq": [C._planes(own)]})
    empty = C._ask_pairs(2, 1)(block, pa.table({"m": [1], "at": [0], "ids": [C._pack(C._planes(ids[1:] * 0))]}))
    assert empty.num_rows == 0
    asked = C._ask_pairs(2, 1)(block, pa.Table.from_pylist(words))
    answer = C._answer(2, 1, 9)((pa.scalar("en"), pa.scalar(0)), asked).to_pylist()
    assert sorted((a["first"], a["second"], a["f"]) for a in answer if a["id"]) == [(11, 12, 9), (12, 13, 9)]
    pairs = [{"m": 2, "at": a["at"], "ids": a["ids"]} for a in answer if a["block"] is not None]
    third = C._ask_pairs(3, 1)(block, pa.Table.from_pylist(words + pairs)).to_pylist()
    assert [(q["n"], C._unpack_pairs(q["keys"], q["n"], 0, 1)[2].tolist()) for q in third] == [(1, [9])]


def test_words_of_one_bucket_are_counted_over_blocks():
    one = C._Block()
    for text in (b"of the Hat. of", b"", None, "É of".encode()):
        one.add(text)
    row = pa.Table.from_batches([one.row(3, "en")])
    assert row.column("n")[0].as_py() == 6
    asked = C._ask_words(1)(row)
    two = pa.concat_tables([asked, asked.set_column(2, "block", pa.array([4], pa.int64()))])
    answer = C._answer(1, 1, 6)((pa.scalar("en"), pa.scalar(0)), two).to_pylist()
    assert [(a["word"], a["f"], a["id"]) for a in answer if a["id"]] == [(b"of", 6, 1)]
    assert sorted(a["block"] for a in answer if a["block"] is not None) == [3, 4]
