"""Benchmark decontamination with one Aho-Corasick automaton over the test items' words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_before, named, plain_columns, stage
from .tokens import slices

# A-Z become a-z; the other ASCII characters outside 0-9 and a-z separate words. UTF-8 bytes of
# other characters are word bytes, so bytes and code points give the same words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered."""
    return (text or b"").translate(NORMAL).split()


class Patterns:
    """One Aho-Corasick automaton over the items' words, built when it is first used and kept by the Python worker.

    Word numbers are the alphabet. The patterns are the items' aligned pieces of half a window: every window of an item holds a whole
    one, so a piece that is met is extended in both directions as far as item and text agree, and what
    reaches the length of a window is a run of occurrences. Items shorter than a window are one
    pattern each. That takes about one node for each item word, where whole windows would take ten.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.items, self.window = items, window
        self.automaton = None

    def build(self) -> None:
        self.number: dict[bytes, int] = {}
        piece = max(1, (self.window + 1) // 2)
        self.words = [array("i", [self.number.setdefault(w, len(self.number) + 1) for w in words(t)]) for _, t in self.items]
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, own in enumerate(self.words):
            if len(own) < self.window:
                if own:
                    places.setdefault(tuple(own), []).append((item, -1))
            else:
                for at in range(0, len(own) - piece + 1, piece):
                    places.setdefault(tuple(own[at : at + piece]), []).append((item, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in places.items():
            self.automaton.add_word(key, (len(key), where))
        if places:
            self.automaton.make_automaton()

    def find(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of hit words, items that occur) in a text's words."""
        if self.automaton is None:
            self.build()
        spans, ids = [], set()
        if not own or not len(self.automaton):
            return spans, ids
        text = tuple([self.number.get(w, 0) for w in own])
        reached: dict[tuple[int, int], int] = {}  # (item, text place less item place) -> end of its last run
        for end, (n, where) in self.automaton.iter(text):
            first = end - n + 1
            for item, at in where:
                if at < 0:
                    spans.append((first, end + 1))
                    ids.add(self.items[item][0])
                    continue
                line = (item, first - at)
                if reached.get(line, -1) > end:
                    continue
                theirs, lo, hi, shift = self.words[item], first, end + 1, at - first
                while lo > 0 and lo + shift > 0 and text[lo - 1] == theirs[lo - 1 + shift]:
                    lo -= 1
                while hi < len(text) and hi + shift < len(theirs) and text[hi] == theirs[hi + shift]:
                    hi += 1
                reached[line] = hi
                if hi - lo >= self.window:
                    spans.append((lo, hi))
                    ids.add(self.items[item][0])
        return spans, ids


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word spans as code-point offsets of the original text."""
    places = [m.span() for m in _WORD.finditer(text.translate(NORMAL))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[places[a][0]]), "end": int(chars[places[b - 1][1]])} for a, b in spans]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _scan(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int, text_col: str, keep: list[str], more: bool) -> DataFrame:
    names = [f.name for f in _RESULT]
    schema = T.StructType([docs.schema[c] for c in keep] + list(_RESULT))
    held = docs.sparkSession.sparkContext.broadcast(Patterns(items, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = held.value
        for whole in batches:
            for batch in slices(whole):
                n_words, hit_words, hit_spans, found = [], [], [], []
                before = batch.column("hit_words").to_pylist() if more else None
                had = batch.column("items").to_pylist() if more else None
                for i, text in enumerate(batch.column(text_col).cast(pa.binary()).to_pylist()):
                    own = words(text)
                    spans, ids = patterns.find(own)
                    if more:
                        spans += [(s["start"], s["end"]) for s in before[i]]
                        ids.update(had[i])
                    spans = _merged(spans)
                    n_words.append(len(own))
                    hit_words.append([{"start": a, "end": b} for a, b in spans])
                    hit_spans.append(_char_spans(text, spans) if spans else [])
                    found.append(sorted(ids))
                arrays = [batch.column(c) for c in keep]
                arrays += [pa.array(n_words, pa.int64()), pa.array(hit_words, _SPAN), pa.array(hit_spans, _SPAN), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return docs.mapInArrow(scan, schema)


def find_contamination(
    docs: DataFrame, items: DataFrame, *, window: int = 10, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_bytes: int = 8 << 20
) -> DataFrame:
    """Where test items occur in documents, in one scan of the text.

    Questions and answers are normalised to words (A-Z lowered; ASCII other than 0-9 and a-z
    separates). Every ``window`` consecutive words of an item, or all words of a shorter one, are
    looked for by one Aho-Corasick automaton (``Patterns``) that each worker builds once. A word inside any occurrence is hit.

    Returns the columns ``keep`` (default: all) and n_words long, hit_words and hit_spans
    (merged half-open spans, in words and in code points of the original text), items (sorted ids
    as strings). Columns of those names in ``docs``, in any case, give way to the results.

    Null or empty texts have no words and no hits; items without words match nothing; a null
    item id is reported as "null"; repeated rows are each reported; empty tables give no rows or
    no hits; very long texts are scanned whole. The items' size is measured first: up to ``block_bytes`` they are broadcast for one
    automaton, which takes some fifty times the items' bytes in a worker; beyond that they go in blocks of about that size, one scan each, staged in between.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in _RESULT}]
    wanted = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    size = wanted.select(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    docs = docs.select(*dict.fromkeys([*keep, text_col]))
    for block in range(blocks):
        last = block == blocks - 1
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == block)
        rows = [(r.id, bytes(r.text)) for r in part.toLocalIterator()]
        docs = _scan(docs, rows, window, text_col, keep if last else list(dict.fromkeys([*keep, text_col])), more=block > 0)
        if not last:
            docs = stage(docs)
    return docs


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its word counts, the digest of the items found, the verdict."""
    return found.select(
        id_col,
        "n_words",
        F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no test item occurs, columns and values as they were, whatever their names."""
    plain, names = plain_columns(docs)
    found = find_contamination(plain, items, text_col=named(names, text_col), **options)
    return as_before(found.where(F.size("hit_words") == 0), names)
