"""Token ids of whole texts, by the ``tokenizers`` library, with a bounded word cache.

A tokenizer that drops white space and never joins text across it gives a text the ids of its
white-space-separated chunks in order. Chunks repeat, so each worker keeps their ids and calls the
tokenizer only for new ones. Closing punctuation after a letter or number is a piece of its own for such a
tokenizer too, so it is split off first, and a run of letters ends with the first id whose form ends in
the end-of-word mark, which tells many runs of one call apart. Whether a tokenizer behaves so is tried on
PROBES when it is loaded; any other one encodes whole texts. ``tests/llm/test_tokens.py`` holds both
ways against plain encoding.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPECIAL_MARK = b"<|"
CLOSING = ".,;:!?%$#&*|"
WORD_END = "</w>"
# ASCII white space becomes a space; in the second table A-Z become a-z as well.
_SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_SPACED_LOWER = _SPACED.lower()
PROBES = ("Two words", "\tTabs,\nlines  and CAPITALS! ", "It's 12.5%; café... «naïve» x*** y$$$ #1 a,b", "日本語 テスト。 é ẞ", "")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs numbered k of ``flat``, one after another; their lengths)."""
    n = lengths[k]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[k] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


class IdStore:
    """Byte strings and their ids, in flat arrays; strings are looked up many at a time by Arrow."""

    def __init__(self):
        self.names = pa.array([], pa.large_binary())
        self.flat = np.empty(0, np.uint32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: pa.Array) -> np.ndarray:
        """The number of each string, or -1."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def put(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append new strings with their ids, one after another."""
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.names = pa.concat_arrays([self.names, names])

    def ids(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.starts, self.lengths, k)


class ChunkEncoder:
    """Encodes texts. Holds about ``max_chunks`` chunks at a time."""

    def __init__(self, path: str, max_chunks: int = 1_000_000):
        self.tokenizer = load(path)
        self.max_chunks = max_chunks
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for form, i in vocabulary.items() if form.endswith(WORD_END)]] = True
        self._clear()
        self.by_chunks = bool(self.ends_word.any())
        if self.by_chunks:
            self.by_chunks = [x.tolist() for x in self.encode(PROBES)] == self._ids(list(PROBES))
            self._clear()

    def _clear(self) -> None:
        self.chunks, self.pieces = IdStore(), IdStore()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, names: pa.Array) -> None:
        coded = self._ids([n.decode("utf-8", "replace") for n in names.to_pylist()])
        self.pieces.put(names, np.array([i for own in coded for i in own], np.uint32), np.array([len(own) for own in coded], np.int64))

    def _letters(self, stems: pa.Array) -> None:
        """Runs of letters, many in one call: each ends with the next word-end id."""
        names = stems.to_pylist()
        parts = [names[at : at + 1024] for at in range(0, len(names), 1024)]
        found, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for part, own in zip(parts, self._ids([b" ".join(part).decode() for part in parts]), strict=True):
            ids = np.array(own, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                each = self._ids([n.decode() for n in part])
                ids, ends = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        self.pieces.put(stems, np.concatenate(found), np.concatenate(sizes))

    def _learn_pieces(self, pieces: pa.Array) -> np.ndarray:
        """Put new pieces, runs of letters first; returns the number of each."""
        is_word = pc.utf8_is_alpha(pieces.cast(pa.large_string())).to_numpy(zero_copy_only=False)
        number = np.where(is_word, np.cumsum(is_word) - 1, is_word.sum() + np.cumsum(~is_word) - 1) + len(self.pieces)
        self._letters(pieces.filter(pa.array(is_word)))
        self._plain(pieces.filter(pa.array(~is_word)))
        return number

    @staticmethod
    def _parts(chunks: pa.Array) -> pa.Array:
        """Each chunk's stem and its closing punctuation, one after another. The latter is empty unless a
        letter or number stands before it, so that the tokenizer parts them there too."""
        stem = pc.utf8_rtrim(chunks.cast(pa.large_string()), characters=CLOSING)
        parted = pc.utf8_is_alnum(pc.utf8_slice_codeunits(stem, start=-1)).to_numpy(zero_copy_only=False)
        size = pc.binary_length(chunks).to_numpy(zero_copy_only=False)
        head = np.where(parted, pc.binary_length(stem).to_numpy(zero_copy_only=False), size)
        cut = np.stack([head, size - head], axis=1).ravel()
        # The chunks lie one after another in their buffer already; only the offsets are new.
        offsets = np.concatenate([[0], np.cumsum(cut)]) + np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offsets), chunks.buffers()[2]])

    def _learn(self, chunks: pa.Array) -> None:
        """Ids of new chunks: those of their stem and of their closing punctuation."""
        parts = self._parts(chunks).dictionary_encode()
        k = self.pieces.find(parts.dictionary)
        if (k < 0).any():
            k[k < 0] = self._learn_pieces(parts.dictionary.filter(pa.array(k < 0)))
        ids, n = self.pieces.ids(k[parts.indices.to_numpy(zero_copy_only=False)])
        self.chunks.put(chunks, ids, n.reshape(-1, 2).sum(axis=1))

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = self._ids([t or "" for t in texts.to_pylist()])
        return np.array([i for own in coded for i in own], np.uint32), np.cumsum([len(own) for own in coded], dtype=np.int64)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, where each text's ids end); a null text has none.

        Words are split and numbered by Arrow; only new ones are looked at one by one.
        """
        if not len(texts) or not self.by_chunks:
            return self._encode_whole(texts)
        # Lower-casing A-Z first makes more chunks equal; the tokenizer does it anyway, but
        # finds its special tokens before that, so texts that may hold one stay as they are.
        text = [b"" if t is None else t.translate(_SPACED if SPECIAL_MARK in t else _SPACED_LOWER) for t in texts.cast(pa.binary()).to_pylist()]
        words = pc.split_pattern(pa.array(text, pa.large_binary()).cast(pa.large_string()), " ")
        coded = words.flatten().cast(pa.large_binary()).dictionary_encode()
        del text
        if len(self.chunks) > self.max_chunks or len(self.pieces) > self.max_chunks:
            self._clear()
        k = self.chunks.find(coded.dictionary)
        if (k < 0).any():
            known = len(self.chunks)
            self._learn(coded.dictionary.filter(pa.array(k < 0)))
            k[k < 0] = np.arange(known, len(self.chunks))
        ids, n = self.chunks.ids(k[coded.indices.to_numpy(zero_copy_only=False)])
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[pc.cumulative_sum(pc.list_value_length(words)).to_numpy(zero_copy_only=False)]

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array([t.decode() if isinstance(t, bytes) else t for t in texts], pa.string())
        ids, ends = self.encode_array(texts)
        return np.split(ids, ends[:-1]) if len(ends) else []


@lru_cache(1)
def shared_encoder(path: str) -> ChunkEncoder:
    """One encoder for all the tasks that a Python worker runs."""
    return ChunkEncoder(path)


def slices(batch, size: int = 128):
    """Parts of an Arrow batch, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def slices_by_size(batch, column: str, size: int = 8 << 20):
    """Parts of an Arrow batch with about ``size`` bytes of text in ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
