"""Tokenise many texts by their distinct words.

For a vocabulary whose pieces never run over a blank, the ids of a text are
the ids of its words, one after the other. A batch of texts is therefore split
by Arrow, its distinct words are encoded once by the tokenizer library, and
the texts' ids are gathered from them with numpy.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer single text is worked on alone.
BATCH_BYTES = 24 << 20


class Ragged:
    """Rows of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])

    def take(self, index: np.ndarray) -> Ragged:
        lengths = self.lengths[index]
        return Ragged(self.flat[spread(self.starts[:-1][index], lengths)], lengths)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 for every i, joined."""
    ends = np.cumsum(lengths)
    shift = starts - (ends - lengths)
    return np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)


def ragged_of(lists: list, dtype) -> Ragged:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for one in lists for x in one), dtype, int(lengths.sum()))
    return Ragged(flat, lengths)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of text, whole rows only."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class WordCache:
    """Ids of distinct words; remembers a bounded number of them between batches."""

    def __init__(self, encode: Callable[[list[str]], list], dtype, remember: int = 400_000):
        self.encode, self.dtype, self.remember, self.known = encode, dtype, remember, {}

    def __call__(self, words: pa.Array) -> Ragged:
        texts = words.to_pylist()
        found = [self.known.get(w) for w in texts]
        missing = [i for i, x in enumerate(found) if x is None]
        code = np.dtype(self.dtype).char
        fresh = [array(code, x).tobytes() for x in self.encode([texts[i] for i in missing])]
        for i, packed in zip(missing, fresh):
            found[i] = packed
        if len(self.known) < self.remember:
            self.known.update((texts[i], found[i]) for i in missing[: self.remember - len(self.known)])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        return Ragged(np.frombuffer(b"".join(found), self.dtype), lengths)


def words_of(texts: pa.Array, split: Callable[[pa.Array], pa.ListArray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the index of every word among them, and the number of words of each text."""
    lists = split(texts)
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of counts[i] values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def binary_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per run of lengths[i] elements."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * flat.dtype.itemsize
    data = pa.py_buffer(np.ascontiguousarray(flat))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), data])
