"""Words of many texts as pointers into an Arrow buffer, sorted by a multikey quicksort.

A pointer is the place of a word's first byte. Words are compared eight bytes at a time: pointers
are split by the first eight, each run of equal ones by the next eight, and so on, until a run
holds one word. Nothing is copied out of the buffer but the words that leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidegrid.llm.hashing import mix64

SLICE_BYTES = 1 << 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: the first r of eight bytes
_FIRST = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - r))) & 0xFFFFFFFFFFFFFFFF for r in range(9)], dtype=np.uint64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)

#: Bytes of words: letters and whatever is not ASCII; the second kind has digits too.
LETTERS = np.array([c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
LETTERS_DIGITS = LETTERS | np.array([48 <= c <= 57 for c in range(256)])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``most`` bytes together, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1, first + 1)
        yield first, last
        first = last


def pieces(raw: np.ndarray, most: int, kind: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between words."""
    begin = 0
    while begin < len(raw):
        end = min(begin + most, len(raw))
        while end < len(raw) and kind[raw[end]]:
            end += 1
        yield raw[begin:end]
        begin = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, with eight zero bytes behind, so that any word can be read by eights."""
    out = np.zeros(len(raw) + 8, dtype=np.uint8)
    np.take(_LOWER, raw, out=out[: len(raw)])
    return out


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words in ``raw``, and the text of each; words end with their text."""
    if not len(raw):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = kind[raw]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[full], offsets[full + 1] - 1
    begin[heads], finish[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(finish) + 1 - starts
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, lengths, texts


def by_eights(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from every place, as one number whose order is theirs."""
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(len(padded) - 7,), strides=(1,))


def key_at(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    left = np.clip(lengths - 8 * depth, 0, 8)
    at = np.minimum(starts + 8 * depth, len(eights) - 1)
    return eights[at].astype(np.uint64) & _FIRST[left]


def sort_words(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their words (stable), and a mark where each run of equal words begins."""
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    eights = by_eights(padded)
    key = key_at(eights, starts, lengths, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = key[1:] != key[:-1]
    place, depth = np.arange(n), 0
    while True:
        # only runs of several words that go on behind these eight bytes are split further
        alone = first[place] & np.append(first, True)[place + 1]
        going = ~alone & ((key & np.uint64(0xFF)) != 0)
        place, depth = place[going], depth + 1
        if not len(place):
            return order, first
        run = np.cumsum(first)[place]
        some = order[place]
        key = key_at(eights, starts[some], lengths[some], depth)
        sub = np.lexsort((key, run))
        order[place], key = some[sub], key[sub]
        first[place[1:]] |= (key[1:] != key[:-1]) | (run[1:] != run[:-1])


def word_column(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words as an Arrow string column."""
    ends = np.cumsum(lengths)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    data = padded[np.repeat(starts, lengths) + within]
    offsets = np.append(0, ends).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def word_keys(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    eights = by_eights(padded)
    total = mix64(key_at(eights, starts, lengths, 0) + lengths.astype(np.uint64) * _STEP)
    depth, some = 1, np.flatnonzero(lengths > 8)
    while len(some):
        total[some] = mix64(total[some] * _STEP + key_at(eights, starts[some], lengths[some], depth))
        depth += 1
        some = some[lengths[some] > 8 * depth]
    return total


class Vocabulary:
    """A set of words that numbers the words of a text; a hash finds them, their bytes decide."""

    def __init__(self, listed: list[bytes]):
        self.raw = np.frombuffer(b"".join(listed) + bytes(8), dtype=np.uint8)
        self.lengths = np.array([len(w) for w in listed], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = word_keys(self.raw, self.starts, self.lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def numbers(self, padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not in the set."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        keys = word_keys(padded, starts, lengths)
        at = np.searchsorted(self.hashes, keys)
        ours, theirs, open_ = by_eights(self.raw), by_eights(padded), np.arange(len(starts))
        while len(open_):  # once, but for words of the set whose hashes are equal
            open_ = open_[at[open_] < len(self.hashes)]
            open_ = open_[self.hashes[at[open_]] == keys[open_]]
            found = self.order[at[open_]]
            same = self.lengths[found] == lengths[open_]
            depth, some = 0, np.flatnonzero(same)
            while len(some):
                w, v = open_[some], found[some]
                equal = key_at(theirs, starts[w], lengths[w], depth) == key_at(ours, self.starts[v], self.lengths[v], depth)
                same[some[~equal]] = False
                depth += 1
                some = some[equal & (lengths[w] > 8 * depth)]
            out[open_[same]] = found[same]
            open_ = open_[~same]
            at[open_] += 1
        return out
