"""Word and shingle hashes of many texts at once, with numpy, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE_BYTES = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word (bytes between ASCII white space) of ``data``, in order."""
    out = []
    begin = 0
    while begin < len(data):
        end = begin + PIECE_BYTES
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(np.frombuffer(data, dtype=np.uint8, count=min(end, len(data)) - begin, offset=begin)))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    letter = ~_SPACE[raw]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    kept = raw[letter].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(kept)) - np.repeat(first, lengths)
    sums = np.add.reduceat(kept * _powers(int(lengths.max()))[within], first)
    return mix64(sums * _MUL + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        total = total * _BASE + words[k : k + n]
    return mix64(total)


def shingle_sets(texts: Iterable[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for text in texts:
        yield np.unique(shingle_hashes(word_hashes(text), width))


def text_bytes(text: str | None, lower: bool = False) -> bytes:
    """UTF-8 of a text, NULL as empty; A-Z lower-cased on request."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.translate(_LOWER) if lower else data
