"""Words and word shingles of whole texts as 64-bit hashes, in numpy over Arrow string batches.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; UTF-8
continuation bytes never fall in that set, so working on bytes equals working on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for words without their punctuation.
SPACE_OR_PUNCTUATION = SPACE.copy()
SPACE_OR_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))[_LOWER]
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        _POW = np.cumprod(np.append(np.ones(1, np.uint64), np.full((1 << (n - 1).bit_length()) - 1, _R, np.uint64)))
    return _POW


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n, at = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total) of all words, in order."""
    inside = ~between[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True  # a text begins, so a word does too
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (np.concatenate((first[1:-1], [True])) | ~np.concatenate((inside[1:], [False])))) + 1 if len(raw) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total); ``between`` says which bytes part words."""
    raw, offsets = buffers(texts)
    starts, ends, firsts = word_spans(raw, offsets, between)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)  # place of each byte in its word
    value = VALUE[raw[~between[raw]]] * _powers(int(sizes.max()))[at]
    return mix(np.add.reduceat(value, begins) + sizes.astype(np.uint64)), firsts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` values are of no use to the caller."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(_R)
        out[: max(n - k, 0)] += words[k:]
    return mix(out)


def slices(texts: pa.Array, ids: pa.Array, most: int = 2 << 20):
    """Parts of a batch with about ``most`` bytes of text each, so that memory follows one part."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield ids.slice(at, to - at), texts.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; with fewer words than ``size`` the whole sequence is one."""
    return [s for _, part in slices(texts, texts) for s in _sets(part, size)]  # in parts, for memory's sake


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    words, firsts = word_hashes(texts)
    shingles = shingle_hashes(words, size)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            h = int(b - a)
            for w in words[a:b]:
                h = (h * _R + int(w)) & _M
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
