"""Vectorised text kernels shared by the operators that work inside Arrow batches.

Texts come as Arrow string arrays; a batch is cut into pieces of a few hundred
kilobytes so that the numpy temporaries stay small whatever the record batch
size is.  Words are byte runs, identified by 64-bit polynomial hashes taken from
prefix sums, so the cost per byte is a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407) + U(seed))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = PIECE_BYTES + 1
    while size < n:
        size *= 2
    if size not in _POW:
        if size > PIECE_BYTES + 1:  # a very long text: not kept
            return _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        _POW[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW[size]


SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)
ALNUM[:128] = [chr(i).isalnum() for i in range(128)]


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text offsets) of runs of whole texts of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a piece: ``start``/``end`` byte positions, ``hash``, and ``first``: word index where each text begins (and the total)."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES, lower: bool = False, seed: int = 1):
        self.start, self.end = word_bounds(data, offsets, table)
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hash(data, self.start, self.end, lower, seed)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:] - 1
        after[cut[cut >= 0]] = False
    return start, np.flatnonzero(inside & ~after) + 1


def prefix_sums(data: np.ndarray, lower: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_codes(seed, lower)[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """Hash of each byte span; equal byte sequences give equal hashes in any batch."""
    sums, inverse = prefix_sums(data, lower, seed)
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, document borders ignored (mask with ``same_text``)."""
    m = len(word_hash) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for j in range(k):
        out *= _GRAM
        out += word_hash[j : j + m]
    return mix64(out)


def same_text(first: np.ndarray, k: int, doc: np.ndarray) -> np.ndarray:
    """Whether the k words from each word on lie in one text (for the m = n - k + 1 window starts)."""
    m = len(doc) - k + 1
    return np.arange(max(m, 0)) + k <= first[1:][doc[: max(m, 0)]]


def cover(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Boolean array of positions 0..n-1 inside any [start, start + width)."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def unique_in_text(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) pairs sorted by doc then hash, and their counts."""
    if not len(hashes):
        return doc[:0], hashes[:0], np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.empty(len(d), bool)
    new[0] = True
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(d)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(U)


def list_array(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))
