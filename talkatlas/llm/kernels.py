"""Vectorised text kernels over Arrow string buffers.

Every function works on the UTF-8 bytes of a whole record batch, so no Python
string is built per word. The separators of all word definitions used here are
ASCII, hence splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that one hashing pass covers: its temporaries stay in cache.
PASS_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _random_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, one for each byte."""
    x = (np.arange(256, dtype=U64) + U64(seed * 256 + 1)) * U64(_BASE)
    return mix64(mix64(x))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values (the published splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _fold(table: np.ndarray) -> np.ndarray:
    """The same value for A-Z as for a-z."""
    table = table.copy()
    table[65:91] = table[97:123]
    return table


RAW = _random_table(1)
FOLDED = _fold(RAW)
#: A second, independent table: two hashes make a 128-bit identity.
FOLDED2 = _fold(_random_table(2))
RAW2 = _random_table(2)


def _mask(separators: set[int]) -> np.ndarray:
    return np.array([i not in separators for i in range(256)])


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _mask({0x20, *range(0x09, 0x0E)})
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters, all beyond ASCII.
ALNUM = np.array([48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123 or i >= 128 for i in range(256)])

_POW = np.cumprod(np.full(PASS_BYTES + 1, _BASE, dtype=U64)) * U64(_BASE_INV)
_INV = np.cumprod(np.full(PASS_BYTES + 1, _BASE_INV, dtype=U64)) * U64(_BASE)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def doc_blocks(offs: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row is a range of its own."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def word_spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and each row's first word (rows + 1 numbers)."""
    w = word[buf]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    first, last = offs[full], offs[full + 1] - 1
    start[first] = w[first]
    end[last] = w[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over the table's values, mixed."""
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, starts[i] + PASS_BYTES, "right"))))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = hi - lo
        if size > PASS_BYTES:  # a single very long word: in parts
            h = U64(0)
            for at in range(lo, hi, PASS_BYTES):
                part = table[buf[at : min(hi, at + PASS_BYTES)]]
                h = mix64(np.array([h + np.sum(part * _POW[: len(part)], dtype=U64)], dtype=U64))[0]
            out[i] = h
        else:
            sums = np.empty(size + 1, dtype=U64)
            sums[0] = 0
            np.cumsum(table[buf[lo:hi]] * _POW[:size], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _INV[s] + (e - s).astype(U64)
        i = j
    return mix64(out)


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each n consecutive words (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    acc = words[:m] + U64(salt)
    for j in range(1, n):
        acc = acc * U64(_BASE) + words[j : j + m]
    return mix64(acc)


def gram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of hashes."""
    acc = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        acc = acc * U64(_BASE) + rows[:, j]
    return mix64(acc)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive keys, by doubling."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and rows + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))
