"""Words of UTF-8 texts as numpy arrays, many texts at a time.

The Python workers get Arrow batches. Here a batch is walked in slices of a bounded number of bytes, and
all words of a slice are found and hashed with a few array operations, without a Python object per word.
Only ASCII bytes separate words, so the work on bytes equals the work on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # small enough for the working arrays to stay in the processor's cache
U = np.uint64
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _word_bytes(separators: set[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[sorted(separators)] = False
    return table


#: Words are runs of anything but white space.
BY_SPACE = _word_bytes({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, ASCII letters and all characters beyond ASCII.
BY_LETTERS = _word_bytes({*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})

_RANDOM = np.random.default_rng(20240229)
BYTE_VALUE = _RANDOM.integers(0, 1 << 64, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i below n; kept, as every slice needs the same."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), U(base & (2**64 - 1)))
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(byte k) * base**k over i <= k < j."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; equal for equal bytes, wherever they stand."""
    h = (sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start]
    return mix(h + (end - start).astype(U) * U(0xA24BAED4963EE407))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of a string column; null is empty.

    A slice holds whole texts of at most ``limit`` bytes together, or one longer text.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """(start, end, text number) of all words; they never cross texts."""
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    counts = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    return start, end, np.repeat(np.arange(len(offsets) - 1), counts)


def hashed_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """(hashes, text number, start, end) of all words in lower case."""
    if len(data) > 8 * SLICE_BYTES:
        return _hashed_in_pieces(data, word_bytes)
    data = LOWER[data]
    start, end, owner = words(data, offsets, word_bytes)
    return range_hashes(prefix_sums(data), start, end), owner, start, end


def _hashed_in_pieces(data: np.ndarray, word_bytes: np.ndarray):
    """One very long text: cut between words, so that the arrays of bytes stay small."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + 4 * SLICE_BYTES)
        while end < len(data) and word_bytes[LOWER[data[end - 1]]] and word_bytes[LOWER[data[end]]]:
            end += 1
        piece = LOWER[data[at:end]]
        s, e, _ = words(piece, np.array([0, len(piece)]), word_bytes)
        h = range_hashes(prefix_sums(piece), s, e)
        parts.append((h, s + at, e + at))
        at = end
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, np.zeros(len(h), np.int64), s, e


_STEP = [U(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, k: int):
    """(hashes, text number) of all runs of k words; a text with fewer words, but not none, has one of them all."""
    return placed_shingles(hashes, owner, n_texts, k)[:2]


def placed_shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, k: int):
    """The same, with the number of the first word. Those of short texts come last."""
    full = max(0, len(hashes) - k + 1)
    h = np.full(full, U(k))
    for i in range(k):
        h = (h ^ hashes[i : i + full]) * _STEP[i % len(_STEP)]
        h ^= h >> U(29)
    whole = owner[:full] == owner[k - 1 :] if full else np.empty(0, bool)
    h, of, at = h[whole], owner[:full][whole], np.flatnonzero(whole)
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = np.searchsorted(owner, few)
        short = counts[few].astype(U)
        for i in range(k - 1):
            has = counts[few] > i
            step = (short[has] ^ hashes[first[has] + i]) * _STEP[i % len(_STEP)]
            short[has] = step ^ (step >> U(29))
        h, of, at = np.concatenate([h, mix(short)]), np.concatenate([of, few]), np.concatenate([at, first])
    return mix(h), of, at


def distinct(values: np.ndarray, owner: np.ndarray):
    """Distinct values of each text, ordered by text and value."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], o[new]


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from the values of all rows and the number in each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
