"""Vectorised words and word-window fingerprints over Arrow text columns, for use inside tasks.

Everything here works on the UTF-8 bytes of a whole Arrow batch with numpy; no Python object is made for a word. Work is
cut into pieces of about two megabytes so that a task's memory depends on the piece (or on the single longest document),
not on the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)
#: Keeps the first 0 to 8 bytes of a little-endian lane.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed by BLAKE2b, one by one.
LONG_SPAN = 64


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags: False for bytes in the given closed ranges."""
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; offsets are relative to ``data`` and words never cross rows."""
    mask = is_word[data]
    begin, last = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = mask[firsts]
    finals = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[finals] = mask[finals]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of the bytes of each span; another ``seed`` gives an independent one.

    Spans go through a chained finaliser eight bytes at a time, all spans in step. Each step is a bijection of the bytes,
    so spans of equal length of up to eight bytes never share a fingerprint.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * _LENGTH + np.uint64(seed) * _LEFT)
    lanes = np.zeros(len(data) // 8 + 2, np.uint64)
    lanes.view(np.uint8)[: len(data)] = data
    rest = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[rest].astype(np.int64), size[rest]
    while len(rest):
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # A shift by 64 is made of two, as one of that width would do nothing.
        lane = (lanes[place] >> shift) | ((lanes[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        out[rest] = mix((out[rest] ^ (lane & _LANE[np.minimum(left, 8)])) * _BASE + _LEFT)
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every ``k`` consecutive values, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, level = None, 0, 1, hashes
    while True:
        if k & size:
            part = level[at : at + n]
            out = mix(part + _LENGTH) if out is None else mix(out * _LEFT + part)
            at += size
        if 2 * size > k:
            return out
        level = mix(level[:-size] * _BASE + level[size:])
        size *= 2


def within(rows: np.ndarray, k: int) -> np.ndarray:
    """Flags the windows of ``k`` words that lie in one row."""
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Flags the positions of ``range(n)`` that intervals cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
