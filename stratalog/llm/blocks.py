"""Blocks: rows of a text column that a task handles together, bounded by their bytes, and their words as Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratalog.llm import text as tx

BLOCK_BYTES = 1 << 23


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.Table]:
    """The rows in blocks of at most ``limit`` bytes of text; a longer text is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = tx.column_bytes(batch.column(column))
        for begin, end in tx.pieces(offsets, limit):
            part, more = batch.slice(begin, end - begin), int(offsets[end] - offsets[begin])
            if held and size + more > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def words_of(column: pa.ChunkedArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all rows in order, and the offsets of the rows in them; a null has none."""
    rows = pc.fill_null(column, "").cast(pa.large_string()).combine_chunks()
    parts = pc.ascii_split_whitespace(rows)
    words, starts = parts.flatten(), np.asarray(parts.offsets, np.int64)
    starts = starts - starts[0]
    there = np.asarray(pc.binary_length(words)) > 0
    return words.filter(pa.array(there)), np.append(0, np.cumsum(there))[starts]


def list_column(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def joined(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """The values of each row, joined by one space."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosened(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers of one width, compressed byte by byte of each, as small numbers are most."""
    return squeezed(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes())


def unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    planes = np.frombuffer(loosened(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
