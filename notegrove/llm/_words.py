"""Words of whole texts as arrays: positions and hashes made from the bytes of an Arrow column, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: The lowest k bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Longer words are hashed one by one.
_SHORT = 64
#: Bytes of text worked on at a time, so that the arrays stay in the processor's cache.
BLOCK_BYTES = 256 << 10


@dataclass
class Words:
    """Of the texts of a column, in order: each word's text, line of all the texts together, place of its line in its text, and hash."""

    text: np.ndarray
    line: np.ndarray
    number: np.ndarray
    hashes: np.ndarray


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts in them, with the end."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n, (_, at, data) = len(column), column.buffers()
    offsets = np.frombuffer(at, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _hashed(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Words of up to eight bytes get different ones if their sizes are equal."""
    eight = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))
    h, part, k = sizes.astype(np.uint64) * _ODD[1], np.flatnonzero(sizes <= _SHORT), 0
    while len(part):
        own = h[part] ^ (eight[starts[part] + k] & _FIRST[np.minimum(sizes[part] - k, 8)])
        own *= _ODD[0]
        own ^= own >> np.uint64(32)
        own *= _ODD[1]
        h[part] = own ^ (own >> np.uint64(29))
        k += 8
        part = part[sizes[part] > k]
    for i in np.flatnonzero(sizes > _SHORT):
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK_BYTES in a string column, one row at least."""
    start, ends = 0, _bytes_of(batch.column(column))[1][1:]
    while start < batch.num_rows:
        begun = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, begun + BLOCK_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def words_of(column: pa.Array) -> Words:
    """Words are runs of bytes other than ASCII white space, hashed with A-Z lower-cased. Null texts have none."""
    raw, offsets = _bytes_of(column)
    gap = (raw == 0x20) | (raw - np.uint8(0x09) < 5)
    cut = np.ones(len(raw) + 1, bool)  # whether a text starts here, or the byte before separates
    cut[1:-1] = gap[:-1]
    cut[offsets] = True
    starts = np.flatnonzero(~gap & cut[:-1])
    cut[1:-1] = gap[1:]
    cut[offsets] = True
    ends = np.flatnonzero(~gap & cut[1:]) + 1
    low = np.frombuffer(raw.tobytes().lower() + bytes(8), np.uint8)
    text = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(starts, offsets)))
    breaks = np.cumsum(raw == 10, dtype=np.int32)  # line breaks up to here
    before = np.append(0, breaks)[offsets[:-1]]
    line = breaks[starts]
    return Words(text, line + text, line - before[text], _hashed(low, starts, ends - starts))
