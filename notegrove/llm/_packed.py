"""Numpy columns dealt over Spark partitions as a few binary rows, and tables of a fixed size summed over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEALT = "part int, payload binary"
#: Entries of a summed table in one row.
SLICE = 1 << 14


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_of(part: Iterable[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(payload, pa.binary())], names=["part", "payload"])


def dealt(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each part that occurs: its rows of the columns, one column after the other."""
    order = np.argsort(part, kind="stable")
    columns, part = [c[order] for c in columns], part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
    payload = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(starts, np.append(starts[1:], len(part))[: len(starts)], strict=True)]
    return batch_of(part[starts], payload)


def undealt(payload: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = len(payload) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(payload, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def gathered(payloads: Iterable[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all payloads together."""
    parts = [undealt(p, kinds) for p in payloads]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def ragged(fixed: list[np.ndarray], kinds: list[str], flat: np.ndarray) -> bytes:
    """Columns, and a run of the flat array for each row, as bytes."""
    return len(fixed[0]).to_bytes(8, "little") + b"".join(c.astype(k, copy=False).tobytes() for c, k in zip(fixed, kinds, strict=True)) + flat.tobytes()


def unragged(blobs: Iterable[bytes], kinds: list[str], flat: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns and the flat arrays of all blobs together."""
    parts, flats = [], [np.zeros(0, flat)]
    for p in blobs:
        n, at = int.from_bytes(p[:8], "little"), 8
        parts.append(undealt(p[at : at + n * sum(np.dtype(k).itemsize for k in kinds)], kinds))
        flats.append(np.frombuffer(p, flat, offset=at + n * sum(np.dtype(k).itemsize for k in kinds)))
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)], np.concatenate(flats)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)


def dealt_ragged(part: np.ndarray, fixed: list[np.ndarray], kinds: list[str], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """One row for each part that occurs, with its rows of the columns and their runs of flat."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    out = []
    for a, b in zip(begins, np.append(begins[1:], len(part))[: len(begins)], strict=True):
        rows = order[a:b]
        out.append(ragged([c[rows] for c in fixed], kinds, flat[runs(starts[rows], sizes[rows])]))
    return batch_of(part[begins], out)


def payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column(batch.schema.get_field_index("payload")).to_pylist()


def summed(df: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], size: int) -> np.ndarray:
    """A table of `size` entries, whatever the input's size: the sums of the amounts that the tasks find for the entries. A
    task sends the entries that it has found only, in slices, which are added up by other tasks before the driver gets them."""
    slices = -(-size // SLICE)

    def run(batches):
        own = np.zeros(slices * SLICE, np.int64)
        for at, amount in entries(batches):
            if len(at) * 8 < size:
                np.add.at(own, at, amount)
            else:
                own += np.bincount(at, amount, len(own)).astype(np.int64)
        at = np.flatnonzero(own)
        yield dealt(at // SLICE, [(at % SLICE).astype("<u2"), own[at].astype("<i8")])

    def add(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, amount = undealt(payload, ["<u2", "<i8"])
                np.add.at(whole.setdefault(part, np.zeros(SLICE, np.int64)), at, amount)
        yield batch_of(list(whole), [x.tobytes() for x in whole.values()])

    parts = df.mapInArrow(run, DEALT).repartitionById(min(slices, partitions(df.sparkSession)), "part").mapInArrow(add, DEALT)
    out = np.zeros(slices * SLICE, np.int64)
    for row in parts.collect():
        out[row["part"] * SLICE :][:SLICE] = np.frombuffer(row["payload"], np.int64)
    return out[:size]


class Marks:
    """A set of 64-bit hashes in a bitmap: it never denies a member, and admits others the more, the fuller it is. It has LEAST
    bits for each hash, so it is no fuller for a large corpus, up to MOST bits. It spares a shuffle the rows that can't have a
    partner; what passes is joined exactly."""

    BITS = 1 << 22
    LEAST = 16
    MOST = 1 << 28
    #: Bits of a bitmap in one row.
    SLICE = 1 << 17
    #: Hashes that a task gathers before it sends them.
    GATHERED = 1 << 20

    def __init__(self, bits: np.ndarray):
        """bits: packed, the lowest first."""
        self._bits, self._size = bits, np.uint64(8 * len(bits))

    @classmethod
    def size(cls, n: int) -> int:
        """Bits for n hashes: a power of two."""
        return min(cls.MOST, max(cls.BITS, 1 << (cls.LEAST * n - 1).bit_length()))

    @classmethod
    def of(cls, df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], each: int = 1) -> Marks:
        """hashes: those of a batch, of which a row has `each`."""
        return cls.over(df, lambda batches: map(hashes, batches), each * df.count())

    @classmethod
    def over(cls, df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], n: int) -> Marks:
        """The hashes, of which there are n, that the tasks find. Other tasks put them together before the driver gets the bits."""
        size = cls.size(n)
        slices = max(1, size // cls.SLICE)

        def sent(held):
            at = np.unique(np.concatenate(held) % np.uint64(size)).astype(np.int64)
            return dealt(at // cls.SLICE, [(at % cls.SLICE).astype("<u4")])

        def run(batches):
            held, waiting = [], 0
            for found in hashes(batches):
                held.append(found)
                waiting += len(found)
                if waiting >= cls.GATHERED:
                    yield sent(held)
                    held, waiting = [], 0
            if held:
                yield sent(held)

        def add(batches):
            whole: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    bits = whole.setdefault(part, np.zeros(cls.SLICE // 8, np.uint8))
                    own = np.zeros(cls.SLICE, bool)
                    own[np.frombuffer(payload, "<u4")] = True
                    bits |= np.packbits(own, bitorder="little")
            yield batch_of(list(whole), [x.tobytes() for x in whole.values()])

        parts = df.mapInArrow(run, DEALT).repartitionById(min(slices, partitions(df.sparkSession)), "part").mapInArrow(add, DEALT)
        out = np.zeros(slices * cls.SLICE // 8, np.uint8)
        for row in parts.collect():
            out[row["part"] * cls.SLICE // 8 :][: cls.SLICE // 8] = np.frombuffer(row["payload"], np.uint8)
        return cls(out[: size // 8])

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % self._size
        return (self._bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the integers of each row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h
