"""Tables of counters and bits over 64-bit hashes, of a size that is stated, made from all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLOTS = 256
_GATHER = 1 << 20


def add_counts(table: np.ndarray, values: np.ndarray) -> None:
    """Count the values (uint64) in the counters that their last bits name, in place: nothing else of the table's size is made."""
    np.add.at(table, (values & np.uint64(len(table) - 1)).astype(np.intp), np.uint32(1))


def heavy_bits(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int, times: float) -> np.ndarray:
    """One bit a counter, of 2**bits that count all hashes that hashes_of makes of df's batches: those above max(least, times x the mean of a slot's).

    Each task sends one table of fixed size in SLOTS rows; the tables are added
    as they stream in and marked by the same pass of Python, so memory does not
    depend on the number of tasks.  What comes to the driver is 2**bits / 8
    bytes, whatever the input.
    """
    size, part = 1 << bits, (1 << bits) // SLOTS

    def count(batches):
        table, waiting, n = np.zeros(size, dtype=np.uint32), [], 0
        for batch in batches:
            for got in hashes_of(batch):
                waiting.append(got)
                n += len(got)
                if n >= _GATHER:
                    add_counts(table, np.concatenate(waiting))
                    waiting, n = [], 0
        if waiting:
            add_counts(table, np.concatenate(waiting))
        for s in range(SLOTS):
            own = np.minimum(table[s * part : (s + 1) * part], 65535).astype(np.uint16)
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slot", "counters"])

    def mark(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s not in sums:
                    sums[s] = np.zeros(part, dtype=np.uint32)
                sums[s] += np.frombuffer(blob.as_buffer(), dtype=np.uint16)
        for s, own in sums.items():
            bound = max(least, int(times * own.mean()))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own > bound).tobytes()], pa.binary())], names=["slot", "marks"])

    out = np.zeros((SLOTS, part // 8), dtype=np.uint8)
    for row in df.mapInArrow(count, "slot int, counters binary").repartition("slot").mapInArrow(mark, "slot int, marks binary").collect():
        out[row.slot] = np.frombuffer(row.marks, dtype=np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _place(values: np.ndarray, bits: int, shift: int) -> np.ndarray:
    return values >> np.uint64(shift) & np.uint64((1 << bits) - 1)


def bitmaps(values: DataFrame, bits: int, shifts: tuple[int, ...]) -> list[np.ndarray]:
    """For each shift 2**bits bits, packed, of which those are set that `bits` bits of the values (one column of longs), from the shift on, name.

    Each of SLOTS parts is made by one task; 2**bits / 8 bytes a shift come to the driver.
    """
    part = (1 << bits) // SLOTS

    def spread(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, shift in enumerate(shifts):
                at = np.unique(_place(own, bits, shift)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((k * SLOTS + at // part).astype(np.int32)), pa.array((at % part).astype(np.int32))], names=["slot", "at"])

    def run(batches):
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(slot).tolist():
                marks.setdefault(s, np.zeros(part, dtype=bool))[at[slot == s]] = True
        for s, own in marks.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["slot", "marks"])

    out = np.zeros((len(shifts) * SLOTS, part // 8), dtype=np.uint8)
    for row in values.mapInArrow(spread, "slot int, at int").repartition("slot").mapInArrow(run, "slot int, marks binary").collect():
        out[row.slot] = np.frombuffer(row.marks, dtype=np.uint8)
    return list(out.reshape(len(shifts), -1))


def has_bits(marks: np.ndarray, values: np.ndarray, bits: int, shift: int) -> np.ndarray:
    """Which of the values (uint64) have their bit set in `marks`, as `bitmaps` makes it."""
    at = _place(values, bits, shift)
    return (marks[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
