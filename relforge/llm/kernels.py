"""Vectorised text kernels shared by the corpus operators.

All kernels work on the bytes of an Arrow string column, many documents at a
time, so Python never loops over words.  Words are the maximal runs of bytes
other than space and 0x09-0x0D; upper-case A-Z is folded, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call takes at once; longer documents make a call of their own.
CHUNK_BYTES = 1 << 19

_MASK = (1 << 64) - 1
#: Multiplier of the rolling word hash: odd, and 5 modulo 8.
_STEP = 0x9E3779B97F4A7C15 - 0x10 & _MASK | 5


def _mix_table(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values by the splitmix64 rule."""
    z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    z = z.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_BYTE_VALUE = _mix_table(7, 256)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the powers 0..n-1, and the same of its inverse modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("down", inverse)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                more = min(have, size - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of every word; offsets[0] is 0."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[data]
    inside[-1] = False
    begins = np.empty(len(data) + 1, dtype=bool)
    begins[0] = inside[0]
    begins[1:] = inside[1:] & ~inside[:-1]
    cuts = offsets[1:-1]
    begins[cuts] = inside[cuts]  # a word ends where its document ends
    first = np.flatnonzero(begins[:-1])
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    inner = cuts[cuts > 0]
    ends[inner] = inside[inner - 1]
    last = np.flatnonzero(ends)
    row = np.searchsorted(offsets, first, side="right") - 1
    return first, last, row


def pieces(data: np.ndarray, most: int = 4 * CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of one text of about `most` bytes each that begin at white space, so that no word is cut."""
    start = 0
    while start < len(data):
        end = start + most
        while end < len(data):
            found = np.flatnonzero(_SPACE[data[end : end + most]])
            if len(found):
                end += int(found[0])
                break
            end += most
        yield start, min(end, len(data))
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every folded word, in text order; a long text is taken piece by piece."""
    if len(offsets) == 2 and len(data) > 4 * CHUNK_BYTES:
        parts = [_word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data)]
        out = np.concatenate(parts)
        return out, np.zeros(len(out), dtype=np.int64)
    return _word_hashes(data, offsets)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last, row = words(data, offsets)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), row
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUE[_FOLD[data]] * up, out=total[1:])
        value = (total[last] - total[first]) * down[first]
    return mix64(value + (last - first).astype(np.uint64)), row


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `width` words; a shorter row with words is one run as a whole."""
    counts = np.bincount(row, minlength=rows)
    starts = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    with np.errstate(over="ignore"):
        if n >= width:
            value = np.zeros(n - width + 1, dtype=np.uint64)
            for k in range(width):
                value = mix64(value * np.uint64(3) + hashes[k : n - width + 1 + k])
            whole = row[: n - width + 1] == row[width - 1 :]
            out, of = value[whole], row[: n - width + 1][whole]
        else:
            out, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=row.dtype)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.zeros(len(short), dtype=np.uint64)
            for k in range(width - 1):
                has = counts[short] > k
                extra[has] = mix64(extra[has] * np.uint64(3) + hashes[starts[short[has]] + k])
            extra = mix64(extra ^ np.uint64(0x5851F42D4C957F2D) * counts[short].astype(np.uint64))
            out, of = np.concatenate([out, extra]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def order_in_rows(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row, then value: a fast unstable sort of the values and a radix sort of the rows."""
    first = np.argsort(values)
    of = row[first]
    if len(row) and int(row.max()) < 65536:
        of = of.astype(np.uint16)
    return first[np.argsort(of, kind="stable")]


def row_sets(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, joined, and the offsets of the rows."""
    order = order_in_rows(values, row)
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)
