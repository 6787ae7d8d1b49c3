"""Flat numpy kernels over Arrow string buffers: word spans, word hashes and shingle hashes.

A text never becomes a list of Python strings: words are found as byte ranges of the
Arrow buffer and hashed with a polynomial over prefix sums, a few nanoseconds a byte. Hashes have
64 bits: two of a billion words or grams that are compared share one with a chance of 3 %.
Work is cut into slabs of about ``SLAB`` bytes so that memory stays bounded whatever the
size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 1 << 20
LONG_WORD = 32
BATCH_BYTES = 4 << 20
_MMAP_THRESHOLD = -3  # of mallopt
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+ ; bytes of a multi-byte character are all word bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("r")
    if have is None or len(have) < n:
        size = max(n, SLAB + 1)
        for name, base in (("r", _R), ("i", _R_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    out = _POWERS["r"][:n], _POWERS["i"][:n]
    if n > 8 * SLAB:  # a giant text: don't keep its tables
        _POWERS.clear()
    return out


def slabs(column: pa.Array, slab: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about ``slab`` bytes each; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + slab, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of the runs of bytes in ``table``, never across texts."""
    inside = table[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edge] = inside[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[edge] = inside[edge]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes, equal hash, on every machine.

    Polynomials modulo 2^64 give equal sums for some long words of a known shape, whatever the multiplier, so words
    of more than LONG_WORD bytes are hashed by a digest of their bytes.
    """
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair; the finaliser keeps sums of several levels from cancelling."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(h) - n + 1 of them), from runs of twice the length each time."""
    if len(h) < n:
        return h[:0]
    count, at, size, part, out = len(h) - n + 1, 0, 1, h, None
    while True:
        if n & size:
            own = part[at : at + count]
            out = own if out is None else _joined(out, own)
            at += size
        size *= 2
        if size > n:
            return mix(out + np.uint64(n))
        part = _joined(part[: len(part) - size // 2], part[size // 2 :])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; quicker than numpy's unique on large integer arrays."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list array from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binaries(rows: np.ndarray) -> pa.Array:
    """Arrow binary array of the bytes of each row of a matrix of 8-byte numbers."""
    flat = np.ascontiguousarray(rows)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * (8 * flat.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of ``binaries``: rows of ``width`` 8-byte numbers."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), dtype=np.uint64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(-1, width)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map, with memory that it has freed given back at once (large arrays) and when a task ends: workers outlive their tasks."""

    def libc(call: str, *args: int) -> None:
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            getattr(ctypes.CDLL("libc.so.6"), call)(*args)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc("mallopt", _MMAP_THRESHOLD, 4 << 20)
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            libc("malloc_trim", 0)

    return mapped


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of at most BATCH_BYTES, as a few thousand rows of very long texts would be gigabytes.

    The limit is a setting of the session, which is lowered where it is higher.
    """
    conf = df.sparkSession.conf
    if not re.fullmatch("[0-9]+b?", now := conf.get(_BATCH)) or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(released(run), schema)


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """A DataFrame of numbers on the driver, as one array for each column.

    Rows travel as the bytes of their Arrow columns, so the driver holds numbers only; callers bound the rows.
    """
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for i in range(len(names))], names=names)

    rows = mapped(df.select(*(F.col(c).cast("double").alias(c) for c in names)), pack, ", ".join(f"{c} binary" for c in names)).collect()
    return {c: np.frombuffer(b"".join(bytes(r[c]) for r in rows), dtype=np.float64) for c in names}
