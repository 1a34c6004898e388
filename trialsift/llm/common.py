"""Word hashing over Arrow text batches, bucketed payloads and small links helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.session import scratch_path

#: What separates words: space and U+0009..U+000D, in every contract of this package.
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text hashed at once; bounds what one task holds in numpy.
SLICE_BYTES = 512 << 10
#: Rows whose texts become Python strings at once.
BATCH_ROWS = 1000

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later readers survive lost executors and recompute nothing."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most; above, both sides of a join are shuffled.
BROADCAST_ROWS = 1_000_000


def short(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it is counted at BROADCAST_ROWS or fewer; its rows hold a few numbers each."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def release_memory() -> None:
    """Give freed memory back at the end of a task: idle workers count against their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that a task unpacks and sends back little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = np.array([splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BYTE[_IS_SEP] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


class Words:
    """Words of consecutive texts: byte spans, 64-bit hashes, and each text's range of words."""

    __slots__ = ("data", "starts", "ends", "hashes", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        """data: the texts' bytes back to back; offsets: where each begins, and the end."""
        sep = _IS_SEP[data]
        inside = ~sep
        begin = inside.copy()
        begin[1:] &= sep[:-1]
        cuts = offsets[:-1]
        cuts = cuts[cuts < len(data)]
        begin[cuts] = inside[cuts]
        self.data = data
        self.starts = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= sep[1:]
        last = offsets[1:]
        last = last[last > 0] - 1
        stop[last] = inside[last]
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            reach = np.diff(np.append(self.starts, len(data)))
            at = np.arange(self.starts[0], len(data)) - np.repeat(self.starts, reach)
            value = (_BYTE_LOWER if lower else _BYTE)[data[self.starts[0] :]]
            value = value * _powers(_BASE, int(reach.max()))[at]
            sums = np.add.reduceat(value, self.starts - self.starts[0])
            self.hashes = mix64(sums + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.empty(0, dtype=np.uint64)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    # the column's own bytes: a copy of a batch of texts would count against the executor
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` word hashes (also of runs that cross texts; the caller masks those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * np.uint64(splitmix(1000 + j) | 1)
    return mix64(out)


def pack_low(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_low(raw: bytes | memoryview, width: int) -> np.ndarray:
    low = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :width] = low
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack48(values: np.ndarray) -> bytes:
    return pack_low(values, 6)


def unpack48(raw: bytes | memoryview) -> np.ndarray:
    return unpack_low(raw, 6)


def buckets_for(items: int, per_bucket: int = 2_000_000, least: int = 64) -> int:
    """Power of two of buckets with about `per_bucket` items each."""
    n = least
    while n * per_bucket < items:
        n *= 2
    return n
