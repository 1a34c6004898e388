"""Training-order materialisation (operator 4).

Token ids are cut into sequences of fixed length and numbered; a keyed
Feistel permutation with cycle walking gives every number a global slot, a
bijection of 0..N-1 that is computed from the number alone.  Range partitions
of slots then write shards: row k of a shard is one binary record of fixed
stride, so slot s stands at byte (s mod per_shard) * stride of shard
s div per_shard.  Reading in training order is sequential, and a reader can
resume at any slot by opening the shards from there on.

A record is: sequence number (8 bytes), count of ids (4 bytes), then the ids as
16-bit numbers, padded with zeros; all little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import mix64, short, splitmix, table
from trialsift.llm.drr_packing import END_ID, TEXT_CHARS, stored_ids
from trialsift.llm.tokens import encoder, tokenizer_path
from trialsift.session import scratch_path

LENGTH = 2048
#: Records of one shard.
PER_SHARD = 1024
ROUNDS = 6
KEY = 20_26
_HEAD = 12


def permuted(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of `numbers`, all below `n`: a permutation of 0..n-1 set by `key`."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(splitmix(splitmix(key) + r)) for r in range(rounds)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]  # walk on until the value is inside
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(chunk, place, n, ids): a task's documents, each with its end id, back to back in runs of `length` ids.

    ids are compressed 16-bit little-endian numbers; only a task's last run is shorter.
    """
    tail = int(end_id).to_bytes(2, "little")

    def run(batches):
        coder, chunk = encoder(tokenizer), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        place, held = 0, b""

        def rows(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(parts), pa.int64()),
                    pa.array(range(place, place + len(parts)), pa.int64()),
                    pa.array([len(p) // 2 for p in parts], pa.int32()),
                    pa.array([pack.compress(p) for p in parts], pa.binary()),
                ],
                names=["chunk", "place", "n", "ids"],
            )

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= TEXT_CHARS):
                    chars += len(texts[b])
                    b += 1
                held = b"".join([held, *(x + tail for x in coder.encode(texts[a:b]))])
                whole = len(held) // (2 * length) * 2 * length
                parts = [held[i : i + 2 * length] for i in range(0, whole, 2 * length)]
                held = held[whole:]
                yield rows(parts)
                place += len(parts)
                a = b
        if held:
            yield rows([held])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "chunk long, place long, n int, ids binary")


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
    end_id: int = END_ID,
) -> int:
    """Write the shards of `docs` (text) under `path` and return the number of sequences.

    Null and empty texts are one end id; repeated rows are written each; an
    empty table gives an empty set of shards.  Other columns are ignored.
    """
    cut = stored_ids(sequences(docs, tokenizer or tokenizer_path(), length, end_id), "order-ids")
    chunks = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("of"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the writer
    base = chunks.withColumn("base", F.coalesce(F.sum("of").over(earlier), F.lit(0))).drop("of")
    n = cut.count()
    stride = _HEAD + 2 * length

    def slots(batches):
        for batch in batches:
            number = batch.column("base").to_numpy() + batch.column("place").to_numpy()
            slot = permuted(number, n, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard), pa.array(slot), pa.array(number), batch.column("n"), batch.column("ids")],
                names=["shard", "slot", "number", "n", "ids"],
            )

    def fill(batches):
        unpack, shard, body, first, records = zstandard.ZstdDecompressor(), None, bytearray(), 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x], pa.int64()) for x in (shard, first, records, stride)),
                    pa.array([bytes(body)], pa.binary()),
                ],
                names=["shard", "first_slot", "records", "stride", "body"],
            )

        for batch in batches:
            for s, slot, number, k, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "number", "n", "ids"))):
                if s != shard:
                    if records:
                        yield row()
                    shard, body, first, records = s, bytearray(), slot, 0
                body += int(number).to_bytes(8, "little") + int(k).to_bytes(4, "little")
                body += unpack.decompress(raw, max_output_size=2 * length).ljust(2 * length, b"\0")
                records += 1
        if records:
            yield row()

    placed = cut.join(short(base), "chunk").mapInArrow(slots, "shard long, slot long, number long, n int, ids binary")
    shards = max(1, -(-n // per_shard))
    (
        placed.repartitionByRange(max(2, min(shards, 100_000)), "shard")
        .sortWithinPartitions("slot")
        .mapInArrow(fill, "shard long, first_slot long, records long, stride long, body binary")
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return n


_SHARD = "shard long, first_slot long, records long, stride long, body binary"


def read_records(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """(slot, shard, sequence, n_ids, ids) from `from_slot` on, a shard's records in order."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "first_slot", "records", "stride", "body"))
            for shard, first, records, stride, body in zip(*columns):
                slots, numbers, counts, ids = [], [], [], []
                for k in range(max(0, from_slot - first), records):
                    at = k * stride
                    m = int.from_bytes(body[at + 8 : at + _HEAD], "little")
                    slots.append(first + k)
                    numbers.append(int.from_bytes(body[at : at + 8], "little"))
                    counts.append(m)
                    ids.append(body[at + _HEAD : at + _HEAD + 2 * m])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots, pa.int64()),
                        pa.array([shard] * len(slots), pa.int64()),
                        pa.array(numbers, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["slot", "shard", "sequence", "n_ids", "ids"],
                )

    shards = spark.read.schema(_SHARD).parquet(path).where(F.col("first_slot") + F.col("records") > from_slot)
    return shards.mapInArrow(run, "slot long, shard long, sequence long, n_ids long, ids binary")


def records_digest(records: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype="<u2").astype("<u4")) for x in batch.column("ids")]
            rest = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sums, pa.int64())], names=[*rest, "ids_crc32"])

    return records.mapInArrow(run, "slot long, shard long, sequence long, n_ids long, ids_crc32 long")


def op4_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards of `documents` to the shared folder and read them back in training order."""
    path = scratch_path(spark, "llm-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return records_digest(read_records(spark, path))
