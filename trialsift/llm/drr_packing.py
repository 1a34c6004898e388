"""Mixture-controlled packing by deficit round robin (operator 5).

Every document becomes token ids and an end id.  The documents of a source
form a queue; a window of 2048 ids visits all queues and takes from each its
quantum, the queue's share of all tokens or its target proportion, in whole ids.  What rounding leaves a
queue short or ahead is its deficit and is carried to the next window, so every
window has the mixture's proportions to within a few ids and only the corpus'
last window can need padding.

The carried deficits depend on nothing but the queues' totals and the window's
number: ``Rounds.taken`` gives what a queue has sent after any number of
windows (the queues are halved again and again; each half gets the rounded
share of what its parent has sent).  A task can therefore continue the round
robin at any window, and documents are cut and placed where they lie: totals
are summed first, then no window, queue or source is gathered anywhere.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import in_parts, release_memory, short, table
from trialsift.llm.tokens import encoder, tokenizer_path
from trialsift.session import scratch_path

WINDOW = 2048
END_ID = 1
#: Characters tokenized at once.
TEXT_CHARS = 1 << 20


def phases(totals: list[int], targets: list[float]) -> list[list[int]]:
    """Ids of each queue in the stretches between which queues run empty, by target proportions.

    Within a stretch the queues that still hold ids send in proportion to their
    targets.  Queues without a target (0) share what comes after all others.
    """
    weight = [Fraction(w) for w in targets]
    ends = sorted({n / w for n, w in zip(totals, weight) if w and n})
    out, sent = [], [0] * len(totals)
    for end in ends:
        now = [min(n, int(w * end)) for n, w in zip(totals, weight)]
        out.append([b - a for a, b in zip(sent, now)])
        sent = now
    return [*out, [n - a for n, a in zip(totals, sent)]]


class Rounds:
    """The round robin over queues of `totals` ids, `size` ids a window; `targets`: proportions, the totals' own if None."""

    def __init__(self, totals: list[int], size: int = WINDOW, targets: list[float] | None = None):
        parts = [totals] if targets is None else phases([int(n) for n in totals], targets)
        self.sums = [np.append(0, np.cumsum(np.asarray(p, dtype=np.int64))).astype(np.int64) for p in parts]
        self.size, self.total, self.queues = size, sum(int(x[-1]) for x in self.sums), len(totals)
        self.windows = -(-self.total // size)
        self.kind = np.int64 if self.total < 1 << 31 else object  # products must not overflow

    def taken(self, queue: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After so many windows: ids sent by all queues before `queue`, and by `queue`."""
        every = np.minimum(np.asarray(windows, dtype=self.kind) * self.size, self.total)
        ahead = mine = np.zeros(every.shape, dtype=np.int64)
        for sums in self.sums:
            part = np.minimum(every, int(sums[-1]))
            every = every - part
            before, sent = self._split(sums, queue, part)
            ahead, mine = ahead + before, mine + sent
        return ahead, mine

    def _split(self, sums: np.ndarray, queue: int, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, low, high = sent * 0, 0, self.queues
        while high - low > 1:
            mid = (low + high) // 2
            whole, left = int(sums[high] - sums[low]), int(sums[mid] - sums[low])
            first = (sent * left + whole // 2) // whole if whole else sent * 0
            if queue < mid:
                sent, high = first, mid
            else:
                before, sent, low = before + first, sent - first, mid
        return before.astype(np.int64), sent.astype(np.int64)

    def window_of(self, queue: int, places: np.ndarray) -> np.ndarray:
        """Windows that take the ids at `places` of the queue."""
        low = np.zeros(len(places), dtype=np.int64)
        high = np.full(len(places), self.windows, dtype=np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            reached = self.taken(queue, mid + 1)[1] > places
            high = np.where(reached, mid, high)
            low = np.where(reached, low, np.minimum(mid + 1, high))
        return low

    def pieces(self, queue: int, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut documents that lie at `begin` in the queue: (document, start in it, length, window, place in the window)."""
        order = np.argsort(begin, kind="stable")
        a, b = begin[order], (begin + count)[order]
        ends = self.window_of(queue, np.array([a[0], b[-1] - 1]))
        if ends[1] - ends[0] <= 4 * count.sum():
            windows = np.arange(ends[0], ends[1] + 2)
        else:  # a small queue, or documents far apart: only the windows that take some of these ids
            places = np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist())])
            windows = np.unique(self.window_of(queue, places))
            windows = np.union1d(windows, windows + 1)
        ahead, sent = self.taken(queue, windows)
        cuts = np.unique(np.concatenate([a, b, sent[(sent > a[0]) & (sent < b[-1])]]))
        left, right = cuts[:-1], cuts[1:]
        doc = np.searchsorted(a, left, side="right") - 1
        inside = left < b[doc]
        left, right, doc = left[inside], right[inside], doc[inside]
        at = np.searchsorted(sent, left, side="right") - 1
        offset = (ahead[np.minimum(at + 1, len(ahead) - 1)] - ahead[at]) + left - sent[at]
        return order[doc], left - a[doc], right - left, windows[at], offset


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, queue=None) -> DataFrame:
    """(doc_id, queue, chunk, before, n, ids): ids as 16-bit little-endian strings; before: ids of its queue earlier in the chunk.

    A chunk is what one task reads; its number and order are fixed once the
    result is written.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(2, "little")

    def run(batches):
        coder, chunk, sent = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in in_parts(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names = batch.column("queue").to_pylist()
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= TEXT_CHARS):
                    chars += len(texts[b])
                    b += 1
                ids = [x + tail for x in coder.encode(texts[a:b])]
                before = []
                for name, x in zip(names[a:b], ids):
                    before.append(sent.get(name, 0))
                    sent[name] = before[-1] + len(x) // 2
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("queue"),
                        pa.array([chunk] * (b - a), pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array([len(x) // 2 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "queue", "chunk", "before", "n", "ids"],
                )
                a = b
        release_memory()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.lit(None) if queue is None else queue).cast("string").alias("queue"),
    )
    return rows.mapInArrow(run, "doc_id long, queue string, chunk long, before long, n long, ids binary")


def stored_ids(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, f"llm-{name}")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    size: int = WINDOW,
    end_id: int = END_ID,
    checksums: bool = False,
    targets: dict[str | None, float] | None = None,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, queue and ids.

    ids are 16-bit little-endian numbers, or with `checksums` ids_crc32, the
    checksum of the ids as unsigned 32-bit little-endian numbers.  Null and
    empty texts are one end id; a null source is a source; repeated rows are
    packed each.  Every source has a queue of its own.  `targets`: proportion
    of each source in a window while its queue lasts, in any unit; sources it
    does not name come after all others.  Without it the proportions are the
    sources' shares of all ids.  Other columns are ignored.
    """
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    ids = stored_ids(tokenized(docs, tokenizer or tokenizer_path(), end_id, source), "packing-ids")
    sums = ids.groupBy("queue", "chunk").agg(F.sum("n").alias("ids_n"))
    earlier = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("ids_n").over(earlier), F.lit(0))).drop("ids_n")
    totals = ids.groupBy("queue").agg(F.sum("n").alias("n")).toArrow().sort_by("queue")  # one row a source
    names = totals.column("queue")
    numbers = pa.table({"queue": names.cast(pa.string()), "number": pa.array(np.arange(len(names), dtype=np.int64))})
    base = base.join(short(docs.sparkSession.createDataFrame(numbers)), "queue")
    wanted = targets and {"null" if k is None else f"s{k}": v for k, v in targets.items()}
    shares = wanted and [wanted.get(name, 0) for name in names.to_pylist()]
    rounds = Rounds(totals.column("n").to_numpy(), size, shares)
    last = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def place(batches):
        for batch in batches:
            queues = batch.column("number").to_numpy()
            begin = (batch.column("base").to_numpy() + batch.column("before").to_numpy()).astype(np.int64)
            count, texts = batch.column("n").to_numpy(), batch.column("ids")
            for q in np.unique(queues):
                mine = np.flatnonzero(queues == q)
                doc, start, length, window, offset = rounds.pieces(int(q), begin[mine], count[mine])
                doc = mine[doc]
                body, held, raw = [], -1, b""
                for i, a, m in zip(doc.tolist(), start.tolist(), length.tolist()):
                    if i != held:
                        held, raw = i, texts[i].as_py()
                        wide = np.frombuffer(raw, dtype="<u2").astype("<u4") if checksums else None
                    body.append(zlib.crc32(wide[a : a + m]) if checksums else raw[2 * a : 2 * (a + m)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        *(pa.array(x, pa.int64()) for x in (start, length, count[doc], window, offset)),
                        batch.column("queue").take(pa.array(doc)),
                        pa.array(body, last[1]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "queue", last[0]],
                )
        release_memory()

    return ids.join(short(base), ["queue", "chunk"]).mapInArrow(
        place,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, queue string, "
        + ("ids_crc32 long" if checksums else "ids binary"),
    )


def op5_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"), checksums=True)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue")
