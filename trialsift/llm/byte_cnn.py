"""Quality classifier: a byte-level convolutional network in numpy (operator 10).

The UTF-8 bytes of the whole text pass as overlapping chunks.  Each byte is a
learned vector; learned filters over KERNEL bytes, placed every STRIDE bytes,
also see how often the bytes under them equal the byte 2 to LAGS + 1 places
before (repetition).  Filter outputs are max-pooled per chunk; the largest and
the mean over a document's chunks enter a small dense layer that gives one
probability.  Training (Adam on the log loss, fixed seed) runs in one task on a
bounded sample of SAMPLE labelled rows; every text is scored in Arrow batches.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trialsift.llm.common import release_memory, table, text_slices
from trialsift.llm.zstd_lang import held_out

KERNEL, STRIDE = 16, 8
#: Bytes of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1024, 64
EMBED, LAGS, FILTERS, HIDDEN = 6, 14, 24, 16
#: Labelled rows the network is fitted on, at most.
SAMPLE = 4000
EPOCHS, BATCH, RATE = 14, 32, 4e-3
#: A longer training text is represented by this many of its bytes, cut out in chunks all over it.
TRAIN_BYTES = 32 << 10
THRESHOLD = 0.3


def windows_of(data: np.ndarray, offsets: np.ndarray):
    """Filter positions of texts: (first byte of each, its chunk, chunk -> text); a text has one chunk at least.

    Positions cover each text whole: the last ones reach past its end, where the input is zero.
    """
    lengths = np.diff(offsets)
    step = CHUNK - OVERLAP
    chunks = np.maximum(1, -(-(lengths - OVERLAP) // step))
    owner = np.repeat(np.arange(len(lengths)), chunks)
    inside = (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * step
    size = np.clip(lengths[owner] - inside, 0, CHUNK)
    count = np.maximum(1, -(-size // STRIDE))
    chunk = np.repeat(np.arange(len(owner)), count)
    at = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return offsets[:-1][owner][chunk] + inside[chunk] + at, chunk, owner


def repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per lag, the running count of bytes equal to the byte `lag` before in the same text."""
    out = np.zeros((LAGS, len(data) + 1), dtype=np.int32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(LAGS):
        lag = k + 2
        same = np.zeros(len(data), dtype=bool)
        same[lag:] = data[lag:] == data[:-lag]
        same &= place >= lag
        np.cumsum(same, out=out[k, 1:])
    return out


class Network:
    """Parameters and passes; inputs are texts' bytes back to back with their offsets."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        width = KERNEL * EMBED + LAGS
        self.p = {
            "embed": draw.normal(0, 0.3, (257, EMBED)),  # the last row is the padding
            "filters": draw.normal(0, (2 / width) ** 0.5, (width, FILTERS)),
            "shift": np.zeros(FILTERS),
            "dense": draw.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
            "lift": np.zeros(HIDDEN),
            "last": draw.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "bias": np.full(1, 1.5),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["embed"][256] = 0

    def forward(self, data: np.ndarray, offsets: np.ndarray):
        at, chunk, owner = windows_of(data, offsets)
        ends = np.repeat(offsets[1:], np.diff(np.searchsorted(owner[chunk], np.arange(len(offsets)))))
        index = at[:, None] + np.arange(KERNEL)
        codes = np.append(data.astype(np.int16), 256)[np.minimum(index, len(data))]
        codes[index >= ends[:, None]] = 256
        cells = self.p["embed"][codes].reshape(len(at), -1)
        counts = repetition(data, offsets)
        stop = np.minimum(at + KERNEL, ends)
        again = ((counts[:, stop] - counts[:, np.minimum(at, stop)]).T / np.float32(KERNEL)).astype(np.float32)
        x = np.concatenate([cells, again], axis=1)
        z = x @ self.p["filters"] + self.p["shift"]
        starts = np.searchsorted(chunk, np.arange(len(owner)))
        top = np.maximum(np.maximum.reduceat(z, starts, axis=0), 0)
        first = np.searchsorted(owner, np.arange(len(offsets) - 1))
        per = np.diff(np.append(first, len(owner)))[:, None].astype(np.float32)
        features = np.concatenate([np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / per], axis=1)
        hidden = np.maximum(features @ self.p["dense"] + self.p["lift"], 0)
        logit = hidden @ self.p["last"] + self.p["bias"][0]
        return logit, (codes, x, z, chunk, starts, top, owner, first, per, features, hidden)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit, _ = self.forward(data, offsets)
        return 1.0 / (1.0 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))

    def gradients(self, data, offsets, target) -> dict[str, np.ndarray]:
        logit, (codes, x, z, chunk, starts, top, owner, first, per, features, hidden) = self.forward(data, offsets)
        p, g = self.p, {}
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) / len(target)).astype(np.float32)
        g["last"], g["bias"] = hidden.T @ d, np.array([d.sum()], dtype=np.float32)
        dh = np.outer(d, p["last"]) * (hidden > 0)
        g["dense"], g["lift"] = features.T @ dh, dh.sum(axis=0)
        df = dh @ p["dense"].T
        most, mean = df[:, :FILTERS], df[:, FILTERS:] / per
        best = top == features[owner, :FILTERS]  # chunks that tie share the gradient
        dtop = mean[owner] + most[owner] * best / np.add.reduceat(best.astype(np.float32), first, axis=0)[owner]
        # the filter position that gave a chunk its maximum takes the chunk's gradient
        f = np.arange(FILTERS)
        win = np.empty((len(starts), FILTERS), dtype=np.int64)
        stops = np.append(starts[1:], len(z))
        for c in range(len(starts)):
            win[c] = starts[c] + z[starts[c] : stops[c]].argmax(axis=0)
        dtop = dtop * (top > 0)
        rows, inverse = np.unique(win, return_inverse=True)
        dz = np.zeros((len(rows), FILTERS), dtype=np.float32)
        dz[inverse.reshape(win.shape), f] = dtop
        g["filters"], g["shift"] = x[rows].T @ dz, dz.sum(axis=0)
        dx = (dz @ p["filters"][: KERNEL * EMBED].T).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(codes[rows].ravel(), weights=dx[:, e], minlength=257) for e in range(EMBED)], axis=1)
        g["embed"][256] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v, dtype=np.float32) for k, v in self.p.items()}
        v = {k: np.zeros_like(x, dtype=np.float32) for k, x in self.p.items()}
        t, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                data = np.frombuffer(b"".join(texts[j] for j in pick), dtype=np.uint8)
                offsets = np.append(0, np.cumsum([len(texts[j]) for j in pick]))
                g = self.gradients(data, offsets, labels[pick])
                t += 1
                rate = RATE * 0.5 * (1 + np.cos(np.pi * t / (total + 1)))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Network:
        out = cls()
        with np.load(io.BytesIO(raw)) as found:
            out.p = {k: found[k] for k in found.files}
        return out


def _spread(raw: bytes) -> bytes:
    """A long training text cut down to chunks spread evenly over it."""
    if len(raw) <= TRAIN_BYTES:
        return raw
    begin = np.linspace(0, len(raw) - CHUNK, TRAIN_BYTES // CHUNK).astype(int)
    return b"".join(raw[b : b + CHUNK] for b in begin)


def train(labelled: DataFrame) -> bytes:
    """Weights fitted on at most SAMPLE rows of (doc_id, text, label), drawn by a hash of the id.

    Rows without a label are left out.  Without any row the untrained network is returned.
    """
    sample = (
        labelled.where("label IS NOT NULL AND doc_id IS NOT NULL")
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", F.xxhash64("text"))
        .limit(SAMPLE)
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        texts = [_spread(x.encode()) for x in frame["text"]]
        return pd.DataFrame({"weights": [Network().fit(texts, frame["label"].to_numpy(np.float32)).dumps()]})

    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "weights binary").collect()
    return bytes(found[0][0]) if found else Network().dumps()


def with_scores(docs: DataFrame, weights: bytes) -> DataFrame:
    """`docs` with score, the probability of label 1; a null text is scored as an empty one."""
    schema = StructType(docs.schema.fields[:]).add("score", "double")

    def score(batches):
        net = Network.loads(weights)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, end, data, offsets in text_slices(batch.column("text"), 256 << 10):
                out[row:end] = _long_score(net, data) if end - row == 1 and len(data) > (1 << 20) else net.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])
        release_memory()

    return docs.mapInArrow(score, schema)


def _long_score(net: Network, data: np.ndarray) -> float:
    """Score of one very long text in bounded memory: its chunks are pooled part by part.

    Repetition is not counted over the border of two parts, a few bytes in 250,000.
    """
    step, most, total, chunks = CHUNK - OVERLAP, None, 0, 0
    parts = max(1, -(-(len(data) - OVERLAP) // step))
    for c in range(0, parts, 256):
        begin, stop = c * step, min(len(data), (min(c + 256, parts) - 1) * step + CHUNK)
        _, kept = net.forward(data[begin:stop], np.array([0, stop - begin]))
        top = kept[5]
        most = top.max(axis=0) if most is None else np.maximum(most, top.max(axis=0))
        total, chunks = total + top.sum(axis=0), chunks + len(top)
    hidden = np.maximum(np.concatenate([most, total / chunks]) @ net.p["dense"] + net.p["lift"], 0)
    logit = float(hidden @ net.p["last"] + net.p["bias"][0])
    return float(1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))))


def op10_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    taught = labels.where("label IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0").distinct()
    # The sample is drawn from the small table; only its rows meet the texts.
    taught = taught.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE)
    weights = train(docs.join(F.broadcast(taught), "doc_id"))
    scored = with_scores(docs, weights)
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
