"""Substring dedup by seed and extend (operator 8).

A word is removed when a window of 20 consecutive words covers it whose word
sequence also starts earlier: in a document of smaller doc_id, or earlier in
the same document.  Windows are judged on the input, not on what is left.

* **Seeds.** Winnowing: of the 16 five-word runs inside each 20-word window
  the one with the smallest hash is the window's anchor.  Equal windows have
  equal anchors, so any repeat of 20 words or more shares at least one.
* **Join.** Documents meet on their anchors: windows are dealt to buckets by
  the anchor's hash.  Around one anchor occurrence, the windows to its left
  and right that chose it form one run, sent as a start, a length and the
  windows' hashes.  What a task has seen earlier itself is settled before the
  shuffle, so a passage of very many documents costs one occurrence a task.
* **Extend.** In a bucket, each occurrence is extended both ways as far as its
  windows equal earlier ones; windows that are not the first of their kind are
  returned as word intervals.
* **Maximal repeats.** A document's intervals from all its anchors are united:
  touching extensions of neighbouring anchors become one maximal repeat.

Windows are compared by 56 hash bits within an anchor bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.common import Words, buckets_for, pack_low, release_memory, table, text_slices, unpack_low, windows_hash

WINDOW = 20
ANCHOR = 5
#: Windows a task gathers before it settles its own repeats and sends the rest.
FLUSH_WINDOWS = 500_000
PER_BUCKET = 1_250_000
HASH_BYTES = 7
_LAST = np.iinfo(np.int64).max


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchored_windows(texts: pa.Array, window: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: (row, start, window hash, anchor hash) of every window."""
    for row, _, data, offsets in text_slices(texts):
        words = Words(data, offsets, lower=False)
        whole = windows_hash(words.hashes, window)
        if not len(whole):
            continue
        anchors = _sliding_min(windows_hash(words.hashes, anchor), window - anchor + 1)
        counts = np.maximum(np.diff(words.first) - window + 1, 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts + words.first[:-1][rows]
        yield rows + row, starts, whole[at], anchors[at]


def later_ones(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at a smaller (doc, start)."""
    out = np.zeros(len(hashes), dtype=bool)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    several = np.append(same, False) | np.append(False, same)
    pick = order[several]
    if len(pick):
        pick = pick[np.lexsort((starts[pick], docs[pick], hashes[pick]))]
        new = np.append(True, hashes[pick][1:] != hashes[pick][:-1])
        head = pick[np.flatnonzero(new)[np.cumsum(new) - 1]]
        out[pick] = (docs[pick] != docs[head]) | (starts[pick] != starts[head])
    return out


def _runs(group: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs of consecutive starts within a group."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.append(True, (group[1:] != group[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


def _intervals(keys: tuple[np.ndarray, np.ndarray], group: np.ndarray, starts: np.ndarray, window: int):
    """(doc, print, packed word intervals) of flagged windows; group: one number per document, in order."""
    first, length = _runs(group, starts)
    spans = np.stack([starts[first], starts[first] + length - 1 + window], axis=1).astype(np.int32)
    who, at = np.unique(group[first], return_index=True)
    stops = np.append(at[1:], len(first))
    for g, a, b in zip(who.tolist(), at.tolist(), stops.tolist()):
        yield int(keys[0][g]), int(keys[1][g]), spans[a:b].tobytes()


def repeated_intervals(docs: DataFrame, windows: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, print, spans): word intervals that repeat earlier windows; several rows a document.

    `docs`: doc (long, a null id last), print (hash of the text), text.
    """
    buckets = buckets_for(windows, PER_BUCKET, least=32)

    def send(batches):
        held, n, base = [], 0, 0
        ids, prints = [], []

        def flush():
            docs_of, prints_of = np.concatenate(ids), np.concatenate(prints)
            row, start, whole, seed = (np.concatenate(x) for x in zip(*held))
            whole = whole & np.uint64((1 << 8 * HASH_BYTES) - 1)
            known = later_ones(whole, docs_of[row], start)
            settled = list(_intervals((docs_of, prints_of), row[known], start[known], window))
            rows = [("settled", p % buckets, d, p, s) for d, p, s in settled]
            bucket = (seed >> np.uint64(40)).astype(np.int64) & (buckets - 1)
            row, start, whole, bucket = row[~known], start[~known], whole[~known], bucket[~known]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                pick = order[cuts[b] : cuts[b + 1]]
                first, length = _runs(row[pick], start[pick])
                who, runs = np.unique(row[pick][first], return_counts=True)
                head = np.array([len(who), len(first)], dtype=np.int64)
                payload = b"".join(
                    (
                        head.tobytes(),
                        docs_of[who].tobytes(),
                        prints_of[who].tobytes(),
                        runs.astype(np.int32).tobytes(),
                        start[pick][first].astype(np.int32).tobytes(),
                        length.astype(np.int32).tobytes(),
                        pack_low(whole[pick], HASH_BYTES),
                    )
                )
                rows.append(("windows", int(b), 0, 0, payload))
            return _batch(rows)

        for batch in batches:
            ids.append(batch.column("doc").to_numpy(zero_copy_only=False))
            prints.append(batch.column("print").to_numpy(zero_copy_only=False))
            for row, start, whole, seed in anchored_windows(batch.column("text"), window, anchor):
                held.append((row + base, start, whole, seed))
                n += len(start)
                if n >= FLUSH_WINDOWS:
                    yield flush()
                    held, n = [], 0
            if held:
                base += batch.num_rows
            else:
                ids, prints, base = [], [], 0
        if held:
            yield flush()
            held = []
        release_memory()

    def extend(frame: pd.DataFrame) -> pd.DataFrame:
        settled = frame[frame["kind"] == "settled"]
        out = list(zip(settled["doc"], settled["print"], settled["payload"]))
        parts = [_windows_of(raw) for raw in frame.loc[frame["kind"] == "windows", "payload"]]
        if parts:
            doc, mark, start, whole = (np.concatenate(x) for x in zip(*parts))
            known = later_ones(whole, doc, start)
            doc, mark, start = doc[known], mark[known], start[known]
            if len(doc):
                order = np.lexsort((start, mark, doc))
                doc, mark, start = doc[order], mark[order], start[order]
                fresh = np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1]))
                doc, mark, start = doc[fresh], mark[fresh], start[fresh]
                new = np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))
                group = np.cumsum(new) - 1
                out += _intervals((doc[new], mark[new]), group, start, window)
            del parts, doc, mark, start, whole
        release_memory()
        return pd.DataFrame(out, columns=["doc", "print", "spans"])

    return (
        docs.mapInArrow(send, "kind string, bucket long, doc long, print long, payload binary")
        .groupBy("bucket")
        .applyInPandas(extend, "doc long, print long, spans binary")
    )


def _batch(rows) -> pa.RecordBatch:
    kind, bucket, doc, mark, payload = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), *(pa.array(x, pa.int64()) for x in (bucket, doc, mark)), pa.array(payload, pa.binary())],
        names=["kind", "bucket", "doc", "print", "payload"],
    )


def _windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, runs = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
    at = 16
    ids = np.frombuffer(raw, dtype=np.int64, count=docs, offset=at)
    prints = np.frombuffer(raw, dtype=np.int64, count=docs, offset=at + 8 * docs)
    counts = np.frombuffer(raw, dtype=np.int32, count=docs, offset=at + 16 * docs)
    at += 20 * docs
    first = np.frombuffer(raw, dtype=np.int32, count=runs, offset=at)
    length = np.frombuffer(raw, dtype=np.int32, count=runs, offset=at + 4 * runs).astype(np.int64)
    whole = unpack_low(memoryview(raw)[at + 8 * runs :], HASH_BYTES)
    windows = np.add.reduceat(length, np.cumsum(counts) - counts) if docs else np.empty(0, dtype=np.int64)
    start = np.repeat(first.astype(np.int64) - (np.cumsum(length) - length), length) + np.arange(len(whole))
    return np.repeat(ids, windows), np.repeat(prints, windows), start, whole


def _covered(parts: list[bytes], n: int) -> np.ndarray:
    """Words of a text of n words that the packed intervals cover."""
    spans = np.frombuffer(b"".join(parts), dtype=np.int32).reshape(-1, 2)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def with_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`docs` with `_spans`: arrays of packed word intervals to remove, null where there are none.

    Rows are matched by doc_id and text, so repeated rows get the same
    answer.  Rows of one doc_id count as one document, rows without an id as
    one that comes after all others.
    """
    keyed = docs.withColumns(
        {"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))), "_print": F.xxhash64("text")}
    )
    words = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = keyed.select(F.col("_doc").alias("doc"), F.col("_print").alias("print"), F.col("text").cast("string"))
    found = (
        repeated_intervals(source, words // 6, window, anchor)
        .groupBy(F.col("doc").alias("_doc"), F.col("print").alias("_print"))
        .agg(F.collect_list("spans").alias("_spans"))
    )
    return keyed.join(found, ["_doc", "_print"], "left").drop("_doc", "_print")


def removal_digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; a null text has no words."""

    def digest(batches):
        for batch in batches:
            words_n, removed, digests = [], [], []
            texts = batch.column("text").cast(pa.binary())
            for text, spans in zip(texts, batch.column("_spans").to_pylist()):
                words = (text.as_py() or b"").split()
                gone = 0
                if spans:
                    cover = _covered(spans, len(words))
                    gone = int(cover.sum())
                    kept = [w for w, c in zip(words, cover.tolist()) if not c]
                else:
                    kept = words
                words_n.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = with_repeats(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), window, anchor)
    return found.select("doc_id", "text", "_spans").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of `docs` with their repeats cut out of `text`; a text that loses its last word goes.

    Kept words keep the separators between them; what stood around a cut is
    joined by a line end.  A text without repeats stays as it is, byte by byte.
    All other columns stay; a column n_chars is counted anew.
    """
    fields = docs.schema.fields
    if any(f.name in ("_spans", "_doc", "_print") for f in fields):
        raise ValueError("_spans, _doc and _print are names of this operator")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, parts in zip(texts, spans):
            if parts is None:
                out.append(None)
                continue
            raw = text.encode()
            words = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), lower=False)
            cover = _covered(list(parts), len(words.starts))
            stay = np.flatnonzero(~cover)
            first, length = _runs(np.zeros(len(stay)), stay)
            ends = stay[first + length - 1] if len(stay) else stay
            begins = stay[first] if len(stay) else stay
            pieces = [raw[words.starts[a] : words.ends[b]] for a, b in zip(begins.tolist(), ends.tolist())]
            out.append(b"\n".join(pieces).decode() if pieces else None)
        return pd.Series(out, dtype=object)

    found = with_repeats(docs, window, anchor)
    # Only texts with repeats travel to Python.
    repeated = F.when(F.col("_spans").isNotNull(), F.col("text"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut(repeated, "_spans"))
    out = found.withColumn("_kept", text).where("_spans IS NULL OR _kept IS NOT NULL")
    columns = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("_kept").cast(kind))
    return out.withColumns(columns).select(*docs.columns)


def op8_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))
