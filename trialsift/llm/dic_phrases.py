"""Phrase collocations by dynamic itemset counting (operator 12).

The corpus is dealt to SHARDS shards that are scanned one after another, round and
round.  Words are counted from the start.  A longer phrase is active from the scan after
that in which both its subphrases (without its last, without its first word) reached LEAST,
and it is counted for one full cycle, wherever that begins; so phrases of all
lengths are counted in the same scans.  The scans end when no phrase is active.

* A scan's counts are added up inside each task and written in packs: a row holds the phrases of one lang, length,
  beginning and bucket (of the phrase's hash).  When a cycle ends, the scans' packs that began with it meet by bucket
  in one exchange and are added up, and phrases below LEAST are left behind.
* A phrase opens longer ones as soon as one task alone has counted it LEAST times in a scan, else when
  its cycle ends with LEAST in all; so what is common is followed up at once, and nothing is missed.
* Tasks learn which phrases have opened, and when, from a filter of SLOTS places (a
  Bloom filter that holds step numbers), whose bits Spark's bitmap aggregates collect: SLOTS / 8
  bytes a step at most, whatever the corpus.  A place shared with another phrase can only
  make a phrase active earlier, so every count stays whole; the more frequent phrases there are than
  SLOTS / 10, the fewer phrases it holds back.
* A text is cut in windows of about WINDOW bytes; two words are read again where a text is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import buckets_for, mix64, release_memory, scratch_path, stored, table

SHARDS = 3
LEAST = 10
LONGEST = 3
TOP = 2000
#: Places of the filter, a power of two; its hashes are folded out of the chained xxhash64 of (lang, word).
SLOTS = 1 << 24
PROBES = 3
#: Bytes of text cut at once, and distinct phrases that a task holds before it passes them on.
WINDOW = 1 << 21
HELD = 1_000_000
#: Parts in which each lang's best are sought before they meet.
PARTS = 64

NEVER = 255
_SEED = 42
#: total: of the pack's counts; often: its phrases that this task alone has counted often enough
_COUNTED = "lang string, words tinyint, since tinyint, bucket int, total long, often array<string>, pack binary"
_FOUND = "lang string, phrase string, words tinyint, f long"
#: Distinct phrases of a task, about, that meet in a bucket; a corpus has one for each BYTES_EACH bytes at most, about.
PER_BUCKET = 1_000_000
BYTES_EACH = 12

_GAP, _BREAK = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = _GAP
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Reached:
    """The step from which each phrase counts as frequent, at the latest; NEVER for most that are not.

    A phrase's hash is folded out of its words' hashes, so only words are hashed as text.
    """

    def __init__(self, steps: np.ndarray, lang: str):
        self.steps = steps
        self.seed = xxhash.xxh64_intdigest(lang.encode(), seed=_SEED)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        seed, digest = self.seed, xxhash.xxh64_intdigest
        return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))

    @staticmethod
    def longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of phrases with one word more."""
        return (hashes << np.uint64(1) | hashes >> np.uint64(63)) ^ last

    def __call__(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.steps) - 1)
        first, stride = h & mask, (h >> np.uint64(32)) & mask | np.uint64(1)
        found = self.steps[first]
        for i in range(1, PROBES):
            found = np.maximum(found, self.steps[(first + np.uint64(i) * stride) & mask])
        return found


def _bits(phrases: DataFrame, slots: int) -> dict[int, bytes]:
    """Bitmaps, 32,768 places each, of the filter places of (lang, phrase)."""

    def longer(h, last):
        return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63)).bitwiseXOR(last)

    words = F.transform(F.split("phrase", " "), lambda w: F.xxhash64("lang", w))
    hashed = phrases.select(F.aggregate(words, F.lit(0).cast("long"), longer).alias("h"))
    h = F.col("h")
    first, stride = h.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(slots - 1)).bitwiseOR(F.lit(1))
    # Spark's bitmaps number what they hold from 1
    places = F.array(*((first + i * stride).bitwiseAND(F.lit(slots - 1)) + 1 for i in range(PROBES)))
    at = hashed.select(F.explode(places).alias("at"))
    held = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return {r["k"]: bytes(r["bits"]) for r in held.collect()}


def _mark(steps: np.ndarray, bits: dict[int, bytes], step: int) -> None:
    """Set the step of places that are marked now and were not before."""
    for k, raw in bits.items():
        here = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little").astype(bool)
        low = (k - 1) << 15
        part = steps[low : low + (1 << 15)]
        part[here[: len(part)] & (part == NEVER)] = step


class _Cut:
    """Words of a window: their bytes with one space after each, where each begins, and where pieces begin."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[data]
        word = kind == 0
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        end = ~word
        end[0] = False
        end[1:] &= word[:-1]
        self.starts = np.flatnonzero(begin)
        breaks = np.cumsum(kind == _BREAK)[self.starts]
        self.new = np.ones(len(self.starts), dtype=bool)
        self.new[1:] = breaks[1:] != breaks[:-1]
        text = _LOWER[data]
        text[end] = 32
        self.text = text[word | end].tobytes()
        sizes = np.flatnonzero(end) - self.starts
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])


def _windows(texts: list[bytes]) -> Iterator[tuple[_Cut, int]]:
    """(words, how many of the first were counted before) of runs of whole texts, and of parts of longer ones."""
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) <= WINDOW):
            size += len(texts[end])
            end += 1
        if size <= WINDOW:
            yield _Cut(b"\n".join(texts[row:end]) + b"\n"), 0
        else:
            yield from _parts(texts[row])
        row = end


def _parts(text: bytes) -> Iterator[tuple[_Cut, int]]:
    begin, reach, seen = 0, WINDOW, 0
    while begin < len(text):
        stop = begin + reach
        if stop < len(text):
            data = np.frombuffer(text, dtype=np.uint8)[begin:stop]
            gaps = np.flatnonzero(_KIND[data])
            cut = _Cut(data[: gaps[-1] + 1].tobytes()) if len(gaps) else None
            if cut is None or len(cut.starts) <= LONGEST - 1 + seen:
                reach *= 2
                continue
            yield cut, seen
            seen = LONGEST - 1
            begin, reach = begin + int(cut.starts[-seen]), WINDOW
        else:
            yield _Cut(text[begin:] + b"\n"), seen
            return


def _spans(cut: _Cut, k: int, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(first words, phrases with a space at the end) of the wanted runs of k words; every k-th run lies end to end."""
    raw = pa.py_buffer(cut.text)
    for phase in range(min(k, len(wanted))):
        firsts = np.arange(phase, len(wanted), k)
        edges = np.append(cut.at[firsts], cut.at[firsts[-1] + k])
        runs = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(edges), raw])
        keep = wanted[firsts]
        yield firsts[keep], runs.filter(pa.array(keep))


def _packed(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """Phrases (large_binary) with their counts."""
    _, edges, raw = phrases.buffers()
    n = len(phrases)
    edges = np.frombuffer(edges, dtype=np.int64)[phrases.offset : phrases.offset + n + 1]
    sizes = np.diff(edges).astype(np.int32)
    return b"".join((n.to_bytes(8, "little"), counts.tobytes(), sizes.tobytes(), memoryview(raw)[edges[0] : edges[-1]]))


def _added_up(packs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of all packs and the sums of their counts."""
    counts, sizes, texts = [], [], []
    for raw in packs:
        n = int.from_bytes(raw[:8], "little")
        counts.append(np.frombuffer(raw, dtype=np.int64, count=n, offset=8))
        sizes.append(np.frombuffer(raw, dtype=np.int32, count=n, offset=8 + 8 * n))
        texts.append(memoryview(raw)[8 + 12 * n :])
    edges = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    buffers = [None, pa.py_buffer(edges), pa.py_buffer(b"".join(texts))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, buffers).dictionary_encode()
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    return coded.dictionary, np.bincount(at, weights=np.concatenate(counts), minlength=n).astype(np.int64)


def _texts(phrases: pa.Array) -> pa.Array:
    """Phrases without the space at their end."""
    return pc.binary_slice(phrases.cast(pa.binary()), 0, -1).cast(pa.string())


class _Tally:
    """Counts of a task until they are passed on."""

    def __init__(self, least: int, buckets: int):
        self.least, self.buckets = least, buckets
        self.parts: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, k: int, phrases: pa.Array, counts: np.ndarray, since: np.ndarray, hashes: np.ndarray) -> None:
        """Distinct phrases with their counts; those of 0 are left out."""
        some = counts > 0
        if not some.all():
            phrases, counts, since, hashes = phrases.filter(pa.array(some)), counts[some], since[some], hashes[some]
        self.parts.setdefault((lang, k), []).append((phrases, counts, since, hashes))
        self.size += len(counts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, k), parts in self.parts.items():
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            at, n = coded.indices.to_numpy(), len(coded.dictionary)
            if not n:
                continue
            counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=n).astype(np.int64)
            # a phrase's beginning and hash are the same wherever it was met
            since, hashes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64)
            since[at] = np.concatenate([p[2] for p in parts])
            hashes[at] = np.concatenate([p[3] for p in parts])
            key = since * self.buckets + (mix64(hashes) >> np.uint64(40)).astype(np.int64) % self.buckets
            order = np.argsort(key, kind="stable")
            key, counts, phrases = key[order], counts[order], coded.dictionary.take(pa.array(order))
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), n)
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                often = []
                if k < LONGEST and (many := counts[a:b] >= self.least).any():
                    often = _texts(phrases[a:b].filter(pa.array(many))).to_pylist()
                begun, bucket = divmod(int(key[a]), self.buckets)
                rows.append((lang, k, begun, bucket, int(counts[a:b].sum()), often, _packed(phrases[a:b], counts[a:b])))
            types = (pa.string(), pa.int8(), pa.int8(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary())
            names = ["lang", "words", "since", "bucket", "total", "often", "pack"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        self.parts, self.size = {}, 0


def _count(cut: _Cut, seen: int, lang: str, reached: Reached, step: int, shards: int, tally: _Tally) -> None:
    """Add the window's runs of words that are active in this step."""
    n = len(cut.starts)
    if not n:
        return
    coded = next(_spans(cut, 1, np.ones(n, dtype=bool)))[1].dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    own = reached.hashes([p[:-1] for p in words.to_pylist()])
    if step < shards:
        counts = np.bincount(at[seen:], minlength=len(words))
        tally.add(lang, 1, words, counts, np.zeros(len(words), dtype=np.int8), own)
    if not step:
        return
    # since[i]: the step from which the run of k - 1 words at i is frequent; hashes[i]: its hash
    since, own = reached(own)[at], own[at]
    hashes = own
    joined = ~cut.new
    for k in range(2, LONGEST + 1):
        if len(since) < 2:
            return
        # a run of k words: the two runs of k - 1 words in it, within one piece
        whole = joined[1 : len(since)].copy()
        for j in range(2, k):
            whole &= joined[j : len(since) + j - 1]
        active = np.maximum(since[:-1], since[1:])
        open_ = whole & (active <= step)
        counted = open_ & (active.astype(np.int64) + shards > step) & (np.arange(len(open_)) + k > seen)
        # runs that may be part of a longer one; none is frequent before step k
        looked_up = np.zeros(len(open_), dtype=bool)
        if k < LONGEST and step >= k:
            both = open_[:-1] & open_[1:] & joined[k : k + len(open_) - 1]
            looked_up[:-1] |= both
            looked_up[1:] |= both
        later = np.full(len(open_), NEVER, dtype=np.uint8)
        hashes = reached.longer(hashes[:-1], own[k - 1 :])
        later[looked_up] = reached(hashes[looked_up])
        for firsts, runs in _spans(cut, k, counted):
            if len(firsts):
                coded = runs.dictionary_encode()
                at, phrases = coded.indices.to_numpy(), coded.dictionary
                begun = np.zeros(len(phrases), dtype=np.int8)
                begun[at] = active[firsts]
                marks = np.zeros(len(phrases), dtype=np.uint64)
                marks[at] = hashes[firsts]
                tally.add(lang, k, phrases, np.bincount(at, minlength=len(phrases)), begun, marks)
        since = later


def _scan(shard: DataFrame, sent, step: int, shards: int, least: int, buckets: int) -> DataFrame:
    """Packs of one shard's counts; a phrase is in several, one a task at least."""

    def scan(batches):
        steps = np.frombuffer(zlib.decompress(sent.value), dtype=np.uint8)
        tally = _Tally(least, buckets)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                mine = pa.array([x == lang for x in langs])
                texts = batch.column("text").cast(pa.large_binary()).filter(mine).to_pylist()
                reached = Reached(steps, lang)
                for cut, seen in _windows(texts):
                    _count(cut, seen, lang, reached, step, shards, tally)
                    if tally.size > HELD:
                        yield from tally.flush()
        yield from tally.flush()
        release_memory()

    return shard.mapInArrow(scan, _COUNTED)


def _whole(packs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases whose counts in all packs come to `least`."""

    def add_up(frame: pd.DataFrame) -> pd.DataFrame:
        phrases, f = _added_up(frame["pack"].tolist())
        keep = f >= least
        found = _texts(phrases.filter(pa.array(keep))).to_pylist()
        names = [frame["lang"].iloc[0]] * len(found)
        out = pd.DataFrame({"lang": pd.Series(names, dtype=object), "phrase": pd.Series(found, dtype=object)})
        out["words"], out["f"] = frame["words"].iloc[0], f[keep]
        if len(f) > 100_000:
            del phrases, f, keep, found, names
            release_memory()
        return out

    return packs.groupBy("lang", "words", "bucket").applyInPandas(add_up, _FOUND)


def frequent_phrases(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of phrases of up to LONGEST words with f >= least, and (lang, n): all words.

    `docs`: text, lang and doc_id, by which rows are dealt to shards; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "llm-dic-shards")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    dealt = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int")
    size = Observation()
    texts = docs.where(F.length("text") > 0).select(lang.alias("lang"), "text", dealt.alias("shard"))
    texts.observe(size, F.sum(F.octet_length("text")).alias("bytes")).write.partitionBy("shard").parquet(path)
    buckets = buckets_for((size.get["bytes"] or 0) // BYTES_EACH, PER_BUCKET, least=16)
    corpus = spark.read.schema("lang string, text string, shard int").parquet(path)
    steps = np.full(slots, NEVER, dtype=np.uint8)
    scans: list[DataFrame] = []
    done: list[DataFrame] = []
    step, last = 0, shards  # scans are needed while a phrase may be active
    while step < last:
        sent = spark.sparkContext.broadcast(zlib.compress(steps.tobytes(), 1))
        scans.append(stored(_scan(corpus.where(F.col("shard") == step % shards).drop("shard"), sent, step, shards, least, buckets), f"dic-scan-{step}"))
        sent.destroy()  # the step is written
        # what one task alone has met often enough
        fresh = scans[-1].where(F.size("often") > 0).select("lang", F.explode("often").alias("phrase"))
        begun = step + 1 - shards
        if begun >= 0:  # the cycle of what became active in that step ends
            cycle = scans[begun]
            for s in scans[begun + 1 :]:
                cycle = cycle.unionByName(s)
            cycle = cycle.where(F.col("since") == begun).select("lang", "words", "bucket", "pack")
            done.append(stored(_whole(cycle, least), f"dic-cycle-{begun}"))
            fresh = fresh.unionByName(done[-1].where(F.col("words") < LONGEST).select("lang", "phrase"))
        bits = _bits(fresh, slots)
        if bits:
            # a phrase is marked again at its cycle's end; what is marked keeps its step
            before = np.count_nonzero(steps != NEVER)
            _mark(steps, bits, step + 1)
            if np.count_nonzero(steps != NEVER) > before:
                last = max(last, step + 1 + shards)
        step += 1
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    words = scans[0]
    for s in scans[1:shards]:
        words = words.unionByName(s)
    totals = words.where(F.col("words") == 1).groupBy("lang").agg(F.sum("total").alias("n"))
    return stored(found, "dic-frequent"), stored(totals, "dic-totals")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases.

    `docs`: text, lang, doc_id; other columns are not read.  Null and empty texts have no words; a null lang
    is `und`; repeated rows count each; doc_id may be null.  A lang without a phrase of
    `least` occurrences has no rows, and so has an empty table.  Of equally low cuts the earlier counts.
    """
    found, totals = frequent_phrases(docs, least, shards)
    words = F.split("phrase", " ")
    cut = found.where(F.col("words") > 1).select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)).alias("k"),
        "words",
        words.alias("w"),
    )
    cut = cut.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    parts = found.select("lang", F.col("phrase").alias("part"), "f")
    cut = cut.join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
    cut = cut.join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    cut = cut.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * exact["a"] * exact["a"]).withColumn("down", exact["l"] * exact["r"])
    cut = cut.withColumn("score", F.expr("up div down"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("m")).select("lang", "phrase", "m.*")
    # what a longer candidate covers: its runs of one word less (those of three words hold all of two)
    whole = found.where(F.col("words") > 2).select(
        "lang",
        "f",
        F.explode(
            F.array(
                F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " ")
            )
        ).alias("phrase"),
    )
    whole = whole.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(whole, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(50) * F.col("a"))
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    kept = kept.where(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = kept.where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_dic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
