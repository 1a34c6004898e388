"""N-gram Jaccard join by prefix trees (operator 3).

Sets of distinct word shingles are linked when ``100 * |A n B| >= 80 * |A u B|``.
The result is exact up to 64-bit hash collisions; no candidate is capped.

1. Every text becomes its set of 64-bit shingle hashes; equal sets form one
   class, and only classes go on.
2. A shingle held by one class alone can be in no intersection.  Shingles are
   dealt to buckets as packed arrays (each task's own repeats are counted
   before the shuffle), those of two or more classes return to their class.  A
   class of n shingles whose shared part is below ceil(0.8 n) links with
   nothing and leaves.
3. The remaining sets, ordered by hash, are sorted into runs with the same
   first shingle.  A prefix tree over each block of a run finds its links:
   a probe walks the tree once, sets that begin alike share the overlap found
   so far, and a subtree is left when the shingles remaining below it cannot
   reach the needed overlap.
4. Two linked sets share a shingle within their prefixes (the first
   ``r - ceil(0.8 n) + 1`` of the shared part).  Per prefix shingle its holders
   are paired with the holder that has least shingles of its own, and those
   pairs that step 3 has not joined yet are verified.  What then is still
   apart from such a holder is sent to each other component that holds one of
   its prefix shingles, if sizes and shared parts allow a link, and walks
   the prefix trees of that component's members.  Groups of near copies are
   thus joined by a linear number of pairs, and no pair is listed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialsift.llm.common import (
    Words,
    buckets_for,
    mix64,
    pack48,
    release_memory,
    short,
    splitmix,
    stored,
    table,
    text_slices,
    unpack48,
    windows_hash,
)
from trialsift.llm.links import components

NGRAM = 5
#: Jaccard threshold in hundredths.
PERCENT = 80
#: Bytes of text a task gathers before it sends its packed shingles.
FLUSH_BYTES = 4 << 20
#: Shingles that meet in a bucket, about.
PER_BUCKET = 1_000_000
#: Class ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Sets in one prefix tree; a run is cut into blocks of so many.
BLOCK = 256


def shingle_sets(texts: pa.Array, ngram: int = NGRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with a word; A-Z are lower-cased."""
    for row, end, data, offsets in text_slices(texts):
        words = Words(data, offsets, lower=True)
        grams = windows_hash(words.hashes, ngram)
        first = words.first.tolist()
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            if b - a >= ngram:
                yield row + i, _distinct(grams[a : b - ngram + 1])
            elif b > a:
                whole = windows_hash(words.hashes[a:b], b - a)
                yield row + i, mix64(whole + np.uint64(splitmix(b - a)))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def _fingerprint(grams: np.ndarray) -> int:
    value = splitmix((int(mix64(grams).sum(dtype=np.uint64)) + splitmix(len(grams))) % (1 << 64))
    return value - (1 << 64) if value >> 63 else value


def set_classes(docs: DataFrame, ngram: int = NGRAM, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, class): class is the fingerprint of the set, null for an empty set; `also`: long columns to hand on."""
    kept = ["doc_id", *also]

    def read(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            prints = np.zeros(batch.num_rows, dtype=np.int64)
            for row, grams in shingle_sets(batch.column("text"), ngram):
                n[row], prints[row] = len(grams), _fingerprint(grams)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(n), pa.array(prints, mask=n == 0)], names=[*kept, "n_shingles", "class"]
            )
        release_memory()

    return docs.select(*[F.col(c).cast("long") for c in kept], F.col("text").cast("string")).mapInArrow(
        read, "".join(f"{c} long, " for c in kept) + "n_shingles long, class long"
    )


def _pack_single(prints: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> bytes:
    head = np.array([len(prints)], dtype=np.int64).tobytes()
    return head + prints.tobytes() + counts.astype(np.int32).tobytes() + pack48(grams)


def _unpack_single(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    prints = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    counts = np.frombuffer(raw, dtype=np.int32, count=n, offset=8 + 8 * n)
    return np.repeat(prints, counts), unpack48(memoryview(raw)[8 + 12 * n :])


def _pack_sets(prints: np.ndarray, sizes: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> bytes:
    head = np.array([len(prints)], dtype=np.int64).tobytes()
    return head + prints.tobytes() + sizes.astype(np.int32).tobytes() + counts.astype(np.int32).tobytes() + grams.tobytes()


def _unpack_sets(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    at = 8
    prints = np.frombuffer(raw, dtype=np.int64, count=n, offset=at)
    sizes = np.frombuffer(raw, dtype=np.int32, count=n, offset=at + 8 * n)
    counts = np.frombuffer(raw, dtype=np.int32, count=n, offset=at + 12 * n)
    return prints, sizes, counts, np.frombuffer(raw, dtype=np.uint64, offset=at + 16 * n)


def _shift(buckets: int) -> int:
    """Bits below those that name the bucket; of more than 2**16 buckets some are among the 48 that are packed."""
    return min(48, 65 - buckets.bit_length())


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams >> np.uint64(_shift(buckets))).astype(np.int64) & (buckets - 1)


def _restored(packed: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Hashes of a bucket's packed ones: the packed bits and those that the bucket tells."""
    return packed | np.uint64(bucket << _shift(buckets))


def _known_bits(buckets: int) -> np.uint64:
    return np.uint64((buckets << _shift(buckets)) - 1)


def _flush(sets: list[np.ndarray], prints: list[int], buckets: int, shares: int):
    """Rows of one flush: shingles seen once here go to their bucket, the others are known to be shared."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.empty(len(ordered), dtype=bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(ordered)))
    repeated = np.empty(len(grams), dtype=bool)
    repeated[order] = np.repeat(times > 1, times)
    w_grams = ordered[begin[times > 1]]
    del order, ordered, new, begin, times
    ids = np.array(prints, dtype=np.int64)
    # singles, by bucket and then by set
    s_grams, s_owner = grams[~repeated], owner[~repeated]
    bucket = _bucket_of(s_grams, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        pick = order[cuts[b] : cuts[b + 1]]
        who, counts = np.unique(s_owner[pick], return_counts=True)
        yield "single", int(b), _pack_single(ids[who], counts, s_grams[pick])
    del s_grams, s_owner
    # one witness for each shingle of several sets
    bucket = _bucket_of(w_grams, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield "witness", int(b), pack48(w_grams[order[cuts[b] : cuts[b + 1]]])
    # the sets' known shared part, on its way to the class
    kept = grams[repeated] & _known_bits(buckets)  # the bits a bucket can restore
    yield from _to_classes(ids, np.array([len(s) for s in sets]), owner[repeated], kept, shares)


def _to_classes(ids, sizes, owner, grams, shares):
    part = ids.view(np.uint64) % np.uint64(shares)
    counts = np.bincount(owner, minlength=len(ids))
    stop = np.cumsum(counts)
    for p in np.unique(part):
        who = np.flatnonzero(part == p)
        spans = [grams[stop[i] - counts[i] : stop[i]] for i in who]
        yield "set", int(p), _pack_sets(ids[who], sizes[who], counts[who], np.concatenate(spans) if spans else grams[:0])


def shared_parts(docs: DataFrame, shingles: int, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(class, n, grams): classes at least ceil(percent * n) of whose shingles other classes hold too, hash-ordered."""
    buckets = buckets_for(shingles, PER_BUCKET)

    def send(batches):
        sets, prints, seen, held = [], [], set(), 0
        for batch in batches:
            for _, grams in shingle_sets(batch.column("text"), ngram):
                fp = _fingerprint(grams)
                if fp in seen:
                    continue
                seen.add(fp)
                sets.append(grams)
                prints.append(fp)
                held += len(grams)
                if held * 8 >= FLUSH_BYTES:
                    yield _rows(_flush(sets, prints, buckets, buckets))
                    sets, prints, seen, held = [], [], set(), 0
        if sets:
            yield _rows(_flush(sets, prints, buckets, buckets))
            sets = []
        release_memory()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        relayed = frame[frame["kind"] == "set"]
        singles = [_unpack_single(raw) for raw in frame.loc[frame["kind"] == "single", "payload"]]
        known = [unpack48(raw) for raw in frame.loc[frame["kind"] == "witness", "payload"]]
        out = list(zip(relayed["key"], relayed["payload"]))
        if singles:
            ids = np.concatenate([s[0] for s in singles])
            grams = np.concatenate([s[1] for s in singles])
            known = np.unique(np.concatenate(known)) if known else np.empty(0, dtype=np.uint64)
            order = np.lexsort((ids, grams))
            ids, grams = ids[order], grams[order]
            same_gram = grams[1:] == grams[:-1]
            other_class = same_gram & (ids[1:] != ids[:-1])
            repeat = np.append(False, same_gram & ~other_class)  # a class met in several flushes
            run = np.cumsum(np.append(True, ~same_gram)) - 1
            several = np.zeros(run[-1] + 1, dtype=bool)
            several[run[1:][other_class]] = True
            several |= _held(np.unique(grams), known)
            keep = several[run] & ~repeat
            ids, grams = ids[keep], grams[keep]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                who, counts = np.unique(ids, return_counts=True)
                whole = _restored(grams[order], int(frame["bucket"].iloc[0]), buckets)
                owner = np.repeat(np.arange(len(who)), counts)
                out += [(k, p) for _, k, p in _to_classes(who, np.zeros(len(who)), owner, whole, buckets)]
            del singles, ids, grams, order, same_gram, other_class, repeat, run
        release_memory()
        return pd.DataFrame(out, columns=["share", "payload"])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack_sets(raw) for raw in frame["payload"]]
        ids = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        grams = np.concatenate([p[3] for p in parts])
        heads = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        n_of = dict(zip(heads[sizes > 0].tolist(), sizes[sizes > 0].tolist()))
        order = np.lexsort((grams, ids))
        ids, grams = ids[order], grams[order]
        cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)) if len(ids) else [0]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part, n = _distinct(grams[a:b]), n_of[int(ids[a])]
            if len(part) * 100 >= percent * n:
                rows.append((int(ids[a]), n, part.tobytes()))
        del parts, ids, grams, order
        release_memory()
        return pd.DataFrame(rows, columns=["class", "n", "grams"])

    sent = docs.select(F.col("text").cast("string")).mapInArrow(send, "kind string, key long, payload binary")
    met = (
        # A part already known to be shared may pass through any bucket.
        sent.withColumn("bucket", F.col("key"))
        .groupBy("bucket")
        .applyInPandas(meet, "share long, payload binary")
    )
    return met.groupBy("share").applyInPandas(gather, "class long, n long, grams binary")


def _rows(rows) -> pa.RecordBatch:
    kinds, keys, payloads = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "key", "payload"]
    )


def _held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the sorted `values` are in the sorted `known`."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


class PrefixTree:
    """Path-compressed tree over ordered sets; a node holds the run of shingles its sets share from its depth on."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._build(sets, order, 0)

    def _build(self, sets, members, depth):
        # children of one level, found by their next shingle; members are in path order
        top = {"run": np.empty(0, dtype=np.uint64), "leaves": [], "children": [], "longest": 0}
        todo = [(top, members, depth)]
        while todo:
            node, members, depth = todo.pop()
            i = 0
            while i < len(members):
                first = sets[members[i]]
                if len(first) == depth:
                    node["leaves"].append(members[i])
                    i += 1
                    continue
                j = i + 1
                while j < len(members) and sets[members[j]][depth] == first[depth]:
                    j += 1
                last = sets[members[j - 1]]
                m = min(len(first), len(last))
                differ = np.flatnonzero(first[depth:m] != last[depth:m])
                stop = depth + int(differ[0]) if len(differ) else m
                child = {"run": first[depth:stop], "leaves": [], "children": [], "longest": max(len(sets[k]) for k in members[i:j])}
                node["children"].append(child)
                todo.append((child, members[i:j], stop))
                i = j
        return top

    def partners(self, probe: np.ndarray, need_of, least: int, skip) -> Iterator[int]:
        """Members whose overlap with `probe` reaches need_of(member); least: the smallest such need."""
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            run = node["run"]
            if len(run):
                overlap += int(_held(run, probe).sum())
                depth += len(run)
                left = len(probe) - int(np.searchsorted(probe, run[-1], side="right"))
            else:
                left = len(probe)
            for member in node["leaves"]:
                if not skip(member) and overlap >= need_of(member):
                    yield member
            if overlap + min(left, node["longest"] - depth if depth else left) >= least:
                todo += [(child, depth, overlap) for child in node["children"]]


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest overlap o of sets of n and m with 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def block_links(ids: list[int], sizes: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is linked within one block (a spanning forest of its links)."""
    tree, parent = PrefixTree(sets), list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    groups = 1  # components among the sets before i
    for i in range(1, len(ids)):
        least = needed(sizes[i], -(-percent * sizes[i] // 100), percent)
        mine = [find(i)]

        def skip(j, i=i, mine=mine):
            return j >= i or find(j) == mine[0]

        for j in tree.partners(sets[i], lambda j, i=i: needed(sizes[i], sizes[j], percent), least, skip):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                mine[0] = min(a, b)
                out.append((ids[i], ids[j]))
                groups -= 1
                if not groups:
                    break
        groups += 1
    return out


def _unpacked(batch) -> Iterator[tuple[int, int, np.ndarray]]:
    for c, n, g in zip(batch.column("class").to_pylist(), batch.column("n").to_pylist(), batch.column("grams").to_pylist()):
        yield c, n, np.frombuffer(g, dtype=np.uint64)


def _links_batch(links) -> pa.RecordBatch:
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def first_links(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links within blocks of sets that begin with the same shingle."""

    def walk(batches):
        run, key = [], None
        for batch in batches:
            for item in _unpacked(batch):
                if item[2][0] != key or len(run) == BLOCK:
                    if len(run) > 1 and (links := block_links(*map(list, zip(*run)), percent)):
                        yield _links_batch(links)
                    run, key = [], item[2][0]
                run.append(item)
        if len(run) > 1 and (links := block_links(*map(list, zip(*run)), percent)):
            yield _links_batch(links)
        run.clear()
        release_memory()

    tasks = max(2, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = parts.withColumn("start", F.substring("grams", 1, 8))
    # Range partitions cut a run of very many sets over several tasks.
    return (
        keyed.repartitionByRange(tasks, "start", "class").sortWithinPartitions("start", "class").drop("start").mapInArrow(walk, "a long, b long")
    )


def prefix_grams(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(gram, class, n, r, place): the prefix of each set's shared part of r shingles; place counts from 1."""

    def cut(batches):
        for batch in batches:
            grams, classes, sizes, shared, places = [], [], [], [], []
            for c, n, g in _unpacked(batch):
                p = len(g) - -(-percent * n // 100) + 1
                grams.append(g[:p])
                classes.append(np.full(p, c))
                sizes.append(np.full(p, n))
                shared.append(np.full(p, len(g)))
                places.append(np.arange(1, p + 1))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.concatenate(x).view(np.int64)) for x in (grams, classes)),
                        *(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, shared, places)),
                    ],
                    names=["gram", "class", "n", "r", "place"],
                )
        release_memory()

    return parts.mapInArrow(cut, "gram long, class long, n int, r int, place int")


def verified(pairs: DataFrame, parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The linked ones of `pairs` (a, b): the sets of one a's partners form prefix trees that a walks."""

    def probe(batches):
        held, block = None, []

        def done():
            a, n, g = held
            tree = PrefixTree([x[2] for x in block])
            least = needed(n, -(-percent * n // 100), percent)
            found = tree.partners(g, lambda j: needed(n, block[j][1], percent), least, lambda j: False)
            return [(a, block[j][0]) for j in found]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "n_a", "grams_a", "b", "n_b", "grams_b")]
            for a, n_a, g_a, b, n_b, g_b in zip(*columns):
                if held is None or held[0] != a or len(block) == BLOCK:
                    if block and (links := done()):
                        yield _links_batch(links)
                    held, block = (a, n_a, np.frombuffer(g_a, dtype=np.uint64)), []
                block.append((b, n_b, np.frombuffer(g_b, dtype=np.uint64)))
        if block and (links := done()):
            yield _links_batch(links)
        block.clear()
        release_memory()

    one = parts.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    two = parts.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").sortWithinPartitions("a").mapInArrow(probe, "a long, b long")


def _may_link(percent: int):
    """What two sets' sizes and shared parts must allow: the needed overlap fits into either shared part."""
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    return need <= F.least("r_a", "r_b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    return (
        pairs.join(ra, "a", "left")
        .join(rb, "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
        .drop("root_a", "root_b")
    )


def _only(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the classes `wanted` (class); a short list is broadcast, so that only those sets are shuffled."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return parts.join(wanted, "class", "left_semi")


def component_links(probes: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each probe (root, block, class, n, grams) and block of a component's members, one link if there is any.

    `members` has the same columns.  A block's members form one prefix tree that
    its probes walk; a probe stops at its first link, for all members are one component.
    """

    def walk(batches):
        key, block, tree = None, [], None
        for batch in batches:
            links = []
            columns = (batch.column(c).to_pylist() for c in ("root", "block", "probe", "class", "n", "grams"))
            for root, part, probe, c, n, raw in zip(*columns):
                if (root, part) != key:
                    key, block, tree = (root, part), [], None
                grams = np.frombuffer(raw, dtype=np.uint64)
                if not probe:
                    block.append((c, n, grams))
                    continue
                if not block:
                    continue
                tree = tree or PrefixTree([x[2] for x in block])
                least = needed(n, -(-percent * n // 100), percent)
                found = tree.partners(grams, lambda j, n=n: needed(n, block[j][1], percent), least, lambda j: False)
                links += [(c, block[j][0]) for j in [next(found, None)] if j is not None]
            if links:
                yield _links_batch(links)
        block, tree = [], None
        release_memory()

    rows = members.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))
    return rows.repartition("root", "block").sortWithinPartitions("root", "block", "probe").mapInArrow(walk, "a long, b long")


def class_links(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between classes whose components equal those of all links; `parts` is read several times."""
    prefixes = prefix_grams(parts, percent)
    links = stored(first_links(parts, percent), "first-links")
    # Each holder of a prefix shingle with the holder of least own shingles: most near copies link to that one.
    whole = F.col("r") / F.col("n") + F.pmod("class", F.lit(1 << 20)) / F.lit(1e13)
    both = F.col("n").cast("long") * (1 << 32) + F.col("r")
    heads = prefixes.groupBy("gram").agg(F.max_by("class", whole).alias("a"), F.max_by(both, whole).alias("both"))
    heads = heads.select("gram", "a", F.shiftright("both", 32).alias("n_a"), (F.col("both") % (1 << 32)).alias("r_a"))
    ends = prefixes.select("gram", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("r").alias("r_b"))
    stars = ends.join(heads, (ends["gram"] == heads["gram"]) & (F.col("a") != F.col("b")))
    stars = stored(stars.select("a", "b", _may_link(percent).alias("may")).distinct(), "star-pairs")
    roots = stored(components(links), "roots")
    apart = _apart(stars.where("may"), roots).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = stored(apart.distinct(), "stars-apart")
    paired = _only(parts, apart.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    links = links.unionByName(stored(verified(apart, paired, percent), "star-links"))
    roots = stored(components(links), "roots")
    # Holders that still are apart from such a head meet the other components that hold one of their shingles.
    open_ends = stored(_apart(stars, roots).select(F.col("b").alias("class")).distinct(), "open-ends")
    # Only shingles that an open end has in its prefix matter from here on.
    mine = stored(prefixes.join(short(open_ends), "class", "left_semi"), "open-prefixes")
    near = prefixes.join(short(mine.select("gram").distinct()), "gram", "left_semi")
    roots_of = roots.withColumnRenamed("node", "class")
    rooted = near.join(roots_of, "class", "left").withColumn("root", F.coalesce("root", "class"))
    held = rooted.groupBy("gram", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("r").alias("r_b"))
    mine = mine.join(roots_of, "class", "left").select(
        F.col("gram").alias("mine"), "class", "n", "r", "place", F.coalesce("root", "class").alias("own")
    )
    smallest = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))
    fits = (F.col("most") >= smallest) & (F.col("least") * percent <= F.col("n") * 100)
    need = F.ceil(F.lit(percent) * (F.col("n") + smallest) / F.lit(100 + percent))
    # Linked sets share `common` prefix shingles at least: one stands among all but the last common - 1 of a prefix.
    own_least = F.ceil(F.lit(percent) * F.col("n") / 100)
    common = F.greatest(need - F.greatest(own_least, F.ceil(F.lit(percent) * F.col("most") / 100)) + 1, F.lit(1))
    early = F.col("place") <= (F.col("r") - own_least + 1) - common + 1
    asked = mine.join(
        held, (F.col("mine") == F.col("gram")) & (F.col("own") != F.col("root")) & fits & (need <= F.least("r", "r_b")) & early
    )
    asked = stored(asked.select("class", "root").distinct(), "asked")
    # The asked components' members, in blocks; a probe visits every block of its components.
    wanted = asked.select("root").distinct()
    inside = roots.join(wanted, "root", "left_semi").select(F.col("node").alias("class"), "root")
    alone = wanted.join(roots, wanted["root"] == roots["node"], "left_anti").select(F.col("root").alias("class"), "root")
    inside = stored(inside.unionByName(alone), "asked-members")
    sizes = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sets = stored(_only(parts, inside.select("class").unionByName(asked.select("class")).distinct()), "asked-sets")
    members = inside.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    members = members.join(sets, "class").select("root", "block", "class", "n", "grams")
    probes = asked.join(sizes, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = probes.join(sets, "class").select("root", "block", "class", "n", "grams")
    return links.unionByName(stored(component_links(probes, members, percent), "rest-links"))


def _parts_and_roots(docs: DataFrame, classes: DataFrame, ngram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes' shared parts, and (node, root) of the classes that have a link."""
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    parts = stored(shared_parts(docs, int(total), ngram, percent), "shared-parts")
    return parts, components(class_links(parts, percent))


def partner_counts(parts: DataFrame, roots: DataFrame, copies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(class, linked): documents in the other classes that a class links with, by all links and not by the forest alone.

    Linked classes are in one component.  Every member walks the prefix trees
    of all blocks of its component and only counts, so no pair is listed.
    """

    def walk(batches):
        key, block, tree = None, [], None
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("root", "block", "probe", "class", "n", "grams", "copies"))
            for root, part, probe, c, n, raw, times in zip(*columns):
                if (root, part) != key:
                    key, block, tree = (root, part), [], None
                grams = np.frombuffer(raw, dtype=np.uint64)
                if not probe:
                    block.append((c, n, grams, times))
                    continue
                if not block:
                    continue
                tree = tree or PrefixTree([x[2] for x in block])
                least = needed(n, -(-percent * n // 100), percent)
                found = tree.partners(grams, lambda j, n=n: needed(n, block[j][1], percent), least, lambda j, c=c: block[j][0] == c)
                if linked := sum(block[j][3] for j in found):
                    out.append((c, linked))
            if out:
                classes, linked = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(linked, pa.int64())], names=["class", "linked"])
        block, tree = [], None
        release_memory()

    inside = stored(roots.withColumnRenamed("node", "class").join(copies, "class"), "component-classes")
    sizes = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sets = inside.join(sizes, "root").join(parts.select("class", "n", "grams"), "class")
    members = sets.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("probe", F.lit(False))
    probes = sets.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    rows = members.unionByName(probes).select("root", "block", "probe", "class", "n", "grams", "copies")
    found = rows.repartition("root", "block").sortWithinPartitions("root", "block", "probe").mapInArrow(walk, "class long, linked long")
    return found.groupBy("class").agg(F.sum("linked").alias("linked"))


def document_links(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_links) for every row of `docs` (doc_id, text): the other documents its text links with.

    Equal texts are linked.  Equal rows of one doc_id are one document, each
    row without an id is one.  A text without a word has no link.
    """
    classes = stored(set_classes(docs, ngram), "set-classes")
    parts, roots = _parts_and_roots(docs, classes, ngram, percent)
    rows = classes.where("class IS NOT NULL").groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    copies = rows.groupBy("class").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(1)).alias("copies"))
    copies = stored(copies, "class-copies")
    linked = copies.join(partner_counts(parts, roots, copies, percent), "class", "left")
    linked = linked.select("class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return classes.join(linked, "class", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable by links.  A null or
    wordless text has n_shingles 0 and stands alone; a text of fewer words
    than `ngram` is one shingle.  Repeated rows are equal sets and share a
    component; a row whose doc_id is null never names a component unless all
    its component's ids are null.  Other columns of `docs` are ignored.
    """
    classes = stored(set_classes(docs, ngram), "set-classes")
    members = classes.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    _, roots = _parts_and_roots(docs, classes, ngram, percent)
    rooted = members.join(roots, members["class"] == roots["node"], "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")
    )
    rooted = stored(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("class", "component_id")
    return classes.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _row_print(docs: DataFrame):
    """Hash of a row's columns; which of them are null is hashed too, because null values are skipped."""
    names = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[docs[c] for c in names], *[docs[c].isNull() for c in names])


def keep_one_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` from each component of near copies; rows without a word stand alone and stay.

    The row of the smallest doc_id stays, rows without an id come last; among rows of one doc_id the smallest row print
    decides, and of wholly equal rows one stays.  The decision is a row's, not a doc_id's: another text of the same doc_id
    is judged in its own component.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], _row_print(docs).alias("print"))
    classes = stored(set_classes(keyed, ngram, ("print",)), "set-classes")
    _, roots = _parts_and_roots(docs, classes, ngram, percent)
    rows = classes.where("class IS NOT NULL").groupBy("class", "doc_id", "print").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(rows, "class-rows")
    # null ids sort behind all others
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    rooted = rows.groupBy("class").agg(F.min(order).alias("first")).join(roots, F.col("class") == F.col("node"), "left")
    rooted = stored(rooted.select("class", "first", F.coalesce("root", "class").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    named = rooted.join(named, "root").select("class", "stays")
    lost = (F.col("print") != F.col("stays.print")) | ~F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
    marked = rows.join(named, "class").select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), lost.alias("_lost"), "times")
    marked = stored(marked.where("_lost OR times > 1").drop("times"), "near-copies")
    few = F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked
    found = docs.join(few, docs["doc_id"].cast("long").eqNullSafe(few["_doc"]) & (_row_print(docs) == few["_print"]), "left")
    alone = found.where("_lost IS NULL").select(*[docs[c] for c in docs.columns])
    if marked.where("NOT _lost").isEmpty():
        return alone
    # Equal rows of which one stays; first() combines them where they lie.
    again = found.where("NOT _lost").dropDuplicates(["_doc", "_print"]).select(*docs.columns)
    return alone.unionByName(again)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_links(table(spark, sf_dir, "documents"))
