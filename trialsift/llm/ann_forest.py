"""Approximate nearest neighbours by a hash-prefix forest (operator 1).

Each of TREES trees gives every vector a long hash string (BITS signs of
random projections of its own).  A tree is kept as sorted arrays of these
strings, each over a range of prefixes.  A query descends to the stretch that
shares its longest prefix in every tree and then ascends all trees together,
one bit at a time, until their stretches hold enough candidates in total.  The
candidates are scored by exact cosine; an array returns a query's best few.

* How far to ascend is read from the trees' counts by their first COUNTED bits
  (at most TREES * 2**COUNTED numbers, whatever the table's size).  Where so
  short a prefix already holds enough, the stretch is narrowed inside the
  sorted array, bit by bit, as long as it still holds the array's part.
* A query collects SHARE of all distinct vectors over all trees together (a
  vector met in several trees counts in each), LEAST at least.  Vectors without
  neighbours worth the name need a large share for a recall of 0.9; the share
  is a parameter.
* Equal vectors are one entry that carries its RANKS + 1 smallest ids: no other
  copy can come into the first RANKS.  Every row is indexed through its entry.
* Arrays hold about ARRAY entries.  A prefix with more entries (very many
  alike vectors) is dealt to several arrays by a hash, all of which are searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import stored, table

TREES = 20
BITS = 48
COUNTED = 12
RANKS = 5
LEAST = 2000
SHARE = 1.0
ARRAY = 4096
SEED = 97


def projections(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, trees * bits))


def hash_strings(vectors: np.ndarray, planes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One long per tree and vector; the first bit of the string is the highest of `bits`."""
    signs = (vectors @ planes > 0).reshape(len(vectors), -1, bits)
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, finite components, not all zero, of the table's usual dimension."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def entries_of(rows: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(v, ids): distinct vectors with their ranks + 1 smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= ranks + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Shape:
    """Where the trees are dense: counts by prefix, and the arrays that prefixes are dealt to."""

    def __init__(self, counts: dict[tuple[int, int], int], trees: int, entries: int):
        self.trees = trees
        width = 1 << COUNTED
        table_ = np.zeros((trees, width), dtype=np.int64)
        for (tree, prefix), n in counts.items():
            table_[tree, prefix] = n
        self.sums = np.concatenate([np.zeros((trees, 1), dtype=np.int64), np.cumsum(table_, axis=1)], axis=1)
        # neighbouring prefixes share an array until it is full; a fuller prefix has arrays of its own
        self.first = np.zeros((trees, width), dtype=np.int64)
        self.parts = np.ones((trees, width), dtype=np.int64)
        number = -1
        for tree in range(trees):
            held = ARRAY
            for prefix in range(width):
                n = int(table_[tree, prefix])
                if n > ARRAY:
                    self.parts[tree, prefix] = -(-n // ARRAY)
                    self.first[tree, prefix] = number + 1
                    number += int(self.parts[tree, prefix])
                    held = ARRAY
                    continue
                if held + n > ARRAY or prefix == 0:
                    number, held = number + 1, 0
                held += n
                self.first[tree, prefix] = number
        self.arrays = number + 1

    def level(self, strings: np.ndarray, needed: int) -> int:
        """Longest prefix, up to COUNTED bits, at which the trees' stretches together hold `needed` entries."""
        prefix = strings >> (BITS - COUNTED)
        tree = np.arange(self.trees)
        for bits in range(COUNTED, 0, -1):
            low = prefix >> (COUNTED - bits) << (COUNTED - bits)
            if (self.sums[tree, low + (1 << COUNTED - bits)] - self.sums[tree, low]).sum() >= needed:
                return bits
        return 0

    def arrays_of(self, tree: int, string: int, bits: int) -> np.ndarray:
        """Arrays that hold the stretch of `string`'s first `bits` bits; prefixes without entries add none."""
        low = string >> (BITS - COUNTED) >> (COUNTED - bits) << (COUNTED - bits)
        high = low + (1 << COUNTED - bits)
        some = np.flatnonzero(np.diff(self.sums[tree, low : high + 1])) + low
        first, parts = self.first[tree, some], self.parts[tree, some]
        return np.unique(np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))


def neighbours(
    vectors: DataFrame, queries, ranks: int = RANKS, trees: int = TREES, share: float = SHARE, least: int = LEAST
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found to every usable row for which the column `queries` holds.

    `vectors`: vec_id, embedding.  Ties go to the smaller vec_id; a query never
    finds its own id; a repeated row is one row, and of several vectors under one id
    the query is the first in array order.  A table without two usable
    rows gives no rows.
    """
    rows = stored(usable(vectors), "ann-rows")
    entries = stored(entries_of(rows, ranks), "ann-entries")
    total = entries.count()
    dimension = rows.select(F.size("v")).first()
    if dimension is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes = projections(dimension[0], trees)

    def plant(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            strings = hash_strings(x, planes)
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(x), pa.int32()), pa.array(strings[:, tree]), batch.column("ids"), batch.column("v")],
                    names=["tree", "string", "ids", "v"],
                )

    def strings_only(batches):
        for batch in plant(batches):
            yield batch.select(["tree", "string"])

    prefix = F.shiftright("string", BITS - COUNTED)
    counted = entries.mapInArrow(strings_only, "tree int, string long").groupBy("tree", prefix.alias("prefix")).count()
    shape = Shape({(r["tree"], r["prefix"]): r["count"] for r in counted.collect()}, trees, total)  # at most trees * 2**COUNTED rows
    needed = max(least, int(share * total))

    def deal(batches):
        for batch in batches:
            tree, string = batch.column("tree").to_numpy(), batch.column("string").to_numpy()
            top = string >> (BITS - COUNTED)
            parts = shape.parts[tree, top]
            pick = np.array([i[0] for i in batch.column("ids").to_pylist()], dtype=np.int64)
            array = shape.first[tree, top] + pick % parts
            yield pa.RecordBatch.from_arrays([pa.array(array), *batch.columns], names=["array", *batch.schema.names])

    def send(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            strings, ids = hash_strings(x, planes), batch.column("query_id").to_pylist()
            out = [[] for _ in range(5)]
            for i in range(len(x)):
                bits = shape.level(strings[i], needed)
                for tree in range(trees):
                    found = shape.arrays_of(tree, int(strings[i, tree]), bits).tolist()
                    out[0] += found
                    out[1] += [ids[i]] * len(found)
                    out[2] += [int(strings[i, tree])] * len(found)
                    out[3] += [bits] * len(found)
                    out[4] += [i] * len(found)
                if len(out[0]) >= 4096 or i == len(x) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in out[:4]), batch.column("v").take(pa.array(out[4], pa.int64()))],
                        names=["array", "query_id", "string", "bits", "v"],
                    )
                    out = [[] for _ in range(5)]

    def search(asked: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(kept):
            kept = kept.sort_values("string", kind="stable")
            strings = kept["string"].to_numpy()
            x = np.stack(kept["v"].to_numpy())
            ids = kept["ids"].tolist()
            norms = np.sqrt((x * x).sum(axis=1))
            part = -(-needed // (trees * 4))
            for query, string, bits, v in zip(asked["query_id"], asked["string"], asked["bits"], asked["v"]):
                low, high = 0, len(strings)
                depth = int(bits)
                while True:
                    shift = BITS - depth
                    a = int(np.searchsorted(strings, string >> shift << shift))
                    b = int(np.searchsorted(strings, ((string >> shift) + 1) << shift))
                    if depth > bits and b - a < part:
                        break
                    low, high = a, b
                    if b - a <= part or depth == BITS or depth < COUNTED:
                        break
                    depth += 1
                if high == low:
                    continue
                own = np.sqrt((v * v).sum())
                near = x[low:high] @ v / norms[low:high]
                best = np.argsort(-near, kind="stable")[: 4 * ranks] + low
                if len(near) > len(best):  # whatever ties with the last of these
                    edge = near[best[-1] - low]
                    best = np.flatnonzero(near >= edge - 1e-9 * abs(edge) - 1e-12) + low
                score = (x[best] * v).sum(axis=1) / (norms[best] * own)
                pairs = [(-s, i, s) for k, s in zip(best.tolist(), score.tolist()) for i in ids[k] if i != query]
                out += [(query, i, s) for _, i, s in sorted(pairs)[:ranks]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    planted = entries.mapInArrow(plant, "tree int, string long, ids array<long>, v array<double>")
    arrays = planted.mapInArrow(deal, "array long, tree int, string long, ids array<long>, v array<double>")
    asked = rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = asked.mapInArrow(send, "array long, query_id long, string long, bits long, v array<double>")
    found = (
        asked.groupBy("array")
        .cogroup(arrays.drop("tree").groupBy("array"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A candidate met in several trees is one.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
