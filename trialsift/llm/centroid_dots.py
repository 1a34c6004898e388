"""Centroid clustering by an incremental distance matrix (operator 13).

Vectors are made integer, and each carries its exact dot products with all
centroids.  When centroids move, a dot product changes by the vector's components
at the places where that centroid's changed, times the change; nothing else is multiplied.
The squared distance is |x|^2 - 2 x.c + |c|^2, and the nearest centroid is the least of a row.

* The dot products are a written table: each round reads the last one and writes its own,
  so a lost executor costs the tasks it held and no round is run again.  It carries the
  components too, since rows have no order by which two tables could be laid side by side.
* A task adds up its vectors by cluster before anything is shuffled; the centroids
  (k times the dimension numbers, whatever the rows) are all that the driver sees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import stored, table

DIMENSION = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64.0
SEED = 1
#: Integer components are held to this, so that every squared distance of up to 128 components fits a long.
LARGEST = 1 << 27

_STATE = "vec_id {id}, x array<int>, dots array<long>"


def quantised(vectors: DataFrame, dimension: int = DIMENSION, scale: float = SCALE) -> DataFrame:
    """(vec_id, x): rows of `dimension` finite components, each floor(scale * component), held to +-LARGEST."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(
        v, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(c * scale).cast("double"))).cast("int")
    )
    return vectors.where(v.isNotNull() & (F.size(v) == dimension) & ~bad).select("vec_id", whole.alias("x"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The rows of the smallest sha256 of `seed:vec_id`; equal ids by their components, rows without an id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], dtype=np.int64)


def _matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _moved(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after each centroid changed by a row of `change`; only its nonzero components are multiplied."""
    for j in range(len(change)):
        at = np.flatnonzero(change[j])
        if len(at):
            dots[:, j] += x[:, at] @ change[j, at]
    return dots


def _nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest centroid; the smaller number of equally near ones."""
    away = (centroids * centroids).sum(axis=1) - 2 * dots
    cluster = away.argmin(axis=1)
    return cluster, (x * x).sum(axis=1) + away[np.arange(len(x)), cluster]


def _products(rows: DataFrame, change: np.ndarray, name: str) -> DataFrame:
    """The written table of dot products after `change`; a row that has none yet starts at zero."""
    clusters = len(change)
    fresh = "dots" not in rows.columns

    def update(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            dots = np.zeros((len(x), clusters), dtype=np.int64) if fresh else _matrix(batch.column("dots"))
            dots = _moved(x, dots, change)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), _lists(dots)], names=["vec_id", "x", "dots"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return stored(rows.mapInArrow(update, _STATE.format(id=kind)), name)


def _sums(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Rows of each cluster and the exact sums of their components."""
    clusters, dimension = centroids.shape

    def add(batches):
        count = np.zeros(clusters, dtype=np.int64)
        total = np.zeros((clusters, dimension), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"))
            cluster, _ = _nearest(x, _matrix(batch.column("dots")), centroids)
            for j in np.unique(cluster):
                mine = x[cluster == j]
                count[j] += len(mine)
                total[j] += mine.sum(axis=0)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _lists(total[some])], names=["cluster", "n", "total"])

    parts = state.mapInArrow(add, "cluster long, n long, total array<long>")
    one = parts.select("cluster", "n", F.posexplode("total").alias("place", "value"))
    exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    found = one.groupBy("cluster", "place").agg(F.sum("n").alias("n"), exact).collect()  # clusters * dimension rows at most
    count = np.zeros(clusters, dtype=np.int64)
    total = [[0] * dimension for _ in range(clusters)]
    for r in found:
        count[r["cluster"]] = r["n"]
        total[r["cluster"]][r["place"]] = int(r["value"])
    return count, total


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: float = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row.

    `vectors`: vec_id, embedding; other columns are not read.  Rows whose embedding is null, has
    another number of components, or a null or non-finite one take no part; of components beyond
    LARGEST / scale the integer is LARGEST.  Repeated rows and ids count each; a row without an id is
    clustered but never begins a centroid before rows with one.  With fewer rows than clusters there are as many
    centroids as rows; an empty table gives no rows.  An inertia beyond a long is null.
    """
    rows = quantised(vectors, dimension, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        names = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in names.items()))
    state = _products(rows, centroids, "dots-0")
    for k in range(1, rounds + 1):
        count, total = _sums(state, centroids)
        moved = centroids.copy()
        for j in np.flatnonzero(count):
            moved[j] = [t // int(count[j]) for t in total[j]]
        state = _products(state, moved - centroids, f"dots-{k}")
        centroids = moved

    def assign(batches):
        for batch in batches:
            cluster, distance = _nearest(_matrix(batch.column("x")), _matrix(batch.column("dots")), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = state.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    # one row a cluster, `clusters` at most
    inertia = found.groupBy("cluster").agg(total.alias("own")).select("cluster", "own", F.sum("own").over(Window.partitionBy(F.lit(0))).alias("all_rows"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return found.join(F.broadcast(inertia), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        F.expr("try_cast(own AS bigint)").alias("cluster_inertia"),
        F.expr("try_cast(all_rows AS bigint)").alias("inertia"),
        digest.alias("centroid_sha256"),
    )


def op13_centroid_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))
