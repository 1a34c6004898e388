"""Mixing sources to target weights by the cube method (operator 6).

A source's target is a number of words.  Every document is taken
``floor(target / source words)`` times, and once more with the remaining
fraction as inclusion probability.  The cube method makes that last choice:
probabilities move along the null space of the balancing constraints (token
total and document count of the source) until they are 0 or 1.

* Flight: among three undecided documents of a source there is one direction
  that changes neither the token total nor the count; the probabilities move
  along it, up or down at random with the odds that keep each one's
  expectation, until one is decided.  Blocks of documents run their own
  flights in parallel; of each at most two documents stay undecided, and these
  meet again in the blocks of the next level, until one block a source is left.
* Landing: the at most two documents a source has left are decided so that the
  token total comes nearest to what their probabilities promise.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.common import splitmix, stored, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
#: Documents in one block of a flight.
BLOCK = 4_000
_SEPARATORS = r"[\x20\x09-\x0D]+"


def word_count(text):
    """Number of words; null has none."""
    bare = F.regexp_replace(text, "^" + _SEPARATORS + "|" + _SEPARATORS + "$", "")
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, _SEPARATORS))).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, weigh `weights`, repeating.  They
    share `share_percent` of all sizes by weight; a target stops at
    `most_copies` times its source's size and the excess is shared again by
    weight until none is above.  One row a source is all that meets here.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, weights))
    by = by.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # Full sources are those of the smallest ceiling per weight: a prefix of this order.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    by = by.withColumns(
        {
            "_total": F.sum("source_size").over(all_rows) * F.lit(share_percent) / F.lit(100.0),
            "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most_copies),
            "_rest": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    open_ = F.col("source_size") * F.lit(most_copies) > level * F.col("weight")
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("_level", F.first(F.when(open_, level), ignorenulls=True).over(whole))
    ceiling = (F.col("source_size") * F.lit(most_copies)).cast("double")
    return by.select("source", "source_size", F.coalesce(F.least(ceiling, F.col("_level") * F.col("weight")), ceiling).alias("target"))


def flight(sizes: np.ndarray, chances: np.ndarray, seed: int) -> np.ndarray:
    """Move the chances of one block until at most two lie strictly between 0 and 1."""
    out = chances.tolist()
    sizes = sizes.tolist()
    draw = np.random.default_rng(seed)
    eps = 1e-9
    held: list[int] = []
    odds = iter(draw.random(len(out) + 1).tolist())
    for i in range(len(out)):
        if out[i] <= eps or out[i] >= 1 - eps:
            out[i] = float(round(out[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            # orthogonal to (1, 1, 1) and to the sizes
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)  # equal sizes: any exchange keeps both totals
            up = min(((1 - out[k]) / x if x > 0 else out[k] / -x) for k, x in zip(held, u) if x)
            down = min((out[k] / x if x > 0 else (1 - out[k]) / -x) for k, x in zip(held, u) if x)
            step = up if next(odds) * (up + down) < down else -down
            left = []
            for k, x in zip(held, u):
                p = out[k] + step * x
                if p <= eps or p >= 1 - eps:
                    out[k] = float(round(p))
                else:
                    out[k] = p
                    left.append(k)
            if len(left) == 3:  # rounding hid the one that was decided
                k = min(left, key=lambda j: min(out[j], 1 - out[j]))
                out[k] = float(round(out[k]))
                left.remove(k)
            held = left
    return np.array(out)


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Decide the last ones of a source: the choice whose words come nearest to the expected ones, smallest first on ties."""
    open_ = np.flatnonzero((chances > 0) & (chances < 1))
    promised = float(sizes[open_] @ chances[open_])
    best = min(range(1 << len(open_)), key=lambda bits: (abs(sum(int(sizes[j]) for k, j in enumerate(open_) if bits >> k & 1) - promised), bits))
    out = chances.copy()
    for k, j in enumerate(open_):
        out[j] = float(best >> k & 1)
    return out


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_copies: int = MOST_COPIES,
    block: int = BLOCK,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, print, rows, size, source, source_size, target, copies): how often the mix takes each row of `docs`.

    `docs`: doc_id, text, source.  Rows without words (size 0) are never
    taken; null sources are one source.  Repeated rows (`rows` of one id, text
    and source) are decided together and taken equally often.  Reruns agree:
    order and draws come from hashes of the row and the seed.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("print"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    rows = rows.groupBy("doc_id", "source", "print", "size").agg(F.count(F.lit(1)).alias("rows"))
    rows = stored(rows, "mix-sizes")
    whole = rows.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = stored(source_targets(whole, weights, share_percent, most_copies), "mix-targets")
    largest = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    # One row a source; joined by a null-safe key, AQE splits a source of very many rows.
    keyed = (
        rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_ratio", F.when(F.col("size") > 0, F.col("_ratio")).otherwise(F.lit(0.0)))
        .withColumn("base", F.floor("_ratio").cast("long"))
        .withColumn("chance", F.col("_ratio") - F.col("base"))
        .withColumn("draw", F.xxhash64("doc_id", "print", F.lit(seed)))
        .drop("_ratio")
    )
    blocks = max(1, -(-int(largest) // block))  # of the largest source
    keyed = keyed.withColumn("part", F.pmod("draw", F.lit(blocks)).cast("int"))
    done = _fly(keyed, seed, last=blocks == 1)
    if blocks == 1:
        return _copies(done)
    done = stored(done, "mix-flight")
    decided = done.where("chance IN (0, 1)")
    left = done.where("chance NOT IN (0, 1)")
    fan = max(2, block // 2)
    while blocks > 1:
        blocks = -(-blocks // fan)
        left = left.withColumn("part", F.floor(F.col("part") / F.lit(fan)).cast("int"))
        left = stored(_fly(left, seed + blocks, last=blocks == 1), "mix-flight")
        decided = decided.unionByName(left.where("chance IN (0, 1)"))
        left = left.where("chance NOT IN (0, 1)")
    return _copies(decided)


def _fly(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "doc_id", "print"], kind="stable")
        sizes = (frame["size"] * frame["rows"]).to_numpy()
        name = key[0] if isinstance(key[0], str) else ""
        start = splitmix(sum(b * splitmix(i) for i, b in enumerate(name.encode())) % (1 << 64) ^ splitmix(int(key[1]) + seed))
        chances = flight(sizes, frame["chance"].to_numpy(), start)
        frame["chance"] = landing(sizes, chances) if last else chances
        return frame

    return rows.groupBy("source", "part").applyInPandas(run, rows.schema)


def _copies(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "print", "rows", "size", "source", "source_size", "target", (F.col("base") + F.col("chance").cast("long")).alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it."""
    taken = mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), F.col("source").alias("_source"), F.col("copies").alias("_copies")
    )
    same = (
        docs["doc_id"].cast("long").eqNullSafe(taken["_doc"])
        & F.xxhash64(docs["text"]).eqNullSafe(taken["_print"])
        & docs["source"].cast("string").eqNullSafe(taken["_source"])
    )
    joined = docs.join(taken, same)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
