"""Joins, ranks and running sums that survive a key holding a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift.session import materialize


def hot_keys(df: DataFrame, key: list[str], max_share: float = 0.01) -> DataFrame:
    """Hashes of the keys that own more than `max_share` of the rows.

    A frequent-items sketch finds them in one map-side pass; at most
    1/max_share keys can qualify, so the result is safe to broadcast.
    """
    items = math.ceil(1 / max_share)
    found = df.select(F.xxhash64(*key).alias("_key_hash")).agg(
        F.expr(f"approx_top_k(_key_hash, {items}, {max(4096, 64 * items)})").alias("_top"), F.count(F.lit(1)).alias("_total")
    )
    return (
        found.select("_total", F.explode("_top").alias("_e"))
        .where(F.col("_e.count") > F.col("_total") * max_share)
        .select(F.col("_e.item").alias("_key_hash"), F.lit(True).alias("_hot"))
    )


def hot_key_join(
    big: DataFrame, small: DataFrame, key: list[str], how: str = "left", salts: int = 16, max_share: float = 0.02
) -> DataFrame:
    """Equi-join whose hot keys on `big` are split over `salts` tasks.

    Only the hot keys of `small` are replicated, so `small` should hold few
    rows per key.  Splitting never changes the result, whatever the sketch
    calls hot.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep the rows of the big side")
    hot = F.broadcast(hot_keys(big, key, max_share))
    # Whole-row hash: a retried task draws the same salt again.
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if not _is_map(big, c)]), F.lit(salts)).cast("int")
    left = (
        big.withColumn("_key_hash", F.xxhash64(*key))
        .join(hot, "_key_hash", "left")
        .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
        .drop("_hot", "_key_hash")
    )
    right = (
        small.withColumn("_key_hash", F.xxhash64(*key))
        .join(hot, "_key_hash", "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot", "_key_hash")
    )
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def exact_rank(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """row_number() per group without ever holding a group in one task.

    Rows are range-partitioned on (group, order), so one large group spreads
    over many partitions; the rank is the rank inside the partition plus the
    group's row count in earlier partitions.  The partitioned rows are
    checkpointed first, because both steps must see the same layout.
    `order` has to be unique within a group.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn(
        "_part", F.spark_partition_id()
    )
    placed = materialize(placed)
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    # one row per (group, partition): a group spans at most `parts` of them
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        placed.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = placed.withColumn("_rn", F.row_number().over(local))
    return (
        ranked.join(counts, [*group, "_part"])
        .withColumn(out, (F.col("_rn") + F.col("_before")).cast("int"))
        .drop("_rn", "_before", "_part")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group.  Spark cuts each task to k rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def running_sum_before(
    df: DataFrame, group: list[str], ordinal: str, value: Column, out: str, block: int = 4096
) -> DataFrame:
    """Sum of `value` over earlier rows of the group, in two levels.

    Blocks of consecutive ordinals are summed first; the window over a group
    then only sees one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(ordinal) / F.lit(block)))
    totals = (
        blocked.groupBy(*group, "_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn(
            "_base",
            F.coalesce(
                F.sum("_sum").over(
                    Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_sum")
    )
    inside = Window.partitionBy(*group, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [*group, "_block"])
        .withColumn(out, F.col("_base") + F.col("_in"))
        .drop("_block", "_base", "_in")
    )
