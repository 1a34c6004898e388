"""Agreement statistics between reference labels and predictions.

Every coefficient is a function of the label-by-label counts, so one
map-side-combined aggregation per report is enough at any size.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators.skew import hot_key_join


def expand_label(code: Column) -> Column:
    """L/S/H to full labels, other text kept; letter case of full labels is normalised."""
    text = F.trim(code)
    out = None
    for short, label in C.JUDGMENT_SHORT.items():
        hit = (text == short) | (F.lower(text) == label.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(text)


def join_predictions(gold: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    return gold.join(predictions, key, "inner")


def missing_predictions(gold: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    return gold.join(predictions.select(*key), key, "left_anti").select(*key)


def _cell(i: int, j: int) -> str:
    return f"n_{i}{j}"


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def label_counts(
    pairs: DataFrame, group: list[str], labels=C.JUDGMENTS, gold: str = "gold", pred: str = "pred",
    weight: Column | None = None,
) -> DataFrame:
    """Counts n_ij (gold label i, predicted label j) per group; null predictions drop out.

    The counts of all pairs whose labels are outside `labels` still enter n
    and the diagonal, as they do in the definitions.
    """
    w = F.lit(1) if weight is None else weight
    cells = [
        F.sum(F.when((F.col(gold) == a) & (F.col(pred) == b), w).otherwise(0)).alias(_cell(i, j))
        for i, a in enumerate(labels)
        for j, b in enumerate(labels)
    ]
    clean = pairs.where(F.col(pred).isNotNull() & F.col(gold).isNotNull())
    return clean.groupBy(*group).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(gold) == F.col(pred), w).otherwise(0)).alias("n_agree"), *cells
    )


def coefficients(q: int = len(C.JUDGMENTS)) -> dict[str, Column]:
    """percent_agreement, cohen_kappa, gwet_ac over label_counts columns."""
    n = F.col("n").cast("double")
    observed = F.when(n > 0, F.col("n_agree") / n)
    row = [_sum([F.col(_cell(i, j)) for j in range(q)]) / n for i in range(q)]
    column = [_sum([F.col(_cell(i, j)) for i in range(q)]) / n for j in range(q)]
    expected = _sum([row[i] * column[i] for i in range(q)])
    pooled = [(row[i] + column[i]) / F.lit(2.0) for i in range(q)]
    chance = _sum([p * (F.lit(1.0) - p) for p in pooled]) / F.lit(float(q - 1))

    def corrected(by_chance: Column) -> Column:
        close = lambda x: F.abs(F.lit(1.0) - x) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x))
        return (
            F.when(n <= 0, None)
            .when(close(by_chance), F.when(close(observed), F.lit(1.0)))
            .otherwise((observed - by_chance) / (F.lit(1.0) - by_chance))
        )

    return {
        "percent_agreement": observed,
        "cohen_kappa": corrected(expected),
        "gwet_ac": corrected(chance),
    }


def agreement_report(pairs: DataFrame, group: list[str], labels=C.JUDGMENTS) -> DataFrame:
    counts = label_counts(pairs, group, labels)
    return counts.select(*group, "n", *[c.alias(k) for k, c in coefficients(len(labels)).items()])


def confusion_matrix(pairs: DataFrame, group: list[str], labels=C.JUDGMENTS) -> DataFrame:
    """Long matrix, every label pair present (zero-filled)."""
    counts = label_counts(pairs, group, labels)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("gold"), F.lit(b).alias("pred"), F.col(_cell(i, j)).alias("n_pairs"))
            for i, a in enumerate(labels)
            for j, b in enumerate(labels)
        ]
    )
    return counts.select(*group, F.explode(cells).alias("c")).select(*group, "c.*")


def quantile(values: Column, q: float) -> Column:
    """Element at round-half-even((n-1)q) of the sorted non-null values; empty gives null."""
    ordered = F.array_sort(F.array_compact(values))
    index = F.bround((F.size(ordered) - 1) * F.lit(q)).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, index))


def uniform(seed: Column) -> Column:
    """Repeatable integer in [0, 2^32) from md5."""
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint")


def _interval(samples: DataFrame, group: list[str]) -> DataFrame:
    stats = coefficients()
    scored = samples.select(*group, *[stats[k].alias(k) for k in ("percent_agreement", "gwet_ac")])
    grouped = scored.groupBy(*group) if group else scored.groupBy()
    # as many values per group as iterations: bounded
    return grouped.agg(
        *[
            quantile(F.collect_list(k), q).alias(f"{k}_{name}")
            for k in ("percent_agreement", "gwet_ac")
            for name, q in (("low", 0.025), ("high", 0.975))
        ]
    )


def _parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bootstrap_interval(
    pairs: DataFrame, group: list[str], row_id: str, iterations: int = C.BOOTSTRAP_ITERATIONS, labels=C.JUDGMENTS
) -> DataFrame:
    """Percentile interval from resampling cells with replacement.

    A draw is an index into the cells ordered by label pair, so it only needs
    the cumulative label-pair counts of its group - not the cells themselves -
    and every sample is counted map-side.
    """
    clean = pairs.where(F.col("pred").isNotNull() & F.col("gold").isNotNull())
    counts = label_counts(clean, group, labels)
    names = [_cell(i, j) for i in range(len(labels)) for j in range(len(labels))]
    cumulative = counts.select(
        *group,
        F.col("n").alias("_n"),
        F.array(*[_sum([F.col(c) for c in names[: k + 1]]) for k in range(len(names))]).alias("_upper"),
    )
    # a report dimension may hold most cells: its few count rows are joined hot-key aware
    drawn = (
        hot_key_join(clean.select(*group, row_id), cumulative, group, "inner", salts=64)
        # every row is about to become `iterations` rows: spread them by count, not by bytes
        .repartition(_parallelism(pairs), row_id)
        .withColumn("_iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .withColumn("_at", uniform(F.concat_ws("|", F.col("_iter"), F.col(row_id))) % F.col("_n"))
    )
    pick = F.expr(" + ".join(f"IF(_upper[{k}] <= _at, 1, 0)" for k in range(len(names))))
    size = len(labels)
    samples = (
        drawn.select(*group, "_iter", pick.alias("_k"))
        .groupBy(*group, "_iter")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("_k").isin(*[i * size + i for i in range(size)])).alias("n_agree"),
            *[F.count_if(F.col("_k") == k).alias(name) for k, name in enumerate(names)],
        )
    )
    return _interval(samples, group)


def binomial(n: int, p: float, u: float) -> int:
    """Least k at which the binomial distribution function of n and p reaches u, 0 < u < 1.

    Only places within ten deviations of the mean are added up; what lies beyond is below any
    u of 32 bits.
    """
    if n == 0 or p <= 0.0:
        return 0
    if p >= 1.0:
        return n
    mean, spread = n * p, 10.0 * math.sqrt(n * p * (1.0 - p)) + 40.0
    low, high = max(0, int(mean - spread)), min(n, int(mean + spread) + 1)
    at_low = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((n - k) / (k + 1.0)) + (math.log(p) - math.log1p(-p))
    reached = np.cumsum(np.exp(np.concatenate([[at_low], at_low + np.cumsum(steps)])))
    return min(low + int(np.searchsorted(reached, u, side="left")), high)


def resampled_counts(cells: list[int], seed: str, iterations: int) -> list[list[int]]:
    """Counts of as many draws with replacement as there are rows, `iterations` times, out of the rows' counts.

    The draws of an iteration are split off class by class: how many fall to a class is binomial in
    those left.  Draws are uniform numbers from md5 of iteration, seed and class.
    """
    total, out = sum(cells), []
    for iteration in range(iterations):
        left, rest, drawn = total, total, []
        for k, n in enumerate(cells[:-1]):
            u = (int(hashlib.md5(f"{iteration}|{seed}|{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32
            w = binomial(left, n / rest, u) if rest else 0
            drawn.append(w)
            left, rest = left - w, rest - n
        out.append([*drawn, left])
    return out


def count_bootstrap_interval(
    pairs: DataFrame, group: list[str], iterations: int = C.BOOTSTRAP_ITERATIONS, labels=C.JUDGMENTS
) -> DataFrame:
    """Percentile interval from resampling cells with replacement, drawn from the label-pair counts of a group.

    The same distribution as `bootstrap_interval`, which draws every cell: rows are counted once, map-side, and
    the work after that grows with groups and iterations only.  A group without a counted pair has no row.
    """
    clean = pairs.where(F.col("pred").isNotNull() & F.col("gold").isNotNull())
    size = len(labels)
    names = [_cell(i, j) for i in range(size) for j in range(size)]

    @F.pandas_udf("array<array<bigint>>")
    def resample(cells: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([resampled_counts([int(n) for n in c], s, iterations) for c, s in zip(cells, seed)])

    counts = label_counts(clean, group, labels)
    seed = F.concat_ws("|", *[F.col(g).cast("string") for g in group])
    drawn = counts.select(*group, resample(F.array(*names), seed).alias("_samples")).select(*group, F.explode("_samples").alias("_c"))
    samples = drawn.select(
        *group,
        *[F.col("_c")[k].alias(name) for k, name in enumerate(names)],
        _sum([F.col("_c")[k] for k in range(len(names))]).alias("n"),
        _sum([F.col("_c")[i * size + i] for i in range(size)]).alias("n_agree"),
    )
    return _interval(samples, group)


# Poisson(1) cumulative probabilities, scaled to 2^32.
POISSON_CUTS = tuple(
    int(p * 2**32)
    for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
)


def cluster_bootstrap_interval(
    pairs: DataFrame, group: list[str], cluster: str, iterations: int = C.BOOTSTRAP_ITERATIONS, labels=C.JUDGMENTS
) -> DataFrame:
    """Interval from resampling whole clusters with Poisson(1) weights.

    Cells are counted per cluster first, so a cluster that owns a third of all
    cells is one row when the weights are applied.
    """
    per_cluster = label_counts(pairs, [*group, cluster], labels)
    names = ["n", "n_agree"] + [_cell(i, j) for i in range(len(labels)) for j in range(len(labels))]
    u = uniform(F.concat_ws("|", F.lit("cluster"), F.col("_iter"), F.col(cluster)))
    weighted = (
        per_cluster.repartition(_parallelism(pairs), cluster)
        .withColumn("_iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
        .withColumn("_u", u)
        .withColumn("_w", _sum([(F.col("_u") >= cut).cast("int") for cut in POISSON_CUTS]))
    )
    samples = weighted.groupBy(*group, "_iter").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names])
    return _interval(samples, group)


def collapsed_class(code: Column) -> Column:
    return F.when(code.isin("Y", "PY"), "yes").when(code.isin("N", "PN"), "no").when(code == "NI", "ni")


def question_metrics(answers: DataFrame) -> DataFrame:
    """Per-domain and total question accuracy, NI split, consistency and flag calibration.

    Needs domain, answer, final_answer, gold_answer, second_answer, error, flag.
    """
    scored = answers.where(F.col("gold_answer") != "NA")
    hit = collapsed_class(F.col("final_answer")) == collapsed_class(F.col("gold_answer"))
    is_hit = F.when(hit, 1.0).otherwise(0.0)
    is_ni = F.col("final_answer") == "NI"
    return scored.rollup("domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(is_hit).alias("collapsed_accuracy"),
        F.avg(F.when(F.col("error").isNull(), is_hit)).alias("parsed_only_accuracy"),
        F.avg(F.when(is_ni & F.col("error").isNull() & (F.col("answer") == "NI"), 1.0).otherwise(0.0)).alias(
            "substantive_ni_rate"
        ),
        F.avg(F.when(F.col("error").isNotNull(), 1.0).otherwise(0.0)).alias("failure_ni_rate"),
        F.avg(F.when(F.col("answer") == F.col("second_answer"), 1.0).otherwise(0.0)).alias("run_consistency"),
        *[F.avg(F.when(F.col("flag") == f, is_hit)).alias(f"accuracy_{f.lower()}") for f in ("CONFIDENT", "UNCERTAIN", "FLAGGED")],
    )


def pipeline_version(base: str, aux_model: Column, provider: Column, snapshot: Column, retriever: str = "hybrid") -> Column:
    """Arm-specific version: 12 hex digits over the sorted-key JSON of its settings."""
    payload = F.format_string(
        f'{{"aux_model": "%s", "base_version": "{base}", "consort_enabled": false, "provider": "%s", '
        f'"retriever": "{retriever}", "snapshot": "%s"}}',
        aux_model, provider, snapshot,
    )
    return F.concat(F.lit(f"{base}+eval."), F.substring(F.sha2(payload, 256), 1, 12))
