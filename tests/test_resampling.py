"""Bootstrap by counts against exact binomials and against drawing every row."""

import math
import random

import pytest

from trialsift import constants as C
from trialsift.operators import evaluate as E


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (7, 0.1), (40, 0.93), (300, 0.37), (1000, 0.002)])
def test_binomial_is_the_exact_quantile(n, p):
    draw = random.Random(n)
    upto, total = [], 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        upto.append(total)
    for u in [0.5 / 2**32, 1 - 0.5 / 2**32, *(draw.random() for _ in range(200))]:
        k = E.binomial(n, p, u)
        assert (k == 0 or upto[k - 1] < u + 1e-12) and (upto[k] >= u - 1e-12 or k == n)


def test_binomial_of_many_rows_and_edges():
    n, p = 10**10, 0.3
    assert abs(E.binomial(n, p, 0.5) - n * p) <= 2
    assert abs(E.binomial(n, p, 0.975) - n * p - 1.96 * math.sqrt(n * p * (1 - p))) < 100
    assert (E.binomial(0, 0.5, 0.3), E.binomial(9, 0.0, 0.9), E.binomial(9, 1.0, 0.1)) == (0, 0, 9)


def test_resampled_counts_keep_the_total():
    cells = [5, 0, 17, 0, 0, 100, 1, 0, 3]
    samples = E.resampled_counts(cells, "D1", 500)
    assert all(sum(s) == sum(cells) and min(s) >= 0 for s in samples)
    assert all(not any(s[k] for s in samples) for k in (1, 3, 4, 7))
    for k, n in enumerate(cells):
        mean = sum(s[k] for s in samples) / len(samples)
        assert abs(mean - n) <= 4 * math.sqrt(max(n, 1) / len(samples)) + 1e-9
    assert E.resampled_counts(cells, "D1", 3) == samples[:3]


def test_interval_is_near_that_of_drawn_rows(spark):
    draw, rows = random.Random(8), []
    for i in range(3000):
        gold = draw.choice(C.JUDGMENTS)
        rows.append((f"D{i % 2}", i, gold, gold if draw.random() < 0.7 else draw.choice([*C.JUDGMENTS, None])))
    pairs = spark.createDataFrame(rows, "domain string, doc_id long, gold string, pred string")
    by_rows = {r.domain: r for r in E.bootstrap_interval(pairs, ["domain"], "doc_id").collect()}
    by_counts = {r.domain: r for r in E.count_bootstrap_interval(pairs, ["domain"]).collect()}
    assert by_counts.keys() == by_rows.keys() == {"D0", "D1"}
    for d, one in by_counts.items():
        for name in ("percent_agreement_low", "percent_agreement_high", "gwet_ac_low", "gwet_ac_high"):
            # both ends are order statistics of 200 samples: within a third of the interval's width
            assert abs(one[name] - by_rows[d][name]) < 0.02
    assert E.count_bootstrap_interval(pairs.limit(0), ["domain"]).count() == 0


def test_bootstrap_ci_draws_every_cell(spark, tmp_path):
    from trialsift.plans import evaluation as PE

    draw = random.Random(3)
    docs = [(i, "text of a document " * draw.randint(1, 9), draw.choice(["en", "de"]), f"s{i % 5}", 10) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, draw.randint(0, 1), draw.randint(0, 1)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = PE.bootstrap_ci(spark, str(tmp_path)).collect()
    want = E.bootstrap_interval(PE.cells(spark, str(tmp_path)), ["domain"], "doc_id").collect()
    counted = PE.bootstrap_ci_counts(spark, str(tmp_path)).collect()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want)) != sorted(map(repr, counted))
