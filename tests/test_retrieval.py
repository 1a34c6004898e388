"""Fused top-k by rank bounds against the full ranking."""

import random

import pytest
from pyspark.sql import functions as F

from trialsift.operators import retrieval as R


def scored(spark, sizes, seed):
    draw, rows = random.Random(seed), []
    for g, n in enumerate(sizes):
        for i in range(n):
            bm25 = draw.choice([0.0, -1.0, draw.randrange(8) / 2, draw.random() * 4])
            dense = draw.choice([None, -0.5, 0.0, draw.randrange(5) / 5, draw.random()])
            # ranks far apart: what leads one list is often far down in the other
            if n > 100:
                bm25, dense = (draw.random(), None) if i % 2 else (0.0, draw.random())
            if n > 100 and i < 20:
                bm25, dense = (9.0 + i, draw.random() / 500) if i % 2 else (draw.random() / 500, 2.0 + i)
            rows.append((f"t{g}", "D1", draw.randrange(1000), i, bm25, dense))
    return spark.createDataFrame(rows, "trial_id string, domain string, doc_id long, seg_ord int, bm25 double, dense double").repartition(4)


@pytest.mark.parametrize("top_k", [1, 5])
def test_fused_top_equals_the_full_ranking(spark, top_k):
    df = scored(spark, [400, 150, 90, 7, 3, 1], top_k).cache()
    columns = ["trial_id", "domain", "doc_id", "seg_ord", "bm25", "dense", "bm25_rank", "dense_rank", "rrf", "rank"]
    want = sorted(map(str, R.select_top(R.fuse(df), top_k).select(*columns).collect()))
    got = R.fused_top(df, top_k).select(*columns).collect()
    assert sorted(map(str, got)) == want
    far = [r for r in got if max(r.bm25_rank or 0, r.dense_rank or 0) > R.rank_bound(top_k)]
    assert far, "the fixture has winners past the bound of one list"


def test_no_positive_score_and_no_rows(spark):
    df = scored(spark, [6], 3).withColumns({"bm25": F.lit(0.0), "dense": F.lit(None).cast("double")})
    got = R.fused_top(df, 5).collect()
    assert [(r.rank, r.rrf) for r in sorted(got, key=lambda r: r["rank"])] == [(i, 0.0) for i in range(1, 6)]
    assert R.fused_top(df.limit(0), 5).count() == 0
