"""The pipeline's stages on a small table, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import documents, nothing
from tests.llm.test_text_operators import WORD, _first_windows, _shingles
from trialsift.llm import zstd_lang
from trialsift.llm.common import stored, table
from trialsift.llm.tokens import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "ngram_jaccard_join",
        "substring_dedup",
        "source_mix",
        "packing",
    ]


def test_stages_one_by_one(spark):
    extra = documents(spark, extra=False).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = table(spark, SF, "documents").unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)

    learned = zstd_lang.learn(docs)
    clear = Counter(
        (r.doc_id, r.text) for r in zstd_lang.classify(docs.select("doc_id", "text"), learned).where("NOT rejected").collect()
    )
    first = stored(stages["language_id"](spark, docs, SF), "test-1")
    assert first.columns == docs.columns and Counter((r.doc_id, r.text) for r in first.collect()) == clear

    rows = [(r.doc_id, _shingles(r.text)) for r in first.collect()]
    second = stored(stages["ngram_jaccard_join"](spark, first, SF), "test-2")
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups.setdefault(find(i), set()).add(doc)
    stay = {min(g) for g in groups.values()}
    assert {r.doc_id for r in second.collect() if r.doc_id is not None} == stay

    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in second.collect()]
    third = stored(stages["substring_dedup"](spark, second, SF), "test-3")
    want = Counter((d, tuple(x for i, x in enumerate(w) if i not in gone)) for d, w, gone in _first_windows(rows) if not gone or len(gone) < len(w))
    assert Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in third.collect()) == want

    fourth = stored(stages["source_mix"](spark, third, SF), "test-4")
    before = Counter((r.doc_id, r.text) for r in third.collect())
    after = Counter((r.doc_id, r.text) for r in fourth.collect())
    assert all(n <= 2 * before[k] for k, n in after.items())
    size = {k: len(WORD.findall(k[1] or "")) for k in before}
    total = sum(size[k] * n for k, n in before.items())
    assert abs(sum(size[k] * n for k, n in after.items()) - 1.5 * total) < 0.1 * total

    fifth = stages["packing"](spark, fourth, SF).collect()
    ids = encoder(tokenizer_path()).encode([r.text or "" for r in fourth.collect()])
    assert sum(r.length for r in fifth) == sum(len(x) // 2 + 1 for x in ids)
    fill = Counter()
    for r in fifth:
        fill[r.sequence_id] += r.length
    assert all(n == 2048 for w, n in fill.items() if w != max(fill))
    assert max(fill) + 1 == -(-sum(fill.values()) // 2048) and np.all(np.array(list(fill.values())) <= 2048)


def test_empty_table_runs_through(spark):
    docs = nothing(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0
