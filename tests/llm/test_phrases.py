"""Operator 12 against plain counting in Python."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, documents, nothing
from trialsift.llm import dic_phrases
from trialsift.llm.dic_phrases import collocations, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counts = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def plain(rows, least, top):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            cuts = [(int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 50 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    for name in ("phrase", "words", "since", "f", "shard", "a", "k", "rank", "part", "place"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(6)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ß", "漢字", "a\x00b", " ", "#"]
    phrases = [" ".join(draw.choice(words) for _ in range(draw.choice([2, 3, 4]))) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 60)):
            parts.append(draw.choice(phrases) if draw.random() < 0.5 else draw.choice(words).title())
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; ", "\r\n", "?!"]))
        rows.append(("".join(parts), draw.choice(["en", "en", "de", None])))
    rows += [(None, "en"), ("", "fr"), (" \t.\n", "fr"), ("same " * 300, "en"), ("one two three", "it")]
    return rows + rows[:3] * 4  # repeated rows


def columns(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("window", "held"), [(1 << 21, 1_000_000), (150, 50)])
def test_phrases_equal_plain_counting(spark, monkeypatch, window, held):
    """Small windows cut the longer texts; a small memory passes counts on several times a task."""
    monkeypatch.setattr(dic_phrases, "WINDOW", window)
    monkeypatch.setattr(dic_phrases, "HELD", held)
    rows = corpus(window, 60)
    assert columns(collocations(frame(spark, rows))) == plain(rows, 10, 2000)


def test_counts_do_not_depend_on_shards_or_the_filter(spark):
    rows = corpus(3, 60)
    want = {(lang, " ".join(p), len(p), c) for lang, f in plain_counts(rows).items() for p, c in f.items() if c >= 12}
    for shards, slots in ((1, 1 << 20), (2, 1 << 15), (4, 1 << 15)):
        found, totals = frequent_phrases(frame(spark, rows), least=12, shards=shards, slots=slots)
        assert {tuple(r) for r in found.select("lang", "phrase", "words", "f").collect()} == want
        assert dict(totals.collect()) == {k: sum(c for p, c in f.items() if len(p) == 1) for k, f in plain_counts(rows).items() if f}


def test_the_first_of_ties_and_few(spark):
    rows = [("a b. b a. c d", "x")] * 10
    assert columns(collocations(frame(spark, rows), top=2)) == plain(rows, 10, 2)


def test_general_fixture_and_empty_table(spark):
    docs = documents(spark)
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert columns(collocations(docs)) == plain(rows, 10, 2000)
    assert collocations(nothing(spark)).count() == 0
