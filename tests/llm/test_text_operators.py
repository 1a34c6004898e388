"""Operators on texts against brute force on a small table."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.fixtures import documents, nothing
from trialsift.llm import license_minhash, quality_llr, seed_extend, trie_join

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def _shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def test_jaccard_components(spark, docs):
    rows = [(r.doc_id, _shingles(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    want = Counter((doc, len(s), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (doc, s) in enumerate(rows))
    assert Counter(map(tuple, trie_join.jaccard_components(docs).collect())) == want
    kept = {r.doc_id for r in trie_join.keep_one_each(docs).collect()}
    assert {1, 4, 5, 6, 7, 8, None} <= kept and not {2, 3, 9} & kept
    assert trie_join.keep_one_each(docs).columns == docs.columns


def test_block_links_and_tree():
    import random

    import numpy as np

    draw = random.Random(4)
    base = sorted(draw.sample(range(10**6), 60))
    sets = []
    for _ in range(40):
        own = set(base) - set(draw.sample(base, draw.randint(0, 12))) | set(draw.sample(range(10**6), draw.randint(0, 8)))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    tree = trie_join.PrefixTree(sets)
    for i, a in enumerate(sets):
        need = lambda j, a=a: trie_join.needed(len(a), len(sets[j]))
        found = set(tree.partners(a, need, trie_join.needed(len(a), -(-80 * len(a) // 100)), lambda j: False))
        want = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert found == want
    n = [len(s) for s in sets]
    joined = trie_join.block_links(list(range(40)), n, sets)
    assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in joined)


def test_many_near_copies_join(spark):
    """More near copies than a block holds, some of them apart."""
    import random

    draw = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(trie_join.BLOCK + 40):
        words = list(base)
        for k in draw.sample(range(100), draw.randint(0, 4)):
            words[k] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in trie_join.jaccard_components(docs).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def _first_windows(rows, size=20):
    """Brute force of the words to remove, per row."""
    first = {}
    for doc, words in rows:
        order = (1 << 63 if doc is None else doc)
        for s in range(len(words) - size + 1):
            key = tuple(words[s : s + size])
            first[key] = min(first.get(key, (order, s)), (order, s))
    for doc, words in rows:
        order = (1 << 63 if doc is None else doc)
        gone = set()
        for s in range(len(words) - size + 1):
            if first[tuple(words[s : s + size])] < (order, s):
                gone |= set(range(s, s + size))
        yield doc, words, gone


def test_repeats(spark, docs):
    rows = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    want = Counter(
        (doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        for doc, w, gone in _first_windows(rows)
    )
    assert Counter(map(tuple, seed_extend.removal_digest(docs).collect())) == want
    cut = seed_extend.cut_repeats(docs)
    assert cut.columns == docs.columns
    left = Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in cut.collect())
    kept = Counter(
        (doc, tuple(x for i, x in enumerate(w) if i not in gone)) for doc, w, gone in _first_windows(rows) if not gone or len(gone) < len(w)
    )
    assert left == kept


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(1,), (3,), (10,), (10,), (None,)], "doc_id long")
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in quality_llr.judge(docs, trusted).collect()
    )
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        words = WORD.findall(text)
        grams = Counter(zip(words, words[1:], words[2:]))
        repeat = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        want[r.doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), failed] += 1
    assert got == want
    again = quality_llr.judge(docs, trusted)
    assert again.where("base_failed AND kept").count() == 0
    assert {r.doc_id: r.kept for r in again.collect()}[1] is True


def test_licenses(spark):
    text = "Some words before. Released under the MIT License. And after it come more words."
    long_text = " ".join(f"word{i}" for i in range(3000))
    apache = "LICENSED under the Apache-License, version 2.0!"
    rows = [(1, text), (2, long_text + " " + apache), (2, apache), (3, None), (4, ""), (5, "under the MIT"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence", __import__("pyspark").sql.functions.lit(1))
    got = {(r.doc_id, r.licence): (r.containment, r.start_word) for r in license_minhash.scan(docs).collect()}
    assert got[1, "MIT"] == got[None, "MIT"] == (1.0, 2)  # the window of two shingles that begins before it
    assert got[2, "Apache-2.0"] == (1.0, 0)
    assert set(got) == {(1, "MIT"), (None, "MIT"), (2, "Apache-2.0")}


def test_empty_tables(spark):
    empty = nothing(spark)
    assert trie_join.jaccard_components(empty).count() == 0
    assert seed_extend.removal_digest(empty).count() == 0
    assert seed_extend.cut_repeats(empty).count() == 0
    assert quality_llr.judge(empty, spark.createDataFrame([], "doc_id long")).count() == 0
    assert license_minhash.scan(empty).count() == 0
