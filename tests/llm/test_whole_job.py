"""Cases that an operator once left out."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, prose
from tests.llm.test_text_operators import _shingles
from trialsift.llm import drr_packing, trie_join
from trialsift.llm.common import pack48, unpack48


def test_one_row_of_each_component_stays(spark):
    base, alone, other = prose(1, 120), prose(21, 80), prose(22, 80)
    near = base + " end"
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),  # an equal row
        (2, near, "en", "a", 1),
        (2, alone, "en", "a", 1),  # another text of an id that has a near copy
        (None, other, "en", "a", 1),  # exact copies without an id
        (None, other, "en", "a", 1),
        (None, other, "en", "b", 1),
        (None, near, "en", "a", 1),
        (3, None, "en", "a", 1),  # without a word: each row stays
        (3, None, "en", "a", 1),
        (4, "", None, "a", 1),
        (5, "a b", "en", "b", 1),
        (5, "a b", "en", "a", 1),  # one id and text, two sources
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.text) for r in trie_join.keep_one_each(docs).collect())
    assert got == Counter({(1, base): 1, (2, alone): 1, (None, other): 1, (3, None): 2, (4, ""): 1, (5, "a b"): 1})


def test_every_source_has_its_queue(spark):
    """One source of half the ids among 1,100: every window holds its half."""
    rows = [(i, prose(i, 12), f"small{i}") for i in range(1100)]
    rows += [(2000 + i, prose(i, 1100), "large") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = drr_packing.pack(docs, size=512).collect()
    assert {r.queue for r in got} == {"slarge", *(f"ssmall{i}" for i in range(1100))}
    total = sum(r.length for r in got)
    large, fill = Counter(), Counter()
    for r in got:
        fill[r.sequence_id] += r.length
        large[r.sequence_id] += r.length * (r.queue == "slarge")
    share = sum(large.values()) / total
    assert all(fill[w] == 512 for w in range(max(fill)))
    assert all(abs(large[w] - 512 * share) < 12 for w in range(max(fill)))
    spans = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_targets_hold_while_queues_last(spark):
    totals = [5000, 0, 20000, 700, 3000]
    rounds = drr_packing.Rounds(totals, 64, [0.5, 1, 0.25, 0, 0.25])
    w = np.arange(rounds.windows + 1)
    sent = np.stack([rounds.taken(q, w)[1] for q in range(5)])
    ahead = np.stack([rounds.taken(q, w)[0] for q in range(5)])
    assert (np.diff(sent, axis=1) >= 0).all() and sent[:, -1].tolist() == totals
    assert (ahead == np.cumsum(sent, axis=0) - sent).all()
    both = np.flatnonzero(64 * w <= 10_000)  # until the first queue of the targets is empty
    assert np.abs(sent[:, both] - np.outer([0.5, 0, 0.25, 0, 0.25], 64 * w[both])).max() < 4
    assert (sent[3, 64 * w <= 28_000] == 0).all()
    docs = spark.createDataFrame([(i, prose(i, 300), "ab"[i % 2] if i else None) for i in range(9)], "doc_id long, text string, source string")
    got = drr_packing.pack(docs, size=256, targets={"a": 3, "b": 1}).where("sequence_id < 2").groupBy("queue").sum("length").collect()
    part = {r[0]: r[1] for r in got}
    assert set(part) == {"sa", "sb"} and abs(part["sa"] - 3 * 128) < 4


def test_no_link_is_lost(spark):
    """A family of mutual near copies larger than a block, some of them exact copies, beside other texts."""
    base = prose(31, 100).split(" ")
    texts = [" ".join([*base[: i % 97], f"new{i}", *base[i % 97 + 1 :]]) for i in range(trie_join.BLOCK + 20)]
    texts += [texts[0], texts[0], prose(32, 60), prose(32, 60) + " end", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_shingles(t) for t in texts]
    want = {i: sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert max(want.values()) > trie_join.BLOCK
    assert {r.doc_id: r.n_links for r in trie_join.document_links(docs).collect()} == want


@pytest.mark.parametrize("buckets", [64, 1 << 16, 1 << 17, 1 << 20])
def test_packed_hashes_are_restored_by_their_bucket(buckets):
    """More buckets than 16 bits can number, as above about 130 billion shingles."""
    grams = np.random.default_rng(1).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    bucket = trie_join._bucket_of(grams, buckets)
    assert 0 <= bucket.min() and bucket.max() < buckets and len(np.unique(bucket)) > min(buckets, 15_000) * 0.9
    packed = unpack48(pack48(grams))
    back = np.array([trie_join._restored(packed[i : i + 1], int(bucket[i]), buckets)[0] for i in range(len(grams))])
    assert (back == (grams & trie_join._known_bits(buckets))).all()
