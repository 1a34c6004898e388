"""Operators 11 and 13 against the tokenizers library and a plain clustering in Python integers."""

import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, nothing
from trialsift.llm import bpe_tree, pieces
from trialsift.llm.bpe_tree import detokenize, op11_bpe_tree, tokenize, vocabulary
from trialsift.llm.centroid_dots import LARGEST, clustered
from trialsift.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(tokenizer_path())
ODD = [
    "",
    "it's we'll 'sx they've I'd '",
    "  's  a",
    "<|endoftext|>",
    "a <|endoftext|>  b\n",
    "<|endof<|endoftext|>text|>",
    "x" * 1500,
    " " * 900,
    "   é́ 漢字1２٣! \x85\x1c\t\r\n",
]


def library_ids(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def own_ids(texts):
    out = [[] for _ in texts]
    for row, ids, bounds in vocabulary(tokenizer_path()).encode([t.encode() for t in texts]):
        for k, (a, b) in enumerate(zip(bounds, bounds[1:]), row):
            out[k] += ids[a:b].tolist()
    return out


@pytest.mark.parametrize(("window", "long_piece"), [(1 << 20, 256), (64, 256), (1 << 20, 1)])
def test_odd_texts_equal_the_library(monkeypatch, window, long_piece):
    """Small windows stand for texts longer than one; a long piece has a tree of its own."""
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(bpe_tree, "LONG_PIECE", long_piece)
    vocabulary(tokenizer_path()).remembered.clear()
    draw = random.Random(5)
    parts = ["<|endoftext|>", " ", "  ", "'s", "'re", "'", "hello", "ll", "\n", "12", "𐍈", "!?", "ß", "\x00"]
    texts = ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(500)]
    assert own_ids(texts) == library_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_any_text_equals_the_library(texts):
    assert own_ids(texts) == library_ids(texts)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op11_bpe_tree(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, ids in zip(docs, library_ids([d["text"] or "" for d in docs])):
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want = (doc["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(back.encode()))
        assert tuple(got[doc["doc_id"]]) == want


def test_every_row_round_trips(spark):
    docs = documents(spark)
    long = "word é " * 400_000
    docs = docs.unionByName(spark.createDataFrame([(90, long)], "doc_id long, text string"), allowMissingColumns=True)
    found = tokenize(docs, tokenizer_path(), decoded=True, digests=True)
    want = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.select("doc_id", "text").collect())
    rows = found.collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in rows) == want
    for r in rows:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == sha(",".join(map(str, r["ids"])).encode())
        assert r["decoded_sha256"] == sha(r["decoded"].encode())
    again = detokenize(found, tokenizer_path()).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in again) == want


def test_bytes_that_are_no_text_and_unknown_ids(spark):
    cut = library_ids(["漢"])[0][:1]
    rows = spark.createDataFrame([(1, cut), (2, None), (3, []), (4, [50256, None, 10**6])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in detokenize(rows, tokenizer_path()).collect()}
    assert got == {1: LIBRARY.decode(cut, skip_special_tokens=False), 2: None, 3: "", 4: "<|endoftext|>"}


def test_empty_table_has_no_tokens(spark):
    assert tokenize(nothing(spark), tokenizer_path(), decoded=True, digests=True).count() == 0


# -- clustering ---------------------------------------------------------------------------------------------------


def plain(rows, clusters, rounds, dimension):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v):
            kept.append((vec_id, [max(-LARGEST, min(LARGEST, math.floor(64.0 * c))) for c in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}".encode()), r[1]))[:clusters]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    own = {}
    for _, j, d in found:
        own[j] = own.get(j, 0) + d
    total = sum(own.values())
    return sorted(
        ((i, j, d, own[j], total, sha(",".join(map(str, centroids[j])).encode())) for i, j, d in found),
        key=lambda r: (r[0] is None, r),
    )


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("x", "dots", "cluster", "distance", "key", "n", "total", "inertia"):
        df = df.withColumn(name, F.lit("other"))
    return df


def columns(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


def test_clusters_equal_plain_ones(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    rows += [(i % 40, [draw.choice([-0.25, 0.0, 0.25]) for _ in range(6)]) for i in range(200)]  # ties and shared ids
    rows += [rows[7]] * 30  # repeated rows
    rows += [(None, [0.1] * 6), (900, None), (901, [0.1] * 5), (902, [0.1] * 5 + [None]), (903, [float("nan")] * 6)]
    rows += [(904, [float("inf")] * 6), (905, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0])]
    got = clustered(frame(spark, rows).repartition(5), clusters=8, rounds=3, dimension=6)
    assert columns(got) == plain(rows, 8, 3, 6)


def test_fewer_rows_than_clusters_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, -0.01])]
    assert columns(clustered(frame(spark, rows), clusters=8, dimension=2)) == plain(rows, 8, 3, 2)
    none = clustered(frame(spark, rows), dimension=3)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
