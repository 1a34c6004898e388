"""Operators with learned parts, token ids or vectors."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, nothing
from trialsift.llm import ann_forest, byte_cnn, cube_mix, drr_packing, feistel_order, zstd_lang
from trialsift.llm.tokens import encoder, tokenizer_path
from trialsift.session import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_words_are_encoded_as_whole_texts_are():
    coder = encoder(tokenizer_path())
    texts = ["", "a", " a", "a ", "a  b", "x\n\ny", "x\ny z", "don't stop\n'tis", "a　b c", "a\tb", "x\n y", "é 漢字 🙂🙂", "a\0b c"]
    want = [np.array(x.ids, dtype="<u2").tobytes() for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want and coder.encode(texts) == want


def test_packing_round_trip(spark, docs):
    rows = drr_packing.pack(docs, size=256).collect()
    ids = encoder(tokenizer_path()).encode([r.text or "" for r in docs.collect()])
    want = sorted((x + b"\1\0") for x in ids)
    got, pieces = [], {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert len(r.ids) == 2 * r.length
    for (doc, n), parts in pieces.items():
        parts.sort(key=lambda r: (r.start, r.sequence_id))
        copies = sum(r.start == 0 for r in parts)
        for c in range(copies):  # repeated rows are packed each
            own = parts[c::copies] if copies > 1 and len(parts) % copies == 0 else parts
            if copies == 1:
                assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
                got.append(b"".join(r.ids for r in own))
    assert sum(r.length for r in rows) == sum(len(x) // 2 for x in want)
    assert all(x in want for x in got)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    last = max(windows)
    for number, spans in windows.items():
        spans.sort()
        assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
        assert number == last or sum(n for _, n in spans) == 256
    assert drr_packing.pack(nothing(spark)).count() == 0


def test_rounds_share_every_window():
    totals = [5, 0, 12345, 777, 1, 40000]
    rounds = drr_packing.Rounds(totals, 64)
    n = sum(totals)
    w = np.arange(rounds.windows + 1)
    sent = np.stack([rounds.taken(q, w)[1] for q in range(len(totals))])
    assert (np.diff(sent, axis=1) >= 0).all() and (sent.sum(axis=0) == np.minimum(64 * w, n)).all()
    assert sent[:, -1].tolist() == totals
    assert np.abs(sent - np.outer(totals, np.minimum(64 * w, n)) / n).max() < 3
    huge = drr_packing.Rounds([10**13, 3 * 10**13], 2048)
    assert huge.taken(1, np.array([10**9]))[1][0] == 3 * 2048 * 10**9 // 4


def test_training_order(spark, docs):
    for n in (1, 2, 3, 1000, 4097):
        slots = feistel_order.permuted(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    path = scratch_path(spark, "test-shards")
    n = feistel_order.write_shards(docs, path, length=64, per_shard=32)
    rows = sorted(feistel_order.read_records(spark, path).collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in rows] == list(range(n)) == sorted(r.slot for r in rows)
    stream = b"".join(r.ids for r in rows)
    ids = encoder(tokenizer_path()).encode([r.text or "" for r in docs.collect()])
    assert len(stream) == sum(len(x) + 2 for x in ids)
    assert all(x + b"\1\0" in stream for x in ids)
    assert feistel_order.read_records(spark, path, from_slot=70).count() == n - 70
    again = scratch_path(spark, "test-shards")
    feistel_order.write_shards(nothing(spark), again)
    assert feistel_order.read_records(spark, again).count() == 0


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("x"))
    small = {(r.doc_id): r for r in cube_mix.mix(docs, block=40).collect()}
    by = {}
    for r in small.values():
        t = by.setdefault(r.source, [r.target, 0, r.source_size, []])
        t[1] += r.copies * r.size
        t[3].append(r.size)
        assert 0 <= r.copies <= 2
    for target, taken, size, sizes in by.values():
        assert abs(target - taken) <= max(sizes) / 2 + 1e-6 and target <= 2 * size + 1e-6
    assert abs(sum(t[0] for t in by.values()) - 1.5 * sum(t[2] for t in by.values())) < 1e-3
    again = {r.doc_id: r for r in cube_mix.mix(docs, block=40).collect()}
    assert again == small


def test_mix_edge_cases(spark, docs):
    rows = cube_mix.mix(docs).collect()
    assert sum(r.rows for r in rows) == docs.count()
    assert all(r.copies == 0 for r in rows if r.size == 0)
    mixed = cube_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.rows * r.copies for r in rows)
    assert cube_mix.mix(nothing(spark)).count() == 0


def test_source_targets_fill(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, size long")
    got = {r.source: r.target for r in cube_mix.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3; 1740 words: c and None and a stop at twice their size, b takes the rest
    assert got == {"a": 200.0, "c": 20.0, None: 100.0, "b": 1420.0}


def test_language(spark, docs):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    learned = zstd_lang.learn(train)
    found = zstd_lang.classify(train, learned).where(zstd_lang.held_out(3, 1))
    assert found.where("lang = lang_pred").count() > 0.98 * found.count()
    rows = zstd_lang.classify(docs.drop("score", "lang_pred"), learned).collect()
    empty = [r for r in rows if not r.text or not r.text.strip()]
    assert empty and all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in empty)
    assert all(r.lang_pred in learned and 0 <= r.score <= 1 for r in rows if r.text and r.text.strip() and "###" not in r.text)
    assert all(r.lang_pred == "und" for r in zstd_lang.classify(docs.select("doc_id", "text"), {}).collect())
    assert zstd_lang.keep_identified(docs).columns == docs.columns
    assert zstd_lang.keep_identified(nothing(spark)).count() == 0


def test_quality_network(spark, docs):
    draw = np.random.default_rng(0)
    good = [("the and of was ing " * int(draw.integers(2, 200))).encode() for _ in range(60)]
    bad = [("THE!! $$$ ### " * int(draw.integers(2, 200))).encode() for _ in range(60)]
    net = byte_cnn.Network().fit(good + bad, np.array([1.0] * 60 + [0.0] * 60, dtype=np.float32), epochs=6)
    data = np.frombuffer(b"".join(good + bad), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in good + bad]))
    scores = net.score(data, offsets)
    assert (scores[:60] > 0.5).all() and (scores[60:] < 0.5).all()
    long = np.frombuffer(good[0] * 4000, dtype=np.uint8)
    assert abs(byte_cnn._long_score(net, long) - net.score(long, np.array([0, len(long)]))[0]) < 0.02
    rows = byte_cnn.with_scores(docs.drop("score"), net.dumps()).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (5, 6)}
    assert len(same) == 1
    assert byte_cnn.with_scores(nothing(spark), net.dumps()).count() == 0


def test_gradients_are_right():
    net = byte_cnn.Network(seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = [b"abc abc abc abc hello world" * 60, b"x", b"quite other bytes 1234 !!" * 3]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.score(data, offsets)
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    g = net.gradients(data, offsets, target)
    for name in ("filters", "dense", "last", "embed"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, h = net.p[name][i], 1e-5
        net.p[name][i] = old + h
        up = loss()
        net.p[name][i] = old - h
        down = loss()
        net.p[name][i] = old
        assert abs((up - down) / (2 * h) - g[name][i]) < 1e-3 * max(1, abs(g[name][i])), name


def test_neighbours(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 8)).astype(np.float32)
    x[100:140] = x[0]  # copies
    x[140:150] = 2 * x[1]  # same direction
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(1000, None, "z"), (1001, [0.0] * 8, "z"), (1002, [float("nan")] * 8, "z"), (1003, [1.0, None] * 4, "z")]
    rows += [(1004, [1.0, 2.0], "z"), (None, x[3].tolist(), "z"), (5, x[5].tolist(), "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = ann_forest.neighbours(table, F.col("vec_id") % 50 == 0, least=10**9).collect()  # all are candidates: exact
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(axis=1))
    for q in range(0, 600, 50):
        score = y @ y[q] / norm / norm[q]
        score[q] = -2
        best = sorted(range(600), key=lambda i: (-round(score[i], 12), i))[:5]
        own = sorted((r.rank, r.vec_id, round(r.score, 12)) for r in found if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert [round(score[i], 12) for i in best] == [r[2] for r in own]
        if q == 0:
            assert [r[1] for r in own] == [100, 101, 102, 103, 104]
    assert {r.query_id for r in found} == set(range(0, 600, 50))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_forest.neighbours(empty, F.lit(True)).count() == 0


def test_forest_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann_forest.neighbours(vectors, F.col("vec_id") % 50 == 0, least=100).toPandas()
    x = vectors.toPandas().sort_values("vec_id")
    y = np.stack(x["embedding"].to_numpy()).astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    hit = 0
    for q, rows in found.groupby("query_id"):
        score = y @ y[q]
        score[q] = -2
        hit += len(set(np.argsort(-score)[:5]) & set(rows["vec_id"]))
    assert hit >= 0.9 * 5 * found["query_id"].nunique()


def test_checksums_match(spark, docs):
    plain = drr_packing.pack(docs.where("doc_id < 5"))
    sums = drr_packing.pack(docs.where("doc_id < 5"), checksums=True)
    want = {(r.doc_id, r.start): zlib.crc32(np.frombuffer(r.ids, dtype="<u2").astype("<u4").tobytes()) for r in plain.collect()}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in sums.collect()} == want
