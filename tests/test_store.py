"""The versioned store: snapshots, killed runs, merging of layers."""

import random

import pytest

from trialsift.sources import store

SCHEMA = "k string, seq int, v int"
KW = {"key": ("k",), "order": ("seq",), "buckets": 4}


def put(spark, path, rows, schema=SCHEMA):
    return store.upsert(spark.createDataFrame(rows, schema), path, **KW)


def rows_of(df):
    return {r.k: (r.seq, r.v) for r in df.collect()}


def test_a_killed_upsert_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    put(spark, path, [("a", 1, 1), ("b", 1, 1)])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, [("a", 2, 2), ("c", 1, 1)])
    assert rows_of(store.read(spark, path)) == {"a": (1, 1), "b": (1, 1)}
    assert put(spark, path, [("c", 5, 5)]) == 2
    assert rows_of(store.read(spark, path)) == {"a": (1, 1), "b": (1, 1), "c": (5, 5)}
    assert len(store.expire(spark, path, keep=1)) >= 1  # the killed run's layers
    assert rows_of(store.read(spark, path)) == {"a": (1, 1), "b": (1, 1), "c": (5, 5)}


def test_a_draft_that_was_not_renamed_is_no_version(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, [("a", 1, 1)])
    (tmp_path / "store" / "versions" / "_draft").write_text("{")
    assert store.versions(spark, path) == [1]
    assert rows_of(store.read(spark, path)) == {"a": (1, 1)}


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, [(f"k{i}", 1, i) for i in range(20)])
    before = store.read(spark, path)
    for seq in (2, 3):
        put(spark, path, [(f"k{i}", seq, -i) for i in range(20)])
    assert rows_of(before) == {f"k{i}": (1, i) for i in range(20)} == rows_of(store.read(spark, path, version=1))
    assert rows_of(store.read(spark, path)) == {f"k{i}": (3, -i) for i in range(20)}
    with pytest.raises(ValueError):
        store.read(spark, path, version=9)


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, [("a", 1, 1)])
    held = store._read_version(spark, path)
    with pytest.raises(RuntimeError):
        store.commit(spark, path, held)


def test_many_upserts_equal_a_plain_table_and_rewrite_little(spark, tmp_path):
    path, draw, want = str(tmp_path / "store"), random.Random(2), {}
    for _ in range(12):
        batch = {f"k{draw.randrange(60)}": (draw.randrange(9), draw.randrange(99)) for _ in range(draw.randrange(1, 9))}
        put(spark, path, [(k, *v) for k, v in batch.items()])
        for k, v in batch.items():
            if k not in want or v[0] >= want[k][0]:
                want[k] = v
    assert rows_of(store.read(spark, path)) == want
    layers = store._read_version(spark, path).layers
    sizes = [layer["rows"] for layer in layers]
    assert sizes == sorted(sizes, reverse=True) and len(layers) <= 6
    version = store.versions(spark, path)[-1]
    assert put(spark, path, []) == version and store.versions(spark, path)[-1] == version


def test_empty_store_and_other_settings(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        store.read(spark, path)
    put(spark, path, [("a", 1, None), (None, 1, 3), (None, 2, 4)])
    assert rows_of(store.read(spark, path)) == {"a": (1, None), None: (2, 4)}
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([("a", 1, 1)], SCHEMA), path, ("k",), ("v",), 4)
