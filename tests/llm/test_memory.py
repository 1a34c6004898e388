"""What a task holds of its batches."""

import numpy as np
import pyarrow as pa
import pytest

from trialsift.llm.common import in_parts, text_slices
from trialsift.llm.dic_phrases import _added_up, _Tally


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_string(), pa.large_binary()])
def test_slices_equal_the_texts(kind):
    texts = ["skipped", "one two", "", None, "é 漢", "x" * 50, None]
    column = pa.array(texts, pa.string()).cast(kind).slice(1)
    found = []
    for row, end, data, offsets in text_slices(column, 10):
        raw = data.tobytes()
        assert len(offsets) == end - row + 1
        found += [raw[a:b].decode() for a, b in zip(offsets, offsets[1:])]
    assert found == [t or "" for t in texts[1:]]


def test_slices_are_the_columns_own_bytes():
    column = pa.array(["one two", "three", "four five six"] * 10)
    own = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    assert all(np.shares_memory(own, data) for _, _, data, _ in text_slices(column, 20))


def test_batches_in_parts():
    whole = pa.RecordBatch.from_arrays([pa.array(range(25))], names=["x"])
    parts = list(in_parts([whole, whole.slice(0, 0), whole.slice(3, 4)], 10))
    assert [p.num_rows for p in parts] == [10, 10, 5, 4]
    assert [x for p in parts for x in p.column("x").to_pylist()] == [*range(25), 3, 4, 5, 6]


def test_counts_travel_in_packs():
    """A row holds many phrases; the packs of a bucket add up to the whole counts."""
    n, rows = 5000, []
    phrases = pa.array([b"a%d b " % i for i in range(n)], pa.large_binary())
    hashes = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        tally = _Tally(10, 16)
        tally.add("en", 2, phrases, np.arange(n) % 12, np.ones(n, dtype=np.int8), hashes)
        rows += [r for batch in tally.flush() for r in batch.to_pylist()]
    assert len(rows) == 2 * 16
    found = {}
    for bucket in range(16):
        texts, counts = _added_up([r["pack"] for r in rows if r["bucket"] == bucket])
        found.update(zip(texts.to_pylist(), counts.tolist()))
    assert found == {b"a%d b " % i: 2 * (i % 12) for i in range(n) if i % 12}
    assert {x for r in rows for x in r["often"]} == {f"a{i} b" for i in range(n) if i % 12 >= 10}
