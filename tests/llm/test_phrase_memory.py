"""What a task of the phrases operator holds while it sorts its keys."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import phrases


def block(rng, n, n_words):
    codes = rng.integers(1, n_words, n, dtype=np.int32)
    pairs = np.arange(1, n_words, dtype=np.int64) << 32 | np.arange(1, n_words)
    columns = [pa.array([0]), pa.array([n], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([pairs])]
    return pa.RecordBatch.from_arrays(columns, names=["block", "own", "codes", "ids"]), codes


@pytest.mark.parametrize("n_words", [40, 1 << 17])
def test_dealt_runs_are_the_sorted_windows(n_words):
    rng = np.random.default_rng(3)
    batch, codes = block(rng, 30_000, n_words)
    borders = np.array([[n_words // 3, 2, 0, 0], [n_words // 2, 1, 1, 1]], np.uint32)
    found, last = {}, ()
    for rows in phrases._deal(borders)(iter([batch])):
        at, size, packed = (c[0].as_py() for c in rows.columns)
        keys, n = phrases._unpacked(size, packed)
        assert all(tuple(borders[k]) <= tuple(key) for k in range(at) for key in keys[:1].tolist())
        for key, count in zip(map(tuple, keys.tolist()), n.tolist(), strict=True):
            assert key not in found and key > last
            found[key] = count
            last = key
    row = [*codes.tolist(), 0, 0, 0]
    wanted = {}
    for i in range(len(codes) - 1):
        key = tuple(row[i : i + 4])
        wanted[key] = wanted.get(key, 0) + 1
    assert found == wanted


def test_keys_are_held_less_than_four_times():
    rng = np.random.default_rng(4)
    batches = [block(rng, 1 << 19, 1 << 17)[0] for _ in range(4)]
    run = phrases._deal(np.array([[1000, 0, 0, 0], [90_000, 5, 0, 0]], np.uint32))
    tracemalloc.start()
    for _ in run(iter(batches)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 16 * (1 << 21), peak
