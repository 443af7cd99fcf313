"""Nearest neighbours by blocks against brute force."""

import numpy as np
import pytest

from alphaloom.operators import neighbours


def brute(y, x, ids, k):
    d = ((y[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    return ids[order], np.sqrt(np.take_along_axis(d, order, axis=1))


def cases():
    rng = np.random.default_rng(0)
    plain = rng.normal(size=(300, 7)).astype(np.float32).astype(np.float64)
    grid = rng.integers(0, 3, (300, 4)).astype(np.float64)  # ties
    return {"plain": plain, "ties": grid, "far from zero": 1e4 + plain * 1e-3, "all equal": np.ones((300, 3))}


@pytest.mark.parametrize("case", cases())
def test_estimates_lose_no_neighbour(case):
    x = cases()[case]
    ids = np.random.default_rng(1).permutation(len(x)) * 3
    want, far = brute(x, x, ids, 6)
    got = list(neighbours._nearest(x, x, ids, 6, rows=64, columns=50))
    assert [len(r) for r, _, _ in got] == [6 * 64] * 4 + [6 * 44]
    assert np.concatenate([n for _, n, _ in got]).reshape(-1, 6).tolist() == want.tolist()
    assert np.allclose(np.concatenate([d for _, _, d in got]).reshape(-1, 6), far)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_and_copies(spark, kind):
    x = np.vstack((cases()["plain"], np.repeat(cases()["plain"][:1], 60, axis=0)))
    rows = spark.createDataFrame([(7 * i, v) for i, v in enumerate(x.tolist())], f"id long, f array<{kind}>")
    got = neighbours.knn(rows, rows.filter("id % 2 = 0"), 4, broadcast_rows=100, query_rows=50).toPandas().sort_values(["qid", "rank"])
    ids = 7 * np.arange(len(x))
    want, far = brute(x[::2], x, ids, 4)
    assert got["id"].to_numpy().reshape(-1, 4).tolist() == want.tolist()
    assert np.allclose(got["d"].to_numpy().reshape(-1, 4), far)
