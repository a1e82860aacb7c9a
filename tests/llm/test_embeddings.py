"""Tiled comparison against all pairs."""

import numpy as np
import pytest

from sessionlens.llm import tiled_cosine as T

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.98):
    n = len(rows)
    parent, links = list(range(n)), np.zeros(n, int)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def usable(v, label):
        return v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a == b and usable(v, a) and usable(w, b) and len(v) == len(w):
                v, w = np.array(v), np.array(w)
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return {rows[i][0]: (int(links[i]), least[find(i)]) for i in range(n)}


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))
    vectors = [(base[rng.integers(4)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])).tolist() for _ in range(150)]
    rows = [(i, v, int(rng.integers(2))) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0, None], 1), (1005, vectors[0], None), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (1008, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS component")
    got = {r.vec_id: (r.n_links, r.component_id) for r in T.linked(df, tile=37).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (7, [1.0, 0.01], 1), (7, [0.0, 1.0], 1), (9, [0.01, 1.0], 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in T.linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0, -1, True), (4, 2, 4, True), (4, 2, 4, True), (7, 1, 4, False), (7, 2, 4, False), (9, 1, 4, False)]
    assert T.linked(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("d", [3, 8, 40])
def test_close_pairs_drops_nothing(d):
    rng = np.random.default_rng(d)
    a, b = (T.unit(rng.normal(size=(60, d)) + 2) for _ in range(2))
    i, j, c = T.close_pairs(a, b, 0.9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(a @ b.T >= 0.9)), strict=True))
    assert np.allclose(c, (a @ b.T)[i, j])
