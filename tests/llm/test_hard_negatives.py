import random

import numpy as np
import pytest
from sessionlens.llm import hard_negatives

SCHEMA = "id long, label long, vector array<long>, is_anchor boolean, shard int, `kinds` string"


def expected(rows, positives=5, negatives=3, low=50, high=95):
    out = []
    use = [r for r in rows if None not in r[:3] and None not in r[2]]
    for a in use:
        if not a[3]:
            continue
        others = [(sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in use if b[0] != a[0] and len(b[2]) == len(a[2])]
        first = lambda items, k: sorted(items, key=lambda s: (-s[0], s[1]))[:k]
        for ps, pid, _ in first([s for s in others if s[2] == a[1]], positives):
            window = [s for s in others if s[2] != a[1] and low * ps <= 100 * s[0] <= high * ps]
            out += [(a[0], pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(first(window, negatives))]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).collect())


def random_rows(rng, n, d, spread, labels):
    return [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(d)], i % 7 == 0) for i in range(n)]


@pytest.mark.parametrize(("d", "spread", "labels"), [(8, 100, 4), (3, 2, 2), (1, 5, 3), (12, 1 << 27, 40)])
def test_equals_brute_force(spark, monkeypatch, d, spread, labels):
    # Small shards, leaves and blocks: several levels, several shards, ties across them.
    for name, value in {"SHARD": 90, "LEAF": 4, "FANOUT": 3, "ANCHORS": 10, "WAVE": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = random_rows(random.Random(d), 400, d, spread, labels)
    assert mined(spark, rows) == expected(rows)


def test_rows_that_take_no_part_ties_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = random_rows(rng, 60, 4, 3, 3)
    rows += [(100 + i, 1, [3, 3, 3, 3], i < 2) for i in range(8)] + [rows[0], rows[9], (None, 1, [1, 2, 3, 4], True), (70, None, [1, 2, 3, 4], True), (77, 1, None, True), (84, 1, [1, None, 3, 4], True)]
    rows += [(200, 1, [5, 5], True), (201, 1, [4, 5], False), (202, 2, [3, 3], False), (203, 2, [], True), (204, 2, [], False), (205, 1, [], False)]
    assert mined(spark, rows) == expected(rows)
    assert mined(spark, []) == [] and mined(spark, [r for r in rows if not r[3]]) == []
    assert mined(spark, rows[:1]) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 1 << 29
    rows = [(7, 1, [big, big - 1], True), (1, 1, [big, big], False), (2, 1, [big, big - 1], False), *((10 + i, 2, [big * 3 // 4 + i % 3, big * 3 // 4 - i], False) for i in range(9))]
    assert mined(spark, rows) == expected(rows) != []


def test_nodes_are_pruned(monkeypatch):
    # Clusters: most leaves are never scored.
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 6))
    rows = np.concatenate([c + rng.integers(-5, 5, (100, 6)) for c in centres])
    order = hard_negatives.str_order(rows, hard_negatives.LEAF)
    tree = hard_negatives.Tree(order, np.zeros(len(rows), np.int64), rows[order])
    scored = []
    merge = hard_negatives.merge
    monkeypatch.setattr(hard_negatives, "merge", lambda *a: scored.append(1) or merge(*a))
    q = rows[:1]
    scores, ids = tree.search(np.array([0]), np.array([0]), q, np.full((1, 1), hard_negatives.NONE + 1), np.full((1, 1), 1 << 60), 5, True)
    want = sorted(((-(int(q[0] @ rows[i])), i) for i in range(1, len(rows))))[:5]
    assert [(-s, i) for s, i in zip(scores[0, 0].tolist(), ids[0, 0].tolist(), strict=True)] == want
    assert len(scored) < tree.leaves / 3


def test_packed_integers():
    for values in (np.array([[1, -2]]), np.array([[1 << 20, -5]]), np.array([[1 << 40, 3]]), np.zeros((3, 0), np.int64)):
        assert (hard_negatives.unpacked(hard_negatives.packed(values), len(values)) == values).all()


def test_non_finite_components_of_the_query(spark, tmp_path):
    from sessionlens.llm.queries import hard_negatives_query

    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (50, 1, [1.5, 2.0]), (1, 1, [nan, 1.0]), (2, 1, [inf, 1.0]), (3, 1, None), (4, 2, [0.9, 1.2]), (5, 2, [None, 1.0]), (6, None, [1.0, 1.0]), (8, 2, [1.0, 1.4])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v], i % 50 == 0) for i, lab, v in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(tuple(r) for r in hard_negatives_query(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == expected(whole)
