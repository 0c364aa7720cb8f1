"""The forest against brute force, and its parts."""

import numpy as np
from pyspark.sql import functions as F

from memlake.llm import forest as f

SCHEMA = "id string, v array<float>, key bigint, a int"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n - 3, 3):
        x[i + 1] = x[i] + 0.2 * rng.standard_normal(dim)
        x[i + 2] = x[i] + 0.05 * rng.standard_normal(dim)
    return x.astype(np.float32)


def pairs_by_hand(x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i])[:k]:
            if s[i, j] >= least:
                out.add((min(f"{i:05d}", f"{j:05d}"), max(f"{i:05d}", f"{j:05d}")))
    return out


def test_recall_with_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(f, "PART_ROWS", 500)
    x = clustered(1500, 32, 1)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), 1, 2) for i, v in enumerate(x)], SCHEMA)
    got = {tuple(r) for r in f.similar_pairs(df, "id", "v", 32, trees=12, leaf=100).collect()}
    want = pairs_by_hand(x, 10, 0.85)
    assert len(got & want) >= 0.95 * len(want)
    assert not got - want


def test_all_neighbours_exact_in_one_range(spark):
    x = clustered(300, 16, 2)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), 1, 2) for i, v in enumerate(x)], SCHEMA)
    got = {(min(r.id, r.other), max(r.id, r.other)) for r in f.nearest(df, "id", "v", 16).collect()}
    want = pairs_by_hand(x, 10, -1)
    assert len(got ^ want) <= 0.01 * len(want)


def test_unusable_repeated_and_equal(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    data = [("a", one, 1, 1), ("a", one, 2, 2), ("b", [2.0, 0.0, 0.0, 0.0], 1, 1), ("c", [0.0] * 4, 1, 1), ("d", [1.0, float("nan"), 0.0, 0.0], 1, 1), ("e", [1.0] * 3, 1, 1), ("f", None, 1, 1), (None, one, 1, 1), ("g", [1.0, None, 0.0, 0.0], 1, 1), ("h", [float("inf"), 0.0, 0.0, 0.0], 1, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    assert [tuple(r) for r in f.similar_pairs(df, "id", "v", 4).collect()] == [("a", "b")]
    assert f.similar_pairs(df.filter(F.lit(False)), "id", "v", 4).collect() == []


def test_hot_group_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(f, "PART_ROWS", 100)
    rng = np.random.default_rng(3)
    x = np.vstack([np.tile(rng.standard_normal(16), (200, 1)), rng.standard_normal((300, 16))]).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), 1, 2) for i, v in enumerate(x)], SCHEMA)
    got = f.nearest(df, "id", "v", 16, least=0.99, leaf=40).groupBy("id").count().filter("id < '00200'").collect()
    assert len(got) == 200 and all(r["count"] == 10 for r in got)


def test_ranges_cover_all():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 3, (1000, f.SYMBOLS + f.KEY_BYTES)).astype(np.uint8)
    s = s[np.lexsort(s.T[::-1])]
    parts = sorted(f.ranges(f.lcp(s), len(s), 50))
    assert parts[0][0] == 0 and parts[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and max(b - a for a, b in parts) <= 50


def test_neighbouring_ranges_meet():
    rng = np.random.default_rng(6)
    x = f.unit(f.quantised(rng.standard_normal((60, 8))))
    keys = np.arange(60) * 7
    leaves, vectors = np.split(keys, [13, 20, 45]), np.split(x, [13, 20, 45])
    for least in (-1.0, 0.3):
        got = {}
        for a, b, sim in f.neighbours(leaves, vectors, [True, False, True], 4, least):
            for i, j, s in zip(a.tolist(), b.tolist(), sim.tolist()):
                got.setdefault(i // 7, []).append((-round(s, 5), j // 7))
        for i in range(60):
            part = range(0, 20) if i < 20 else range(20, 60)
            s = sorted((-round(float(x[i] @ x[j]), 5), j) for j in part if j != i and x[i] @ x[j] >= least)[:4]
            assert [v for v, _ in sorted(got.get(i, []))] == [v for v, _ in s]
