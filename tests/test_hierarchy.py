"""Hierarchies of random functional graphs in tiny blocks against a walk in Python."""

import random

import pytest
from conftest import rows

from memlake.operators import hierarchy as h


def by_hand(data):
    parent = {}
    for i, p, *_ in data:
        i, p = (i or "").strip().lower(), (p or "").strip().lower()
        if i:
            parent[i] = max(parent.get(i) or "", p)
    parent = {i: p if p in parent else None for i, p in parent.items()}
    below = {i: set() for i in parent}
    out = {}
    for i in parent:
        seen, u = [i], parent[i]
        while u is not None and u not in seen:
            seen.append(u)
            u = parent[u]
        for a in seen[1:]:
            below[a].add(i)
        if u is None:
            out[i] = (seen[-1], len(seen) - 1)
        else:
            out[i] = ("", -1 if u == i else -2)
    return sorted((i, *out[i], len(below[i])) for i in parent)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(h, "BLOCK_ROWS", 6)
    rng = random.Random(seed)
    n = 60
    names = [f"N{i}" for i in range(n)]
    data = []
    for i in range(n):
        chain = names[i - 1] if i and rng.random() < 0.7 else rng.choice([*names, None, "absent", ""])
        data.append((rng.choice([names[i], names[i].lower(), f" {names[i]} "]), rng.choice([chain, chain and chain.lower()]), rng.choice(["t1", "t1", "t2", None]), "extra"))
    data += [(names[3], None, None, "x"), (None, names[0], None, "x"), ("  ", None, None, "x"), *data[:7]]
    df = spark.createDataFrame(data, "id string, parent string, trace string, pre string")
    assert rows(h.hierarchy(df, "id", "parent", "trace")) == by_hand(data)


def test_special_shapes(spark):
    data = [("a", "a", None), ("b", "a", None), ("c", None, None), ("d", "gone", None), ("x", "y", "t"), ("y", "x", "u"), ("z", "y", "v")]
    df = spark.createDataFrame(data, "id string, parent string, trace string")
    assert rows(h.hierarchy(df, "id", "parent", "trace")) == by_hand(data)
    assert rows(h.hierarchy(df.limit(0), "id", "parent", "trace")) == []
    deep = [(f"{i:05d}", f"{i - 1:05d}" if i else None) for i in range(3000)]
    got = h.hierarchy(spark.createDataFrame(deep, "id string, parent string"), "id", "parent")
    assert got.agg({"depth": "max", "n_descendants": "max"}).first().asDict() == {"max(depth)": 2999, "max(n_descendants)": 2999}


def test_paths(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_ROWS", 6)
    rng = random.Random(5)
    data = [(f"n{i}", rng.choice([f"n{i - 1}", f"n{rng.randrange(40)}", None]) if i else None, rng.choice(["t", "u"])) for i in range(40)]
    parent = {i: p for i, p, _ in data}

    def walk(i):
        out = [i]
        while parent[out[0]] is not None:
            if parent[out[0]] in out:
                return None
            out.insert(0, parent[out[0]])
        return out

    df = spark.createDataFrame(data, "id string, parent string, trace string")
    got = {r.id: list(r.path) if r.path is not None else None for r in h.paths(df, "id", "parent", "trace").collect()}
    assert got == {i: walk(i) for i in parent}
