"""Sessions, periods and histories against brute force, in blocks far smaller than a key."""

import random

import pytest
from conftest import rows

from memlake.operators.history import version_history
from memlake.operators.intervals import periods_and_gaps, subject_entity
from memlake.operators.sessions import sessionize
from memlake.plans import runs
from pyspark.sql import functions as F

GAP = 1_800_000_000


@pytest.fixture(params=[5, 250_000])
def small_blocks(monkeypatch, request):
    monkeypatch.setattr(runs, "BLOCK_ROWS", request.param)


def entries(spark, data):
    return spark.createDataFrame(data, "identity string, at bigint, path string, h1 string")


def sessions_by_hand(data):
    by = {}
    for name, at, *_ in set(data):
        key = (name or "").strip(" \t").lower()
        if key and at is not None:
            by.setdefault(key, []).append(at)
    out = []
    for k, times in by.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > GAP:
                out.append((k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((k, start, last, n))
    return sorted(out, key=lambda r: [(True, str(x)) for x in r])


@pytest.mark.parametrize("group_rows", [7, 100_000])
def test_sessions_random(spark, group_rows):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", " HOT\t", "b", "", None, "  ", "ü"]), rng.choice([None, *range(0, 60 * GAP, GAP // 2)]), rng.choice(["/a", None]), None) for _ in range(400)]
    data += data[:50]
    assert rows(sessionize(entries(spark, data), "identity", "at", group_rows=group_rows)) == sessions_by_hand(data)


def test_sessions_of_one_hot_key(spark):
    rng = random.Random(5)
    at = rng.choices(range(0, 10**12, 10**6), k=3_000) + list(range(4 * 10**11, 4 * 10**11 + 10**10, 10**7))
    data = [("hot", a, "x", None) for a in at] + [("cold", a, "x", None) for a in at[:5]]
    for group_rows in (50, 700):
        assert rows(sessionize(entries(spark, data), "identity", "at", group_rows=group_rows)) == sessions_by_hand(data)


def test_sessions_edges(spark):
    data = [("a", 0, "x", None), ("a", GAP, "x", None), ("a", 2 * GAP + 1, "x", None), ("a", 2 * GAP + 1, None, "x")]
    assert rows(sessionize(entries(spark, data), "identity", "at")) == [("a", 0, GAP, 2), ("a", 2 * GAP + 1, 2 * GAP + 1, 2)]
    assert rows(sessionize(entries(spark, []), "identity", "at")) == []
    assert rows(sessionize(entries(spark, [(None, 1, "x", None)]), "identity", "at")) == []


MEM = "id string, tenant_id string, user_id string, subject string, s bigint, e bigint, v bigint, c string, entity string"


def random_memories(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(0, 60)
        e = rng.choice([None, s, s - 1, s + 1, s + 2, s + 5, s + 30])
        out.append((f"m{i}", rng.choice(["t", "t", "u", None]), rng.choice([None, "x"]), rng.choice(["Plan", " plan ", "b  c", "B\tC", None, "  "]), rng.choice([s, s, None]), e, rng.randrange(3), rng.choice(["A", "a", " A ", None]), "clash"))
    return out + out[: n // 5]


def entity_by_hand(r):
    subject = " ".join((r[3] or "").lower().split())
    return f"{r[1] or ''}|{r[2] or ''}|{subject}" if subject else None


def kept(data):
    return [r for r in {r[0]: r for r in data}.values() if entity_by_hand(r) and r[4] is not None and (r[5] is None or r[5] > r[4])]


def test_periods_random(spark, small_blocks):
    data = random_memories(300, 8)
    expect, by = [], {}
    for r in kept(data):
        by.setdefault(entity_by_hand(r), []).append((r[4], r[5] if r[5] is not None else 10**9))
    for k, xs in by.items():
        xs.sort()
        merged = [list(xs[0])]
        for s, e in xs[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        expect += [(k, "period", s, e if e < 10**9 else -1) for s, e in merged] + [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    df = spark.createDataFrame(data, MEM)
    got = rows(periods_and_gaps(df, subject_entity(), "s", "e", "id"))
    assert got == sorted(expect, key=lambda r: [(True, str(x)) for x in r])


def test_history_random(spark, small_blocks):
    data = random_memories(300, 9)
    by = {}
    for r in kept(data):
        by.setdefault(entity_by_hand(r), {}).setdefault(r[4], []).append(r)
    df = spark.createDataFrame([r for r in data if len(by.get(entity_by_hand(r), {}).get(r[4], [])) < 2], MEM)
    expect = []
    for k, starts in by.items():
        seq = [(s, g[0]) for s, g in sorted(starts.items()) if len(g) < 2]
        versions = []
        for i, (s, r) in enumerate(seq):
            end = min(r[5] if r[5] is not None else 10**9, seq[i + 1][0] if i + 1 < len(seq) else 10**9)
            c = r[7].strip() if r[7] is not None else None
            if versions and versions[-1][2] == c and versions[-1][1] == s:
                versions[-1][1] = end
            else:
                versions.append([s, end, c])
        expect += [(k, s, e if e < 10**9 else -1) for s, e, _ in versions]
    got = version_history(df, subject_entity(), [F.trim("c")], "s", "e", "v", "id")
    assert rows(got, "entity", "from_us", "to_us") == sorted(expect, key=lambda r: [(True, str(x)) for x in r])


def test_history_ties_and_empty(spark, small_blocks):
    data = [("1", "t", None, "p", 0, None, 1, "old", ""), ("2", "t", None, "p", 0, 5, 2, "new", ""), ("3", "t", None, "p", 5, 9, 1, "new", ""), ("4", "t", None, "p", 9, 12, 1, "NEW", "")]
    got = version_history(spark.createDataFrame(data, MEM), subject_entity(), [F.col("c")], "s", "e", "v", "id")
    assert rows(got, "entity", "from_us", "to_us") == [("t||p", 0, 9), ("t||p", 9, 12)]
    none = spark.createDataFrame([], MEM)
    assert rows(version_history(none, subject_entity(), [F.col("c")], "s", "e", "v", "id")) == []
    assert rows(periods_and_gaps(none, subject_entity(), "s", "e", "id")) == []
