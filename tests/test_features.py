"""Feature tables against a dictionary."""

import json
import random
import re

from conftest import rows

from memlake.operators.features import entity_features, feature_columns, json_units, scatter
from pyspark.sql import functions as F
import numpy as np

SCHEMA = "id string, source string, event_type string, at bigint, payload string, key string, n string, entity string"


def units_by_hand(payload):
    try:
        doc = json.loads(payload or "")
    except ValueError:
        return 0
    v = doc.get("units") if isinstance(doc, dict) else None
    if isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d+\s*", v):
        v = int(v)
    return v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else 0


def test_units(spark):
    payloads = ['{"units":3}', '{"units": " +12 "}', '{"units":null}', '{"units":2.5}', '{"units":3.0}', '{"units":1e2}', '{"units":true}', '{"units":5,"no', '{"units":5} x', '[{"units":1}]', None, "", " ", "units", '{"x":{"units":9}}', '{"x":{"units":9},"units":7}',
                '{"units":9223372036854775807}', '{"units":9223372036854775808}', '{"units":"-9223372036854775808"}', '{"units":[1]}', '{"units":{"a":1}}', '{"\\u0075nits":4}', ' {"units":"12x"}', '{"units":"1 2"}', '"units"', '{"Units":1}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = [r.u for r in df.orderBy("i").select(json_units(F.col("p")).alias("u")).collect()]
    assert got == [units_by_hand(p) for p in payloads]


def by_hand(data):
    one, loose = {}, []
    for r in data:
        r = r[:6]
        if r[0] is None:
            loose.append(r)
        elif r[0] in one:
            one[r[0]] = tuple(max((x for x in (a, b) if x is not None), default=None) for a, b in zip(one[r[0]], r))
        else:
            one[r[0]] = r
    keyed, events = {}, list(loose)
    for r in one.values():
        if r[5] is None:
            events.append(r)
        else:
            order = (r[3] is None, r[3] or 0, r[0])
            if r[5] not in keyed or order < keyed[r[5]][0]:
                keyed[r[5]] = (order, r)
    events += [r for _, r in keyed.values()]
    out = {}
    for i, s, k, at, p, _ in events:
        if s is None or k is None:
            continue
        c = out.setdefault((s, k.strip(" \t").lower()), [0, None, 0])
        c[0] += 1
        c[1] = at if c[1] is None else c[1] if at is None else max(at, c[1])
        c[2] += units_by_hand(p)
    return sorted(((*k, *v) for k, v in out.items()), key=lambda r: [(x is not None, str(x)) for x in r])


def test_random(spark):
    rng = random.Random(1)
    payloads = ['{"units":3}', '{"units":"12"}', '{"units":null}', '{"units":2.5}', '{"units":true}', '{"units":5,"no', "[]", None, "", '{"x":{"units":9}}', json.dumps({"units": -(2**40)})]
    data = [(f"e{i}", rng.choice(["hot", "hot", "s1", None]), rng.choice(["A.b", " a.B\t", "c", None]), rng.choice([None, rng.randrange(10**15)]), rng.choice(payloads), rng.choice([None, None, f"k{i % 40}"]), "x", "y") for i in range(300)]
    data += [(r[0], r[1], None, r[3], r[4], None, "x", "z") for r in data[:60]]
    got = entity_features(spark.createDataFrame(data, SCHEMA), "source", "event_type", "at", "payload", "id", "key")
    assert rows(got) == by_hand(data)


def test_null_ids_and_empty(spark):
    data = [(None, "s", "k", 5, '{"units":1}', None, "", ""), (None, "s", "k", 5, '{"units":1}', None, "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    args = ("source", "event_type", "at", "payload", "id", "key")
    assert rows(entity_features(df, *args)) == [("s", "k", 2, 5, 2)]
    assert rows(entity_features(df.limit(0), *args)) == []


def test_columns(spark):
    cells = spark.createDataFrame([("a", "x", 2, 7, 3), ("a", "z", 1, None, 0), ("b", "y", 4, 9, 1)], "entity string, kind string, n bigint, last_us bigint, total bigint")
    got = {r.entity: (list(r.n), list(r.last_us), list(r.total)) for r in feature_columns(cells, ["x", "y"]).collect()}
    assert got == {"a": ([2, 0], [7, None], [3, 0]), "b": ([0, 4], [None, 9], [0, 1])}


def test_scatter_is_exact():
    big = np.array([2**62, -(2**62), 2**53 + 1, 1], np.int64)
    n, last, total = scatter(np.array([0, 0, 1, 1]), 2, np.ones(4, np.int64), np.array([3, 9, -5, -7]), big)
    assert n.tolist() == [2, 2] and last.tolist() == [9, -5] and total.tolist() == [0, 2**53 + 2]
