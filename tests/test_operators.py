"""The engine's own operators on small tables."""

import hashlib
from datetime import datetime, timedelta

import hypothesis.strategies as some
import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from memlake.functions import scalars as sc
from memlake.functions import text as tx
from memlake.operators import graph as g
from memlake.operators import joins as j
from memlake.operators import memory as m
from memlake.operators import retrieval as r
from memlake.operators import state as st
from memlake.operators import vector as v
from memlake.plans import runs
from memlake.queries import memory as queries

few = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_tokenize_and_stem(spark):
    assert one(spark, tx.tokenize(F.lit("The cars were Running: agencies, classes, status! ÉTÉ 42"))) == ["car", "runn", "agency", "classe", "status", "été", "42"]
    assert one(spark, tx.tokenize(F.lit(None).cast("string"))) == []


@few
@given(some.text(max_size=30))
def test_subject_is_idempotent(spark, s):
    once = one(spark, tx.normalize_subject(F.lit(s)))
    assert one(spark, tx.normalize_subject(F.lit(once))) == once


def test_scalars(spark):
    import uuid

    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, sc.uuid5_text(F.lit(ns), F.lit("a|b|ü"))) == str(uuid.uuid5(uuid.UUID(ns), "a|b|ü"))
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+02:00", "2024-01-02 03:04:05.123456", "2024-01-02 03:04:05", "nonsense", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(sc.parse_ts(F.col("t"))).alias("u")).collect()
    base = 1704164645_000000
    assert [x.u for x in got] == [base, base - 7200_000000 + 250000, base + 123456, base, None, None]
    assert sc.tenant_view_name("episodic", "A-b") != sc.tenant_view_name("episodic", "a_b")
    assert one(spark, sc.scope_key(F.lit(""), F.lit(None), F.lit("a"), F.lit(None))) == "default\u001f\u001fa\u001f"


def test_ring_moves_little():
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(400)]
    moves = sc.HashRing(4).moves(sc.HashRing(5), keys)
    assert 0 < len(moves) < 200 and all(to == 4 for _, _, to in moves)
    plan = sc.scale_plan(1, 3, keys)
    assert plan["direction"] == "down" and plan["remove"] == [1, 2] and {t for _, _, t in plan["moves"]} == {0}
    assert sc.HashRing(1).shard("x") == 0


DOCS = [("d1", "software engineering job at a bank"), ("d2", "likes pizza and pasta"), ("d3", "a job interview tomorrow"), ("d4", None)]


def test_bm25(spark):
    d = spark.createDataFrame(DOCS, "id string, content string")
    top = r.bm25(d, "software engineering job").orderBy(F.desc("score")).collect()
    assert [x.id for x in top] == ["d1", "d3"]
    q = spark.createDataFrame([("q", "software engineering job"), ("n", "the of")], "qid string, query string")
    batch = {x.id: x.score for x in r.bm25_batch(d, q).collect()}
    assert batch == pytest.approx({x.id: x.score for x in top})
    assert r.bm25(d, "the").collect() == []


@pytest.mark.parametrize("rare", [0, 3, 200])
def test_bm25_top_ranks_as_all_pairs_do(spark, monkeypatch, rare):
    monkeypatch.setattr(r, "RARE_TERM", rare)
    rng = np.random.default_rng(rare)
    words = ["project", "status", "owner", "badge", "desk", *[f"n{i}" for i in range(12)]]
    text = lambda n: " ".join(rng.choice(words, n, p=[0.2, 0.15, 0.1, 0.1, 0.09, *[0.03] * 12]))
    docs = [(f"d{i:03d}", text(int(rng.integers(1, 6)))) for i in range(200)] + [("e1", None), ("e2", "filler only"), ("e3", "project " * 9), ("e4", "")]
    asked = [(f"q{i}", text(int(rng.integers(1, 4)))) for i in range(25)] + [("same", "project status"), ("again", "status of the PROJECT"), ("none", "the of"), ("strange", "zebra"), ("blank", None)]
    d, q = spark.createDataFrame(docs, "id string, content string"), spark.createDataFrame(asked, "qid string, query string")
    want = {}
    for x in sorted(r.bm25_batch(d, q).collect(), key=lambda x: (-round(x.score, 12), x.id)):
        want.setdefault(x.qid, []).append((x.id, pytest.approx(x.score)))
    got = {}
    for x in sorted(r.bm25_top(d, q, 4).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.qid, []).append((x.id, x.score))
    assert got == {k: v[:4] for k, v in want.items()} and {"same", "again"} <= got.keys() and not {"none", "strange", "blank"} & got.keys()
    assert r.bm25_top(d.limit(0), q, 4).collect() == [] and r.bm25_top(d, q.limit(0), 4).collect() == []


def rows_out(plan) -> list[int]:
    """The numbers of rows that the steps of a plan put out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return sum(map(rows_out, below), [int(own.get().value())] if own.isDefined() else [])


def test_recall_makes_no_pair_of_every_question_and_memory(spark, tmp_path):
    subject = F.concat(F.lit("project no"), F.col("n"), F.lit(" status"))
    mem = spark.range(2000).withColumnRenamed("id", "n").select(F.concat(F.lit("m"), F.col("n")).alias("id"), F.lit(queries.TENANT).alias("tenant_id"), subject.alias("subject"), F.concat(subject, F.lit(" is open")).alias("content"))
    mem.write.parquet(f"{tmp_path}/memories.parquet")
    got = queries.h12_recall(spark, str(tmp_path))
    assert tuple(got.first()) == (1.0, 1.0, 1.0, 1.0)
    got.collect()
    made = rows_out(got._jdf.queryExecution().executedPlan())
    assert made and max(made) < 2000 * 2000 / 10


def test_fusion_and_search(spark):
    arm = lambda ids, w=1.0: r.ranked(spark.createDataFrame([(x, float(-i)) for i, x in enumerate(ids)], "id string, score double"), [F.desc("score")], w)
    got = {x.id: x.rrf for x in r.rrf([arm(["a", "b"]), arm(["b", "a"], 5.0)]).collect()}
    assert got["b"] > got["a"] and got["a"] == pytest.approx(1 / 61 + 5 / 62)
    mem = spark.createDataFrame([(i, "t", t, 0.1 * n, "active", n, n, [1.0, 0.0]) for n, (i, t) in enumerate(DOCS)], "id string, tenant_id string, content string, importance double, state string, valid_from int, updated_us long, embedding array<float>")
    scope = F.col("tenant_id") == "t"
    assert r.memory_search(mem, scope, "pizza", 5, 10).first().id == "d2"
    assert [x.score for x in r.memory_search(mem, scope, "zebra", 2, 10).collect()] == [0.0, 0.0]
    assert r.memory_search(mem, scope, " ", 2, 10).count() == 2
    assert r.memory_search(mem, scope, "pizza", 2, 10, vector=[1.0, 0.0]).first().id == "d2"
    best = r.memory_search(mem, scope, "job", 2, 10, rerank=lambda q, ts: [float("interview" in (t or "")) for t in ts]).first()
    assert best.id == "d3"
    kept = r.memory_search(mem, scope, "job", 2, 10, rerank=lambda q, ts: [1.0] * (len(ts) + 1)).first()
    assert kept.score < 1
    grants = spark.createDataFrame([("t", "u1", "u2")], "tenant_id string, grantee_user_id string, grantor_user_id string")
    assert r.shared_search(mem, grants, "t", "u1", lambda s: r.bm25(mem, "pizza"), 3).count() == 1


def test_metrics(spark):
    ranks = spark.createDataFrame([(1,), (2,), (None,), (5,)], "rank int")
    x = r.retrieval_metrics(ranks).first()
    assert (x.r1, x.r3, x.r5) == (0.25, 0.5, 0.75) and x.mrr == pytest.approx((1 + 0.5 + 0.2) / 4)
    d = spark.createDataFrame([(x,) for x in [5, 1, 3, 3, None]], "v int")
    assert r.nearest_rank(d, "v", 0.5).first().value == 3 and r.nearest_rank(d, "v", 1.0).first().value == 5
    assert one(spark, tx.token_f1(F.lit("the red car"), F.lit("a red car"))) == pytest.approx(2 / 3)
    assert one(spark, tx.token_f1(F.lit(""), F.lit("!"))) == 1.0


VEC = [("a", "x", [1.0, 0.0]), ("b", "x", [0.8, 0.6]), ("c", "y", [0.0, 1.0]), ("d", "y", [1.0, 0.0, 0.0]), ("e", "y", None), ("f", "y", [0.0, 0.0])]


def test_vectors(spark):
    d = spark.createDataFrame(VEC, "id string, modality string, embedding array<float>")
    assert [x.id for x in v.knn(d, [1.0, 0.0], 5).collect()] == ["a", "b", "c"]
    assert [x.id for x in v.knn(d, [1.0, 0.0], 5, min_score=0.5).collect()] == ["a", "b"]
    assert [x.id for x in v.knn(d, [1.0, 0.0], 5, metric="l2").collect()] == ["a", "b", "f", "c"]
    assert [x.id for x in v.knn_modal(d, [1.0, 0.0], 5, "y").collect()] == ["c"]
    assert rows(v.knn_by_scope(d, [1.0, 0.0], 1, ["modality"]), "modality", "id") == [("x", "a"), ("y", "c")]
    got = v.knn_batch(d, [("q", [1.0, 0.0])], 2)
    assert [x.id for x in got.orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="dimension"):
        v.check_dimension(d.filter("embedding is not null"), 2).collect()
    assert sum(x * x for x in v.image_histogram([(0, 0, 0), (255, 255, 255)])) == pytest.approx(1)
    assert v.decode_ppm(b"P6 1 2 255\n\x00\x01\x02\xff\xfe\xfd") == [(0, 1, 2), (255, 254, 253)]


def test_response_cache(spark):
    cache = spark.createDataFrame([("s", "What  is UP", "r1", [1.0, 0.0], 100), ("s", "old", "r2", [0.0, 1.0], 1)], "scope string, query string, response string, embedding array<float>, stored_us long")
    q = spark.createDataFrame([(1, "s", "what is up", None), (2, "s", "else", [0.99, 0.1]), (3, "s", "old", [0.0, 1.0]), (4, "z", "what is up", [1.0, 0.0])], "qid int, scope string, query string, embedding array<float>")
    got = {x.qid: (x.response, x.hit) for x in v.cached_answers(cache, q, 150, 100).collect()}
    assert got == {1: ("r1", "exact"), 2: ("r1", "near"), 3: (None, "miss"), 4: (None, "miss")}


def test_response_cache_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(v, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(v, "CACHE_ROWS", 16)
    draw = np.random.default_rng(5)
    near = lambda c, w: [float(x) for x in np.float32(np.eye(6)[c] + w * draw.normal(size=6))]
    cache = [("ab"[i % 2], f"c{i}", f"r{i:03d}", near(i % 5, 0.15), 10) for i in range(90)]
    cache += [("a", "twin", "r999", cache[0][3], 10), ("a", "zero", "z", [0.0] * 6, 10), ("a", "short", "s", [1.0, 0.0], 10), ("a", "none", "n", None, 10), ("a", "stale", "old", [0.0] * 5 + [1.0], 1)]
    asked = [(i, "ab"[i % 2], f"q{i}", near(i % 6, 0.15)) for i in range(30)] + [(30, "a", "c4", near(1, 0.1)), (31, "a", "same", cache[0][3]), (32, "z", "x", cache[0][3]), (33, "a", "z", [0.0] * 6)]

    def want(scope, text, q):
        if (exact := [r for s, t, r, _, at in cache if (s, t) == (scope, text) and at == 10]):
            return exact[0], "exact"
        fit = [(round(float(np.dot(e, q) / (np.linalg.norm(e) * np.linalg.norm(q))), 12), r) for s, _, r, e, at in cache if s == scope and at == 10 and e and len(e) == len(q) and any(e) and any(q)]
        top = max(fit, default=(0.0, None))
        return (top[1], "near") if top[0] >= 0.95 else (None, "miss")

    c = spark.createDataFrame(cache, "scope string, query string, response string, embedding array<float>, stored_us long")
    q = spark.createDataFrame(asked, "qid int, scope string, query string, embedding array<float>")
    answers = v.cached_answers(c, q, 50, 45)
    got = {x.qid: (x.response, x.hit) for x in answers.collect()}
    assert got == {i: want(s, t, e) for i, s, t, e in asked}
    assert {h for _, h in got.values()} == {"exact", "near", "miss"} and got[31] == ("r999", "near")


def test_response_cache_query_takes_every_row(spark, tmp_path, monkeypatch):
    data = [(i, [1.0, i / 100], 0) for i in range(120)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sent, plain = [], v.cached_answers
    monkeypatch.setattr(v, "cached_answers", lambda cache, asked, *rest: sent.append((cache.count(), asked.count())) or plain(cache, asked, *rest))
    assert rows(queries.v12_response_cache(spark, str(tmp_path))) == [(0, "exact"), (100, "near"), (50, "near")]
    assert sent == [(120, 3)]


MEM = "id string, tenant_id string, user_id string, agent_id string, session_id string, subject string, content string, importance double, valid_from timestamp, valid_to timestamp, state string, version long, updated_at timestamp, metadata string, mem_type string, source_event_ids array<string>, embedding array<float>"


def memories(spark):
    from datetime import datetime as D

    d = lambda k: D(2024, 1, k)
    base = [
        ("1", "Plan", "A", 0.5, d(1), d(5), "superseded", [1.0, 0.0]),
        ("2", " plan", "B", 0.6, d(5), None, "active", [0.99, 0.1]),
        ("3", "plan ", "C", 0.01, d(6), None, "active", [0.0, 1.0]),
        ("4", None, "D", 0.9, d(6), None, "active", [1.0, 0.05]),
    ]
    data = [(i, "t", "u", None, None, s, c, imp, a, b, state, 1, a, '{"k":{"x":"y"}}', "semantic", ["e1"], e) for i, s, c, imp, a, b, state, e in base]
    return spark.createDataFrame(data, MEM)


def test_memories(spark):
    mem, now = memories(spark), F.lit("2024-03-01").cast("timestamp")
    scope = m.Scope("t", "u")
    assert rows(mem.filter(scope.predicate()), "id") == [("1",), ("2",), ("3",), ("4",)]
    assert mem.filter(m.Scope("t").predicate()).count() == 0
    assert rows(m.as_of(mem.withColumn("subject", tx.normalize_subject(F.col("subject"))).filter("subject is not null"), F.lit("2024-01-05").cast("timestamp")), "id") == [("2",)]
    assert [x.id for x in m.history(mem, scope, "PLAN").collect()] == ["1", "2", "3"]
    assert rows(m.decayed(mem, now), "id") == [("3",)]
    assert rows(m.contradictions(mem), "subject", "n") == [("plan", 2)]
    assert rows(m.resolved(mem, scope, "plan", "2", now), "id", "state") == [("3", "superseded")]
    with pytest.raises(ValueError):
        m.resolved(mem, scope, "plan", "1", now)
    assert rows(m.expired(mem, mem.select("id"), now), "id") == [("2",), ("3",), ("4",)]
    assert rows(m.over_cap(mem, 2), "id") == [("3",)] and m.over_cap(mem, 0).count() == 0
    votes = spark.createDataFrame([("4", "helpful"), ("2", "wrong"), ("1", "wrong")], "id string, verdict string")
    assert rows(m.feedback(mem, votes, now), "id", "importance", "version", "state") == [("2", 0.6, 1, "expired"), ("4", 1.0, 2, "active")]
    assert m.verdict(" Wrong ") == "wrong" and m.verdict("hm") is None
    patch = spark.createDataFrame([("2", "B2", 7.0, None, None), ("1", "x", None, None, None)], "id string, content string, importance double, mem_type string, metadata string")
    assert rows(m.patched(mem, patch, now), "id", "content", "importance") == [("2", "B2", 1.0)]
    assert [x.id for x in m.list_paged(mem, scope.predicate(), 2, 1, metadata=("k.x", "y")).collect()] == ["2", "3"]
    assert m.list_paged(mem, scope.predicate(), 9, metadata=("k';", "y")).count() == 0
    assert m.consolidated_tail(mem, 2).first().content == "Consolidated 1 memories:\n- C"
    near = m.consolidated_similar(mem, 0.9).first()
    assert sorted(near.ids) == ["2", "4"] and near.importance == 0.9
    merged = m.merged_similar(mem.filter("state = 'active'").withColumn("seq", F.col("id")), threshold=0.9)
    assert rows(merged, "id", "outcome", "target") == [("2", "inserted", None), ("3", "inserted", None), ("4", "merged", "2")]
    log = mem.unionByName(m.patched(mem, patch, now))
    assert rows(m.latest(log).filter("id = '2'"), "content", "version") == [("B2", 2)]
    new = mem.filter("id = '1'").withColumn("id", F.lit("n")).withColumn("content", F.lit(" B "))
    new = new.withColumn("at", now).withColumn("seq", F.lit(1))
    plan = lambda df, **x: rows(m.additions(mem, df, **x), "outcome", "target")
    assert plan(new) == [("superseded", "3")]  # only the newest active memory can be confirmed
    assert plan(new.withColumn("content", F.lit(" C\n\u00a0"))) == [("confirmed", "3")]
    assert plan(new, review=True) == [("conflict", "3")]
    assert plan(new.withColumn("subject", F.lit("new"))) == [("inserted", None)]
    assert plan(new.withColumn("subject", F.lit(" \t")).unionByName(new.withColumn("subject", F.lit("")).withColumn("id", F.lit("o")))) == [("inserted", None)] * 2
    assert plan(new.withColumn("subject", F.lit("new")).unionByName(new.withColumn("subject", F.lit("New ")).withColumn("id", F.lit("o")).withColumn("seq", F.lit(2)))) == [("confirmed", "n"), ("inserted", None)]
    left = m.erased({"memories": mem, "memory_grants": spark.createDataFrame([("t", "u", "w")], "tenant_id string, grantee_user_id string, grantor_user_id string")}, "t", "u")
    assert left["memories"].count() == 0 and left["memory_grants"].count() == 0
    vecs = m.embedded_rows(mem.select("id", "content"), "content", lambda ts: [[float(len(t))] for t in ts]).filter("id = '1'").first().embedding
    assert vecs == [1.0]
    broken = m.embedded_rows(mem.select("id", "content"), "content", lambda ts: 1 / 0)
    assert broken.filter("embedding is not null").count() == 0


@pytest.mark.parametrize("review", [False, True])
def test_additions_against_replay(spark, review):
    """A batch of statements, applied at once, leaves what applying them one after the other leaves."""
    import random

    rng, d = random.Random(9), lambda n: datetime(2024, 1, 1) + timedelta(minutes=n)
    scopes = [("t", None), ("t", "u")]
    store = {}
    for i in range(14):
        t, u = rng.choice(scopes)
        store[f"o{i:02d}"] = {"scope": (t, u), "subject": rng.choice(["s", "p"]), "content": rng.choice("abc"), "importance": rng.choice([0.2, 0.8]), "valid_from": d(i), "valid_to": None, "state": rng.choice(["active", "expired"]), "supersedes": None, "version": 1 + i % 3, "updated_at": d(i)}
    row = lambda i, x: (i, x["scope"][0], x["scope"][1], None, None, x["subject"], x["content"], x["importance"], x["valid_from"], x["valid_to"], x["state"], x["version"], x["updated_at"], "{}", "semantic", ["e"], [1.0])
    kind = MEM + ", supersedes string, created_at timestamp"
    mem = spark.createDataFrame([(*row(i, x), None, x["valid_from"]) for i, x in store.items()], kind)
    batch, outcomes = [], {}
    for k in range(60):
        t, u = rng.choice(scopes)
        s, c, imp = rng.choice(["s", " S", "p", "q", None, "  "]), rng.choice(["a", "b", " a\n", "c"]), rng.choice([0.1, 0.5, 0.9])
        batch.append((f"n{k:02d}", t, u, None, None, s, c, imp, ["e"], "{}", "semantic", [1.0], d(100 + k), k))
        j = " ".join((s or "").lower().split())
        act = sorted((x["valid_from"], i) for i, x in store.items() if j and x["scope"] == (t, u) and x["subject"] == j and x["state"] == "active")
        newest = act[-1][1] if act else None
        if newest and store[newest]["content"].strip() == c.strip():
            x = store[newest]
            x.update(importance=max(x["importance"], imp), version=x["version"] + 1, updated_at=d(100 + k))
            outcomes[f"n{k:02d}"] = ("confirmed", newest)
            continue
        if newest and not review:
            for _, i in act:
                store[i].update(state="superseded", valid_to=d(100 + k), updated_at=d(100 + k))
        outcomes[f"n{k:02d}"] = ("inserted" if not newest else "conflict" if review else "superseded", newest)
        store[f"n{k:02d}"] = {"scope": (t, u), "subject": j or None, "content": c, "importance": imp, "valid_from": d(100 + k), "valid_to": None, "state": "active", "supersedes": newest if not review else None, "version": 1, "updated_at": d(100 + k)}
    new = spark.createDataFrame(batch, "id string, tenant_id string, user_id string, agent_id string, session_id string, subject string, content string, importance double, source_event_ids array<string>, metadata string, mem_type string, embedding array<double>, at timestamp, seq int")
    plan = m.additions(mem, new, review)
    assert {r.id: (r.outcome, r.target) for r in plan.collect()} == outcomes
    got = m.latest(mem.unionByName(m.applied(mem, plan)))
    fields = ["subject", "content", "importance", "valid_from", "valid_to", "state", "supersedes", "version", "updated_at"]
    assert {r.id: tuple(r[f] for f in fields) for r in got.collect()} == {i: tuple(x[f] for f in fields) for i, x in store.items()}


def test_numbered(spark):
    import random

    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "x", None]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    want, seen = {}, {}
    for k, v, i in sorted(data, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    for block in (10, 250_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(runs, "BLOCK_ROWS", block)
            assert {r["i"]: r["n"] for r in runs.numbered(df, ["k"], [F.col("v"), F.col("i")], "n").collect()} == want
    assert sorted(r["n"] for r in runs.numbered(df, [], [F.col("i")], "n").collect()) == list(range(1, 301))


def test_greedy_clusters_in_blocks():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    free, want = set(range(300)), []
    for i in range(300):
        if i in free:
            near = [k for k in sorted(free) if k == i or x[k] @ x[i] >= 0.9]
            free -= set(near)
            want.append(sorted(near))
    for block in (1, 7, 1_000):
        assert [sorted(c) for c in m.greedy(x, 0.9, block)] == want


def test_merges_into_what_is_stored(spark):
    d = datetime(2024, 1, 1)
    row = lambda i, e, s=None, imp=0.5: (i, "t", "u", None, None, s, i, imp, d, None, "active", 1, d, "{}", "semantic", [i], e)
    old = spark.createDataFrame([row("o1", [1.0, 0.0], "plan", 0.9), row("o2", [0.0, 1.0])], MEM)
    new = spark.createDataFrame([row("n1", [0.99, 0.05]), row("n2", [0.98, 0.1]), row("n3", None), row("n4", [0.0, 0.0]), row("n5", [-1.0, 0.0])], MEM).withColumn("seq", F.col("id"))
    got = {r.id: (r.outcome, r.target, r.subject, r.importance, list(r.source_event_ids)) for r in m.merged_similar(new, old).collect()}
    assert got["n1"] == ("merged", "o1", "plan", 0.9, ["o1", "n1"]) and got["n2"] == ("merged", "n1", "plan", 0.9, ["o1", "n1", "n2"])
    assert [got[k][0] for k in ("n3", "n4", "n5")] == ["inserted"] * 3


@pytest.mark.parametrize("block", [4, 250_000])
def test_fold_against_replay(spark, block, monkeypatch):
    import random

    monkeypatch.setattr(runs, "BLOCK_ROWS", block)
    rng = random.Random(6)
    ev = [(rng.choice(["k0", "k0", "k0", "k1", None]), rng.choice(["a", "b", " a\n", None]) if t < 40 or t > 60 else "a", t, rng.random()) for t in range(120)]
    df = spark.createDataFrame(ev, "key string, content string, at long, importance double").withColumn("seq", F.col("at"))
    got = rows(m.fold_contradictions(df, ["key"], "content", "at", "seq"), "key", "content", "version", "valid_from", "valid_to", "importance", "island", "supersedes", "updated_at", "state")
    out = []
    for k in {e[0] for e in ev}:
        cur = []
        for _, c, t, imp in [e for e in ev if e[0] == k]:
            if cur and (cur[-1][0] or "").strip() == (c or "").strip() and (cur[-1][0] is None) == (c is None):
                cur[-1][1] += 1
                cur[-1][4], cur[-1][7] = max(cur[-1][4], imp), t
            else:
                if cur:
                    cur[-1][3] = cur[-1][7] = t
                cur.append([c, 1, t, None, imp, len(cur) + 1, len(cur) or None, t])
        out += [(k, *x, "active" if x[3] is None else "superseded") for x in cur]
    assert got == sorted(out, key=lambda r: [(x is not None, str(x)) for x in r])
    assert m.fold_contradictions(df.limit(0), ["key"], "content", "at", "seq").collect() == []


def test_templates_and_facts(spark):
    t = lambda n, f: one(spark, m.template(F.lit(n), F.lit(f)))
    assert t("person", '{"name":" Ann ","detail":"pilot"}').content == "Ann — pilot"
    assert t("decision", '{"topic":"x"}') is None and t("none", "{}") is None
    facts = lambda s: [(x.subject, x.content) for x in one(spark, m.extracted_facts(F.lit(s)))]
    assert facts('[{"subject":"a","content":"b"},{"content":" "}]') == [("a", "b")]
    assert facts('["x","y"]') == [(None, "x"), (None, "y")]
    assert facts(" plain ") == [(None, "plain")] and facts(" ") == []


EDGE = "id string, tenant_id string, src string, relation string, dst string, weight double, state string, valid_from timestamp, valid_to timestamp"


def edges(spark, pairs):
    return spark.createDataFrame([(str(i), "t", a, "r", b, 1.0, "active", None, None) for i, (a, b) in enumerate(pairs)], EDGE)


def test_graph(spark):
    rank = {x.node: x.pagerank for x in g.pagerank(edges(spark, [("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "z")]), rounds=8).collect()}
    assert sum(rank.values()) == pytest.approx(1) and max(rank, key=rank.get) == "z"
    assert g.pagerank(edges(spark, []).limit(0)).count() == 0
    path = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x")])
    assert g.shortest_path(path, "a", "d") == ["a", "b", "c", "d"]
    assert g.shortest_path(path, "d", "a") is None and g.shortest_path(path, "q", "q") == ["q"]
    chain = edges(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y"), ("s", "s")])
    assert rows(g.communities(chain).filter("node = component"), "component", "size", "place") == [("n00", 21, 0), ("s", 1, 2), ("x", 2, 1)]
    assert rows(g.degrees(path).filter("node = 'b'")) == [("b", 1, 1)]
    assert rows(g.subgraph(path, "t", "b", 1, 10), "id") == [("0",), ("1",)]
    assert rows(g.subgraph(path, "t", "b", 2, 10), "id") == [("0",), ("1",), ("2",), ("3",)]
    assert g.neighbours(path, "t", "a", 1).count() == 1


def written_edges(spark, folder, data):
    """A table memory_edges of (tenant, src, dst, weight, state) in ``folder``."""
    full = [(str(i), t, a, "r", b, w, state, None, None) for i, (t, a, b, w, state) in enumerate(data)]
    spark.createDataFrame(full, EDGE).write.parquet(f"{folder}/memory_edges.parquet")
    return str(folder)


def test_components_query_takes_every_tenant(spark, tmp_path):
    import random

    draw = random.Random(3)
    data = [(draw.choice(["larkfield", "larkfield", "default"]), f"n{draw.randint(0, 60):02d}", f"n{draw.randint(0, 60):02d}", 1.0, draw.choice(["active", "active", "superseded"])) for _ in range(60)]
    data.append(("larkfield", "x1", "x2", 1.0, "active"))
    near = {}
    for _, a, b, _, state in data:
        if state == "active":
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(node):
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    got = queries.g11_components(spark, written_edges(spark, tmp_path, data))
    assert rows(got, "node", "component") == sorted((x, least(x)) for x in near)


def test_pagerank_query_runs_forty_rounds(spark, tmp_path):
    data = [("t", f"n{i:02d}", f"n{(i * 7 + 3) % 11:02d}", float(i % 3), "active") for i in range(14)]
    data += [("t", f"n{i:02d}", f"n{i + 1:02d}", 2.0, "active") for i in range(12)] + [("t", "n00", "n05", 9.0, "superseded")]
    nodes = sorted({x for _, a, b, _, state in data if state == "active" for x in (a, b)})
    out = {x: [(b, w if w > 0 else 1.0) for _, a, b, w, state in data if a == x and state == "active"] for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(40):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(rank[x] for x in nodes if not out[x])) / len(nodes))
        for x in nodes:
            for b, w in out[x]:
                new[b] += 0.85 * rank[x] * w / sum(z for _, z in out[x])
        rank = new
    got = {x.node: x.pagerank for x in queries.g09_pagerank(spark, written_edges(spark, tmp_path, data)).collect()}
    assert got == pytest.approx(rank, abs=2e-9)


def test_triples(spark):
    d = spark.createDataFrame([("m", "Alice likes coffee. Bob works at Acme; He is married to Eve\nshort is\nlikes this"), ("n", None)], "id string, t string")
    assert rows(g.triples(d, "id", "t"), "subject", "relation", "object") == [("Alice", "likes", "coffee"), ("Bob", "works_at", "Acme"), ("He", "is", "married to Eve"), ("He is", "married_to", "Eve")]
    assert [tuple(x) for x in one(spark, g.triple_lines(F.lit("a | b | c\nbad\n | x | y")))] == [("a", "b", "c")]


def test_joins(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 5, 3), ("k", None, 4), ("k", 20, 5)], "key string, at long, n int")
    right = spark.createDataFrame([("k", 2, 6, "a"), ("k", 6, 9, "b"), ("k", None, None, "c")], "key string, s long, e long, val string")
    assert rows(j.as_of_join(left, right, ["key"], "at", "s", "e", ["val"]), "n", "val") == [(1, "a"), (2, None), (3, None), (4, None), (5, None)]
    assert rows(j.interval_join(left, right, ["key"], "at", "s", "e", 3), "n", "val") == [(1, "a")]
    pats = spark.createDataFrame([("*", "k"), ("s", "*"), ("s", "k")], "ps string, pk string")
    ev = spark.createDataFrame([("s", "k"), ("q", "k"), ("s", "z")], "source string, kind string")
    assert j.wildcard_match(ev, pats, {"ps": "source", "pk": "kind"}).count() == 5


def test_as_of_join_finds_any_period_that_holds(spark):
    import random

    draw = random.Random(7)
    right = [(draw.choice("kqz"), s, draw.choice([None, s + draw.randint(-2, 4), s + draw.randint(5, 40)]), draw.randint(1, 2), f"m{i:03d}") for i in range(160) for s in [draw.randint(0, 60)]]
    right += [("n", 0, 50, 1, "long"), ("n", 10, 20, 1, "short"), ("t", 1, None, 1, "low"), ("t", 1, 5, 2, "b"), ("t", 1, 9, 2, "a"), (None, 0, None, 1, "no key")]
    left = [(k, t, f"{k}{t}") for k in ["k", "q", "z", "n", "t", None] for t in range(-1, 70, 2)] + [("k", None, "no time")]

    def held(key, at):
        fit = [] if at is None or key is None else [x for x in right if x[0] == key and x[1] <= at and (x[2] is None or x[2] > at)]
        return min(fit, key=lambda x: (-x[1], -x[3], x[4]))[4] if fit else None

    r_df = spark.createDataFrame(right, "key string, s long, e long, version int, mid string")
    got = j.as_of_join(spark.createDataFrame(left, "key string, at long, n string"), r_df, ["key"], "at", "s", "e", ["mid"], {"version": True, "mid": False}).collect()
    assert sorted((x.n, x.mid or "") for x in got) == sorted((n, held(k, t) or "") for k, t, n in left)
    assert ("n25", "long") in {(x.n, x.mid) for x in got} and ("t3", "a") in {(x.n, x.mid) for x in got}


def test_state(spark):
    log = [("a", "k", "set", "1", None, None, 1, "s1"), ("a", "k", "set_ttl", "2", None, 10, 2, "s2"), ("a", "x", "set", "1", None, None, 1, "s3"), ("a", "x", "delete", None, None, None, 5, "s4"), ("a", "y", "delete", None, None, None, 1, "s5"), ("a", "y", "set", "9", None, None, 2, "s6")]
    df = spark.createDataFrame(log, "agent_id string, key string, op string, value string, expected long, ttl_us long, at long, seq string")
    want = [("a", "k", "2", 2, 2, 12), ("a", "y", "9", 1, 2, None)]
    assert rows(st.fold_state(df)) == want and rows(st.fold_state(df, F.lit(12))) == want[1:]
    assert rows(st.replay_state(df).drop("applied")) == want
    cas = spark.createDataFrame([("a", "k", "cas", "new", 2, None, 3, "s7"), ("a", "k", "cas", "late", 2, None, 4, "s8")], df.schema)
    assert rows(st.replay_state(df.union(cas)).filter("key = 'k'"), "value", "version", "applied") == [("new", 3, 1)]
    assert st.topological_order({"b": ["a"], "a": [], "c": ["b"]}) == ["a", "b", "c"]
    assert st.topological_order({"a": ["b"], "b": ["a"]}) is None and st.topological_order({"a": ["q"]}) is None
    runs = spark.createDataFrame([("r", "pending", None, 1, 1), ("r", "done", None, None, 3), ("r", None, "res", None, 4)], "id string, status string, result string, created_at int, updated_at int")
    assert rows(st.fold_runs(runs)) == [("r", "done", "res", 1, 4)]
