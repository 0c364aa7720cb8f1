"""SQL guard, ingest, sinks and streams end to end."""

import json
from datetime import datetime, timedelta

import hypothesis.strategies as some
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from memlake.operators.sessions import sessionize
from memlake.plans import sql_guard as sg
from memlake.sources import ingest, sinks
from memlake.streaming import pipelines as sp

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def door(spark):
    e = spark.createDataFrame([("1", "t1", "a.b", '{"x":1}', T0), ("2", "t1", "c", "{}", T0), ("3", "t2", "c", "{}", T0)], "id string, tenant_id string, event_type string, payload string, ts timestamp")
    s = spark.createDataFrame([("t1", "ag", "k", "v", 3), ("t2", "ag", "k", "other", 1)], "tenant_id string, agent_id string, key string, value string, version int")
    hits = lambda text, k, tenant: e.filter(F.col("tenant_id") == tenant).select("id", F.lit(text).alias("content"), F.lit(0.5).alias("score")).limit(k)
    return sg.TenantSql(spark, {"episodic": e}, hits, s)


def test_tenant_sees_own_rows(door):
    assert door.query("select count(*) as n from episodic", "t1").first().n == 2
    assert door.query("with e as (select * from episodic) select id from e where exists (select 1 from episodic x where x.id = e.id)", "t2").count() == 1
    assert door.query("select * from episodic", "t1", max_rows=1).count() == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(some.text(alphabet=some.characters(blacklist_categories=("Cs",)), max_size=40))
def test_strange_tenants_see_nothing(door, tenant):
    if tenant not in ("t1", "t2"):
        assert door.query("select * from episodic", tenant).count() == 0


BAD = [
    "drop table episodic", "insert into episodic values (1)", "create view v as select 1", "select 1; select 2", "", ";", "not sql",
    "select * from parquet.`/etc`", "select * from text.`/etc/passwd`", "select reflect('java.lang.System', 'getenv')", "select java_method('java.lang.System','exit',1)",
    "select * from read_parquet('x')", "select * from glob('x')", "select * from other", "select * from spark_catalog.default.episodic", "set spark.x=1", "show tables", "describe episodic",
    "with e as (select reflect('a','b')) select * from e", "select (select max(id) from parquet.`/x`)", "select * from episodic where id in (select value from text.`/x`)", "cache table episodic", "explain select 1", "delete from episodic",
    "select id from episodic order by (select max(value) from text.`/x`)",
]


@pytest.mark.parametrize("sql", BAD)
def test_guard_refuses(door, sql):
    with pytest.raises(sg.Refused):
        door.query(sql, "t1")


def test_virtual_tables_and_dialect(door, spark):
    got = door.query("select e.id, h.content, s.value from episodic e join memory_hits('it''s', k => 1) h on e.id = h.id cross join agent_state('ag', 'k') s", "t1").collect()
    assert [tuple(r) for r in got] == [("1", "it's", "v")]
    assert door.query("select * from agent_state('ag', 'none')", "t1").count() == 0
    assert door.query("select payload->>'x' as x, '->> ::VARCHAR' as raw, id::VARCHAR as i, EXTRACT(EPOCH FROM ts) as s from episodic where id = '1'", "t1").first().asDict() == {"x": "1", "raw": "->> ::VARCHAR", "i": "1", "s": 1704067200.0}
    assert [sg.classify(spark, q) for q in ("select * from memory_hits('a')", "select * from agent_state('a','b')", "select 1", "drop table x")] == ["search", "state", "query", "dml"]


def test_time_limit_and_views(spark, tmp_path):
    assert sg.within(spark.range(3), 60).__len__() == 3
    mv = sg.MaterializedViews(spark, f"file://{tmp_path}")
    spark.range(4).createOrReplaceTempView("base")
    assert mv.create("big", "select * from base where id > 1").count() == 2
    spark.range(9).createOrReplaceTempView("base")
    assert spark.table("mv_big").count() == 2 and mv.refresh("big").count() == 7 and mv.list() == ["big"]
    mv.drop("big")
    assert mv.list() == []
    for name, sql in (("a-b", "select 1"), ("ok", "drop table x")):
        with pytest.raises(sg.Refused):
            mv.create(name, sql)


EVENT = "id string, source string, event_type string, payload string, ts timestamp, idempotency_key string, tags array<string>, embedded boolean, tenant_id string"


def event(i, key=None, minute=0, **x):
    r = {"id": str(i), "source": "s", "event_type": "a.b", "payload": "{}", "ts": T0 + timedelta(minutes=minute), "idempotency_key": key, "tags": None, "embedded": None, "tenant_id": "t"} | x
    return tuple(r.values())


def test_idempotent_append(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = spark.createDataFrame([event(1, "k"), event(2, "k"), event(3), event(3)], EVENT)
    assert ingest.append(first, path) == 3
    assert ingest.append(spark.createDataFrame([event(4, "k"), event(5, "m")], EVENT), path) == 1
    assert rows(spark.read.parquet(path), "id") == [("1",), ("3",), ("3",), ("5",)]


def test_payloads(spark):
    p = [event(1, payload=x) for x in ('{"a":1}', "{}", "[1]", None)]
    got = [r.payload for r in ingest.tenant_tagged(spark.createDataFrame(p, EVENT), 'q"t').collect()]
    assert [json.loads(x) if x else x for x in got] == [{"_tenant_id": 'q"t', "a": 1}, {"_tenant_id": 'q"t'}, [1], None]
    assert ingest.embedding_text("a.b", '{"_x":"hid","id":"ab-12","note":"hello","n":3,"l":[1,2]}', ["t1", "t2"]) == "a b. note: hello. [1,2]. t1 t2"
    assert len(ingest.embedding_text("x", json.dumps({"k": "é" * 5000}), None).encode()) <= 2048
    assert ingest.rest_batch(spark, "s", [{"payload": {"a": 1}}], 5).first().event_type == "unknown"
    with pytest.raises(ValueError):
        ingest.rest_batch(spark, "s", [{}] * 10_001, 0)
    assert rows(ingest.unembedded(spark.createDataFrame([event(1), event(2, embedded=True)], EVENT)), "id") == [("1",)]


def test_webhooks(spark):
    raw = [
        ("github", {"action": "opened", "pull_request": {}, "repository": {"full_name": "o/r"}, "sender": {"login": "me"}}), ("github", {"commits": [1]}), ("sentry", {"data": {"issue": {"project": {"slug": "web"}, "title": "boom"}}}),
        ("slack", {"event": {"channel": "c1", "text": "hi"}}), ("pagerduty", {}), ("shop", {"type": "order"}), ("shop", {}),
    ]
    got = ingest.webhook_events(spark.createDataFrame([(v, json.dumps(b)) for v, b in raw], "vendor string, body string")).collect()
    assert [(r.source, r.event_type) for r in got] == [("github/o/r", "pull_request.opened"), ("github/unknown", "push"), ("sentry/web", "issue.triggered"), ("slack/c1", "message"), ("pagerduty/unknown", "incident.trigger"), ("shop", "order"), ("shop", "webhook")]
    assert json.loads(got[0].payload)["sender"] == "me" and json.loads(got[2].payload)["title"] == "boom"


def test_importers(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and f"file://{tmp_path}/{name}"
    assert rows(ingest.import_mem0(spark, put("a.json", {"results": [{"memory": "m1"}, {"text": "m2", "user_id": "u"}, {"x": 1}]})), "text", "user_id") == [("m1", None), ("m2", "u")]
    assert rows(ingest.import_mem0(spark, put("b.json", [{"content": "c"}])), "text") == [("c",)]
    zep = put("z.json", {"facts": ["f1", {"fact": "f2"}], "messages": [{"content": "hey"}, {"role": "assistant", "content": "yo"}]})
    assert rows(ingest.import_zep(spark, zep)) == [("fact", None, "f1"), ("fact", None, "f2"), ("message", "assistant", "yo"), ("message", "user", "hey")]
    with pytest.raises(ValueError):
        ingest.import_zep(spark, put("n.json", {"x": 1}))
    note = spark.createDataFrame([("v/My Note.md", "---\ntitle: T\ntag: a: b\n---\nBody [[Link|x]] [[Other#h]] [[Link]]"), ("v/Plain.md", "just text")], "path string, value string")
    n = {r.path: r for r in ingest.notes(note).collect()}
    assert (n["v/My Note.md"].title, n["v/My Note.md"].front_matter["tag"], list(n["v/My Note.md"].links)) == ("T", "a: b", ["Link", "Other"])
    assert n["v/Plain.md"].title == "Plain" and ingest.note_edges(ingest.notes(note)).count() == 2
    talks = [{"user": "u", "turns": ["a"], "qa": [{"question": "q", "expected": "e"}]}, {"sample_id": "s", "conversation": {"session_2": [{"speaker": "B", "text": "y"}], "session_1": [{"speaker": "A", "text": "x"}]}, "qa": [{"question": "q", "answer": "e"}]}, {"question_id": "i", "question": "q", "answer": "e", "haystack_sessions": [[{"role": "user", "content": "z"}]]}]
    d = ingest.dialogues(spark.createDataFrame([(json.dumps(t),) for t in talks], "value string")).collect()
    assert [(r.user, list(r.turns), r.qa[0].expected) for r in d] == [("u", ["a"], "e"), ("s", ["A: x", "B: y"], "e"), ("i", ["user: z"], "e")]
    text = "\n\n".join(["p" * 60, "q" * 60, "short", "r" * 120])
    assert [len(r.chunk) for r in ingest.chunks(spark.createDataFrame([(1, text), (2, None)], "id int, t string"), "id", "t", 130).collect()] == [129, 120]


def test_backup_restore_prune(spark, tmp_path):
    base = f"file://{tmp_path}"
    df = spark.createDataFrame([event(1), event(2, "k")], EVENT)
    sinks.backup({"episodic": df}, f"{base}/b1")
    back = sinks.restore(spark, f"{base}/b1", f"{base}/live")
    assert rows(back["episodic"], "id") == [("1",), ("2",)]
    df.limit(1).write.mode("append").parquet(f"{base}/b1/episodic")
    with pytest.raises(ValueError, match="damaged"):
        sinks.restore(spark, f"{base}/b1", f"{base}/live")
    assert spark.read.parquet(f"{base}/live/episodic").count() == 2
    sinks.backup({"episodic": df}, f"{base}/b2")
    assert sinks.prune_backups(spark, base, 1) == ["b1"]


def test_exports(spark):
    mem = spark.createDataFrame([("1", "t", "A/b", "text", 0.5, "active"), ("2", "t", "a/B", "more", 0.5, "active"), ("3", "t", None, "gone", 0.1, "expired")], "id string, tenant_id string, subject string, content string, importance double, state string")
    edge = spark.createDataFrame([("t", "a/b", "X", "active")], "tenant_id string, src string, dst string, state string")
    got = {r.id: r for r in sinks.note_export(mem, edge).collect()}
    assert len({r.filename.lower() for r in got.values()}) == 2 and "[[X]]" in got["1"].note
    snap = sinks.tenant_export({"memories": mem}, "t")
    assert snap["memories"].count() == 2
    assert sinks.tenant_import({"memories": mem}, snap, {"memories": "id"})["memories"].count() == 3
    events = spark.createDataFrame([event(1, payload="100%_x"), event(2, payload="100ab")], EVENT)
    assert rows(sinks.entity_export(events, "%_"), "id") == [("1",)]


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    data = [event(1, "k"), event(2, "k"), event(3), event(4, "m")]
    spark.createDataFrame(data, EVENT).coalesce(1).write.parquet(src)
    sp.run_available(sp.idempotent(sp.table_stream(spark, src)), f"{tmp_path}/c1", sp.append_to(out))
    assert spark.read.parquet(out).count() == 3
    spark.createDataFrame([event(5, "k")], EVENT).coalesce(1).write.mode("append").parquet(src)
    sp.run_available(sp.idempotent(sp.table_stream(spark, src)), f"{tmp_path}/c1", sp.append_to(out))
    assert spark.read.parquet(out).count() == 3
    # events without key are all kept, even those sent again under their id, or with none
    free = [event(1), event(1), (None, *event(6)[1:]), (None, *event(6)[1:])]
    spark.createDataFrame(free, EVENT).coalesce(1).write.parquet(f"{tmp_path}/free")
    sp.run_available(sp.idempotent(sp.table_stream(spark, f"{tmp_path}/free")), f"{tmp_path}/c3", sp.append_to(f"file://{tmp_path}/kept"))
    assert spark.read.parquet(f"file://{tmp_path}/kept").count() == 4
    sp.reindex(sp.table_stream(spark, src), lambda ts: [[1.0] for _ in ts], f"file://{tmp_path}/vec", f"{tmp_path}/c2")
    assert spark.read.parquet(f"file://{tmp_path}/vec").count() == 5
    trig = spark.createDataFrame([("t", "*", "a.b", "w1"), ("u", "*", "*", "w2")], "tenant_id string, match_source string, match_type string, workflow string")
    assert sp.triggered(spark.createDataFrame(data, EVENT), trig).count() == 4


def test_session_timers_match_batch(spark, tmp_path):
    src, out = f"{tmp_path}/log", f"file://{tmp_path}/s"
    at = [("A", m) for m in (0, 10, 45, 80, 200)] + [("b", m) for m in (5, 34, 65, 66)]
    rowsof = lambda part: spark.createDataFrame([(i, T0 + timedelta(minutes=m), m) for i, m in part], "identity string, timestamp timestamp, n int").coalesce(1)
    rowsof(at[:4] + at[5:7]).write.parquet(src)
    rowsof(at[4:5] + at[7:]).write.mode("append").parquet(src)
    rowsof([("z", 5000)]).write.mode("append").parquet(src)
    rowsof([("z", 9000)]).write.mode("append").parquet(src)
    timers = sp.session_timers(sp.table_stream(spark, src, 1), "identity", "timestamp", delay="10 hours")
    sp.run_available(timers, f"{tmp_path}/c", sp.append_to(out))
    got = [r for r in rows(spark.read.parquet(out).drop("batch")) if r[0] != "z"]
    want = [r for r in rows(sessionize(spark.read.parquet(src), "identity", "timestamp")) if r[0] != "z"]
    assert got == want


def test_session_timers_keep_bounded_state(spark, tmp_path):
    """Entries in many small batches, late by less than the delay and sent twice: as the replay, and old ones leave the state."""
    src, out = f"{tmp_path}/log", f"file://{tmp_path}/s"
    at = [("a", 7 * i % 40 + 40 * (i // 40)) for i in range(120)] + [("a", 500), ("b", 500), ("c", 9000)]
    for i in range(0, len(at), 41):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m), m) for k, m in at[i : i + 41] + at[i : i + 3]], "identity string, timestamp timestamp, n int").coalesce(1).write.mode("append").parquet(src)
    timers = sp.session_timers(sp.table_stream(spark, src, 1), "identity", "timestamp", delay="80 minutes")
    sp.run_available(timers, f"{tmp_path}/c", sp.append_to(out))
    got = [r for r in rows(spark.read.parquet(out).drop("batch")) if r[0] != "c"]
    assert got == [r for r in rows(sessionize(spark.read.parquet(src), "identity", "timestamp")) if r[0] != "c"]


def test_state_and_windows(spark, tmp_path):
    src, out = f"{tmp_path}/st", f"file://{tmp_path}/o"
    log = [("a", "k", "set", "1", None, 1, "x"), ("a", "k", "cas", "2", 1, 2, "y"), ("a", "k", "cas", "3", 1, 3, "z")]
    spark.createDataFrame(log, "agent_id string, key string, op string, value string, expected long, at long, seq string").coalesce(1).write.parquet(src)
    sp.run_available(sp.stored_state(sp.table_stream(spark, src)), f"{tmp_path}/c", sp.append_to(out), "update")
    assert rows(spark.read.parquet(out), "value", "version", "applied") == [("2", 2, 2)]
    counts = sp.windowed_counts(spark.createDataFrame([event(1), event(2, minute=4), event(3, minute=6)], EVENT), "5 minutes", "1 minute")
    assert rows(counts, "n") == [(1,), (2,)]
    mem = spark.createDataFrame([("m", "t", "active"), ("n", "t", "expired")], "id string, tenant_id string, state string")
    st = spark.createDataFrame([("a", "k", "t", "set")], "agent_id string, key string, tenant_id string, op string")
    ch = sp.change_stream(mem, st)
    assert rows(ch, "stream", "event") == [("memory", "expired"), ("memory", "upserted"), ("state", "set")]
    assert sp.watch(ch, "t", "state", "a").count() == 1 and sp.watch(ch, "x").count() == 0


def test_embedded(spark, tmp_path):
    from memlake.embedded import Embedded

    ticks = iter(range(1_700_000_000, 1_800_000_000))
    db = Embedded.open(spark, f"file://{tmp_path}", "t", "u", clock=lambda: float(next(ticks)))
    db.add("likes tea", "drink")
    db.add(" likes tea", "Drink")
    db.add("likes coffee", "drink")
    assert db.remember('["works at the bank"]') == 1
    got = db.all().collect()
    assert {r.content for r in got} == {"likes coffee", "works at the bank"}
    assert db.recall("coffee").first().content == "likes coffee"
    assert Embedded.open(spark, f"file://{tmp_path}", "other").all().count() == 0
