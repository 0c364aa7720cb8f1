"""Events, attachments, typed rows, placement, stored views and further verbs on small tables."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from memlake.functions.scalars import HashRing
from memlake.operators import attachments as at
from memlake.operators import events as ev
from memlake.operators import graph as g
from memlake.operators import history as h
from memlake.operators import retrieval as r
from memlake.operators import state as st
from memlake.operators import vector as v
from memlake.operators.hierarchy import descendants, hierarchy
from memlake.operators.joins import wildcard_match
from memlake.plans import results
from memlake.plans import shared
from memlake.plans import sql_guard as sg
from memlake.sources import ingest, sinks
from memlake.streaming import pipelines as sp

T0 = datetime(2024, 1, 1)


def test_event_builder_and_introspection(spark):
    e = spark.createDataFrame([(str(i), "s" if i % 2 else "t", f"run.{i}", T0 + timedelta(hours=i), "x") for i in range(6)], "id string, source string, event_type string, ts timestamp, tenant_id string")
    q = ev.EventQuery().source("s").event_type("run.*").since(F.lit("2024-01-01 02:00:00").cast("timestamp"))
    assert [x.id for x in q.over(e).collect()] == ["5", "3"] and [x.id for x in q.order_by("ts", False).limit(1).over(e).collect()] == ["3"]
    for bad in (lambda: q.order_by("ts; drop"), lambda: q.limit(-1), lambda: q.limit(True)):
        with pytest.raises(ValueError):
            bad()
    assert rows(ev.sources(e)) == [("s",), ("t",)] and ev.of_ids(e, e.limit(0).select("id")).count() == 0
    assert rows(ev.agents(spark.createDataFrame([("p-a",), ("b",), ("p-a",)], "agent_id string"), "p-")) == [("a",), ("b",)]
    assert ev.audit_rows(spark.createDataFrame([("u", "GET", "/", 200, 1.0, "t", None), (None, "GET", "/", 401, 1.0, None, None)], "identity string, method string, path string, status int, duration_ms double, tenant string, ip string"), F.current_timestamp()).count() == 1
    placed = ev.sharded(e.withColumn("tenant_id", F.col("id")).unionByName(e.limit(1).withColumn("tenant_id", F.lit(None))), HashRing(4))
    assert placed.count() == 7 and {x.tenant_id: x.shard for x in placed.collect()} == {k: HashRing(4).shard(k or "") for k in ("0", "1", "2", "3", "4", "5", None)}


def test_attachments(spark):
    none = spark.createDataFrame([], "id string, tenant_id string, memory_id string, content_type string, filename string, size bigint, storage_key string, created_at timestamp")
    new = spark.createDataFrame([("1", "t", "m", "image/png", "a", bytearray(b"abc"), T0), ("2", "u", "m", "image/png", "b", bytearray(b""), T0)], "id string, tenant_id string, memory_id string, content_type string, filename string, content binary, created_at timestamp")
    a = at.put(none, new.unionByName(new))
    assert rows(at.put(a, new), "id", "size", "storage_key") == [("1", 3, "attachments/t/1"), ("2", 0, "attachments/u/2")]
    assert at.get(a, "u", "1").count() == 0 and at.get(a, "t", "1").count() == 1 and at.listed(a, "t", "n").count() == 0
    assert rows(at.removed(a, "t", a.select("id")), "id") == [("2",)]
    e = spark.createDataFrame([("1", "image", [1.0, 0.0]), ("2", "image", [1.0, 0.0])], "id string, modality string, embedding array<double>")
    assert rows(at.search(e, a, "t", [1.0, 0.0], 5), "id") == [("1",)]


def test_modal_entries(spark):
    old = spark.createDataFrame([("1", "a", [1.0, 2.0])], "id string, modality string, embedding array<double>")
    new = spark.createDataFrame([("1", "a", [3.0, 4.0]), ("1", "b", [1.0])], old.schema)
    assert rows(v.modal_upsert(old, new), "modality", "embedding") == [("a", [3.0, 4.0]), ("b", [1.0])]
    with pytest.raises(Exception, match="another dimension than 2"):
        v.modal_upsert(old, spark.createDataFrame([("2", "a", [1.0])], old.schema)).collect()


def test_typed_rows(spark):
    df = spark.sql("select true as b, 5L as n, 1.5D as d, double('NaN') as x, cast('1.20' as decimal(5,2)) as m, date'2024-01-02' as day, timestamp'2024-01-01 10:00:00.25' as t, 'é\"' as s, cast(null as int) as z, array(1D, double('inf')) as a, named_struct('k', timestamp'2024-01-01 00:00:00') as r, X'6162' as bin")
    got = json.loads(results.json_rows(df).first().row)
    assert got == {"b": True, "n": 5, "d": 1.5, "x": None, "m": "1.20", "day": "2024-01-02", "t": "2024-01-01T10:00:00.250000+00:00", "s": 'é"', "z": None, "a": [1.0, None], "r": {"k": "2024-01-01T00:00:00+00:00"}, "bin": "YWI="}
    answer = results.json_answer(spark.range(5), 3)
    assert len(answer["rows"]) == 3 and answer["truncated"] and answer["columns"] == [{"name": "id", "type": "bigint"}]
    none = spark.createDataFrame([], "version int")
    assert results.schema_version(none).first().version == 0 and results.pending([2, 1], none) == [1, 2]


def test_guard_knows_what_it_lets_through(spark):
    for good in ("select upper('a'), count(*) over (), row_number() over (order by 1), explode(array(1))", "select * from range(3)", "select try_cast('1' as int), sum(id) filter (where id > 1) from (select 1 as id)"):
        sg.inspect(spark, good)
    for bad in ("select reflect('a', 'b')", "select java_method('a', 'b')", "select no_such_function(1)", "select current_user()", "select version()", "select input_file_name()", "select * from read_csv('x')", "select * from my_table_function(1)", "select raise_error('x')"):
        with pytest.raises(sg.Refused):
            sg.inspect(spark, bad)


def test_stored_views(spark, tmp_path):
    views = sg.MaterializedViews(spark, f"file://{tmp_path}/mv")
    assert views.list() == []
    views.create("two", "select id\nfrom range(2)")
    again = sg.MaterializedViews(spark, f"file://{tmp_path}/mv")
    assert again.list() == ["two"] and again.refresh("two").count() == 2
    with pytest.raises(sg.Refused):
        again.create("bad name", "select 1")
    again.drop("two")
    assert views.list() == []
    with pytest.raises(sg.Refused):
        views.refresh("two")


def test_restore_keeps_what_was_there(spark, tmp_path):
    base = f"file://{tmp_path}"
    sinks.backup({"t": spark.range(3)}, f"{base}/b")
    spark.range(1).write.parquet(f"{base}/live/t")
    assert sinks.restore(spark, f"{base}/b", f"{base}/live")["t"].count() == 3
    assert not (tmp_path / "live.before").exists() and not (tmp_path / "live.staged").exists()


def test_no_private_folder_on_a_cluster():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        shared.shared_dir(session("spark://host:7077", None))
    assert shared.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared.shared_dir(session("local[2]", None)).startswith("file:///")


def test_long_path_and_communities(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(66)] + [("n000", "m"), ("m", "n002"), ("n066", "n000"), ("x", "y")]
    e = spark.createDataFrame(chain, "src string, dst string")
    assert g.shortest_path(e, "n000", "n066") == ["n000", "m", *[f"n{i:03d}" for i in range(2, 67)]]
    assert g.shortest_path(e, "y", "x") is None and g.shortest_path(e, "q", "q") == ["q"]
    got = g.communities(e).collect()
    assert {(x.place, x.size) for x in got} == {(0, 68), (1, 2)} and sorted(x.node for x in got if x.place == 1) == ["x", "y"]


def test_links_into_a_table(spark):
    kinds = "id string, tenant_id string, src string, relation string, dst string, weight double, valid_from timestamp, valid_to timestamp, state string, invalidated_by string, created_at timestamp"
    old = spark.createDataFrame([("1", "t", "a", "r", "x", 1.0, T0, None, "active", None, T0), ("2", "t", "a", "q", "x", 1.0, T0, None, "active", None, T0)], kinds)
    d = lambda n: T0 + timedelta(days=n)
    new = spark.createDataFrame([("3", "t", "a", "r", "y", 1.0, d(2)), ("4", "t", "a", "r", "z", 1.0, d(3))], "id string, tenant_id string, src string, relation string, dst string, weight double, valid_from timestamp")
    got = {x.id: (x.state, x.valid_to, x.invalidated_by) for x in g.linked(old, new).collect()}
    assert got == {"1": ("superseded", d(2), "3"), "2": ("active", None, None), "3": ("superseded", d(3), "4"), "4": ("active", None, None)}
    assert g.add_edges(old, old.limit(1)).count() == 2


def test_wildcards_meet_once(spark):
    r_ = spark.createDataFrame([("1", "a", "k"), ("2", "b", None), ("3", None, "k")], "id string, source string, kind string")
    p = spark.createDataFrame([("all", "*", "*"), ("a", "a", "*"), ("k", "*", "k"), ("ak", "a", "k"), ("none", None, "*")], "p string, s string, t string")
    assert rows(wildcard_match(r_, p, {"s": "source", "t": "kind"}), "id", "p") == sorted([("1", x) for x in ("a", "ak", "all", "k")] + [("2", "all"), ("3", "all"), ("3", "k")])
    assert wildcard_match(r_, p.limit(0), {"s": "source", "t": "kind"}).count() == 0


def test_graph_arm_and_batches(spark):
    data = [(f"m{i}", "t", f"note {i} about tea" if i < 3 else f"plain {i}", 1.0 - i / 10, "active", T0, 0, [1.0, float(i)]) for i in range(6)]
    mem = spark.createDataFrame(data, "id string, tenant_id string, content string, importance double, state string, valid_from timestamp, updated_us bigint, embedding array<double>")
    edge = spark.createDataFrame([("e1", "t", "coffee bar", "x", 2.0, "m5", "active"), ("e2", "other", "coffee", "x", 9.0, "m4", "active"), ("e3", "t", "coffee", "x", 1.0, "gone", "active"), ("e4", "t", "coffee", "x", 1.0, "m3", "superseded")], "id string, tenant_id string, src string, dst string, weight double, source_memory_id string, state string")
    hits = r.memory_search(mem, F.col("tenant_id") == "t", "coffee", 5, 0, edges=edge, scan_cap=1, tenant="t")
    assert [x.id for x in hits.collect()] == ["m5"]  # beyond the one lexical candidate, and of this tenant alone
    asked = spark.createDataFrame([(1, "tea", [1.0, 5.0]), (2, "tea", None), (3, "nothing", None), (4, "", [1.0, float("nan")])], "qid int, query string, vector array<double>")
    got = {}
    for x in r.memory_search_batch(mem, F.col("tenant_id") == "t", asked, 3, 0).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append((x.id, round(x.score, 9)))
    alone = lambda q, vec: [(x.id, round(x.score, 9)) for x in r.memory_search(mem, F.col("tenant_id") == "t", q, 3, 0, vec).collect()]
    assert got == {1: alone("tea", [1.0, 5.0]), 2: alone("tea", None)}
    assert [x.score for x in r.memory_search(mem, F.col("tenant_id") == "t", "nothing", 2, 0).collect()] == [0.0, 0.0]
    assert r.list_active(mem, F.lit(True), 20_000).count() == 6


def test_history_merges(spark):
    import random

    rng = random.Random(8)
    row = lambda i: (f"r{i}", rng.choice(["hot", "hot", "b", "c"]), rng.randrange(40), rng.choice([None, rng.randrange(1, 60)]), rng.randrange(3), rng.choice("xyz"))
    data = [row(i) for i in range(200)]
    data += [(r_[0], "b", *r_[2:]) for r_ in data[:10]]  # sent again for another entity
    df = spark.createDataFrame(data, "id string, entity string, s bigint, e bigint, v bigint, c string")
    log = h.update_log(df, F.col("entity"), [F.col("c")], "s", "e", "v", "id")
    whole = rows(h.versions(log))
    for cut in (0, 60, 200):
        a = log.join(spark.createDataFrame([(r_[0],) for r_ in data[:cut]] or [("-",)], "id string").distinct(), "id", "left_semi").limit(10_000) if cut else log.limit(0)
        b = h.update_log(spark.createDataFrame(data[cut:] or data[:1], df.schema), F.col("entity"), [F.col("c")], "s", "e", "v", "id")
        assert rows(h.merged_updates(h.versions(a), a, b)) == whole


def test_snapshots(spark):
    none = spark.createDataFrame([], "entity string, from_us bigint, to_us bigint, attr_hash bigint")
    snap = lambda x: spark.createDataFrame(x, "entity string, attr_hash bigint")
    one = h.merged_snapshot(none, snap([("a", 1), ("b", 2), (None, 3), ("a", 1)]), 10)
    two = h.merged_snapshot(one, snap([("a", 1), ("b", 5), ("c", 7)]), 20)
    three = h.merged_snapshot(two, snap([("b", 5)]), 30)
    assert rows(three) == [("a", 10, 30, 1), ("b", 10, 20, 2), ("b", 20, -1, 5), ("c", 20, 30, 7)]
    assert rows(h.merged_snapshot(two, snap([("b", 6)]), 20, complete=False)) == [("a", 10, -1, 1), ("b", 10, 20, 2), ("b", 20, -1, 6), ("c", 20, -1, 7)]


def test_a_hub_of_other_blocks(spark):
    n = 20_000
    data = [("hub", None, "h")] + [(f"c{i}", "HUB ", f"t{i % 900}") for i in range(n)] + [("leaf", "c7", "z")]
    df = spark.createDataFrame(data, "id string, parent string, near string")
    out = hierarchy(df, "id", "parent", "near")
    assert "IN (" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.id: (x.root_id, x.depth, x.n_descendants) for x in out.collect()}
    assert got["hub"] == ("hub", 0, n + 1) and got["c7"] == ("hub", 1, 1) and got["leaf"] == ("hub", 2, 0) and len(got) == n + 2
    few = descendants(df.filter("id in ('hub', 'c7', 'leaf')"), "id", "parent", "near")
    assert rows(few) == [("c7", "leaf", 1), ("hub", "c7", 1), ("hub", "leaf", 2)]


def test_state_verbs(spark):
    s = spark.createDataFrame([("a", "t", "ag", T0)], "session_id string, tenant_id string, agent_id string, started_at timestamp")
    assert st.session_start(s, s.unionByName(s.withColumn("session_id", F.lit("b")))).count() == 2
    e = spark.createDataFrame([(str(i), "a", "t", T0 + timedelta(minutes=i)) for i in range(4)], "id string, session_id string, tenant_id string, ts timestamp")
    assert [x.id for x in st.recalled(s, e, "t", "a", 2).collect()] == ["2", "3"] and st.recalled(s, e, "u", "a", 2).count() == 0
    assert [x.id for x in st.run_trace(e, "a").collect()] == ["0", "1", "2", "3"]


def test_notes_become_memories_and_edges(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "A.md").write_text("Body [[B]] [[C]]")
    kept = []
    sp.run_available(sp.watched_notes(spark, f"file://{tmp_path}/n"), f"{tmp_path}/c", lambda df, _: kept.extend(df.collect()))
    (tmp_path / "n" / "B.md").write_text("More")
    sp.run_available(sp.watched_notes(spark, f"file://{tmp_path}/n"), f"{tmp_path}/c", lambda df, _: kept.extend(df.collect()))
    assert [x.path.rsplit("/", 1)[1] for x in kept] == ["A.md", "B.md"]
    made, links = ingest.note_rows(ingest.notes(spark.createDataFrame([(x.path, x.value) for x in kept], "path string, value string")), "t", F.lit(T0))
    assert rows(made, "subject", "content") == [("A", "Body [[B]] [[C]]"), ("B", "More")] and rows(links, "src", "dst") == [("A", "B"), ("A", "C")]
    assert {x.id for x in links.collect()} == {x.id for x in links.collect()}


def test_periodic_loop(spark, tmp_path):
    import time

    seen = []
    q = sp.periodic("loop", 0.2, seen.append, spark, f"{tmp_path}/c")
    for _ in range(100):
        if len(seen) >= 2:
            break
        time.sleep(0.2)
    q.stop()
    assert seen[:2] == [0, 1]


def test_blobs(spark, tmp_path):
    from memlake.sources.blobs import Blobs

    b = Blobs(spark, f"file://{tmp_path}/blobs")
    assert b.list() == [] and b.get("x") is None
    b.put("a/1", b"one\x00")
    b.put("a/1", b"two\xff")
    b.put("b", b"")
    assert b.get("a/1") == b"two\xff" and b.get("b") == b"" and b.list() == ["a/1", "b"] and b.list("a/") == ["a/1"]
    assert b.delete("a/1") and not b.delete("a/1") and b.list() == ["b"]
    with pytest.raises(ValueError):
        b.put("../x", b"")


def test_text_store_and_completions(spark, tmp_path):
    from memlake.adapters import TextStore, completed

    asked = []

    def letters(texts):
        asked.extend(texts)
        return [[float(t.count(c)) for c in "bcd"] for t in texts]

    s = TextStore(spark, f"file://{tmp_path}/texts", letters, "t", "e5-small")
    ids = s.add_texts(["bbb", "ccc", "bcd"], [{"n": 1}, {"n": 2}, {"n": 3}])
    assert [t for t, _ in s.similarity_search("bc", 1)] == ["bcd"] and asked[-1] == "query: bc"
    s.add_texts(["ddd"], ids=[ids[0]])
    s.delete([ids[1]])
    assert sorted(r_.content for r_ in s.query("d", 9).collect()) == ["bcd", "ddd"]
    assert TextStore(spark, f"file://{tmp_path}/texts", letters, "other").query("c", 9).count() == 0
    df = spark.createDataFrame([("x",), (None,)], "q string")
    assert rows(completed(df, "q", lambda p: [t.upper() for t in p]), "answer") == [("",), ("X",)]
    assert completed(df, "q", lambda p: 1 / 0).filter("answer is null").count() == 2
