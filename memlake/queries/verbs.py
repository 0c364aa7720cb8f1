"""Further verbs of the engine: vectors and attachments, grants, joins, state, sinks, placement and the SQL front door."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.scalars import HashRing, scope_key
from memlake.operators import attachments as at
from memlake.operators import events as ev
from memlake.operators import graph as g
from memlake.operators import memory as m
from memlake.operators import retrieval as r
from memlake.operators import state as st
from memlake.operators import vector as v
from memlake.plans import results
from memlake.plans.shared import shared_dir
from memlake.plans.sql_guard import TenantSql
from memlake.queries.memory import _COS, _EDGES, _ONCE, TENANT, edges, memories, query_vector
from memlake.queries.registry import MIDDLE, NOW, NOW_US, Registry, instant, load, us
from memlake.sources import ingest, sinks

query = Registry()


# --- SQL front door ------------------------------------------------------------------------------------------------
def _door(spark: SparkSession, d: str) -> TenantSql:
    e = load(spark, d, "episodic")
    m_ = memories(spark, d)
    state = e.filter("tenant_id is not null").groupBy("tenant_id", F.lit("a-1").alias("agent_id"), F.col("event_type").alias("key")).agg(F.max("id").alias("value"), F.count(F.lit(1)).alias("version"))

    def search(text: str, k: int, tenant: str) -> DataFrame:
        return r.bm25(r.list_active(m_, F.col("tenant_id") == tenant, 2048), text).orderBy(F.desc("score"), "id").limit(k).join(m_.select("id", "content"), "id").select("id", "content", "score")

    return TenantSql(spark, {"episodic": e, "memories": m_}, search, state, max_rows=1_000_000)


@query(rf"select id, contains(lower(content), 'bicycle') as named from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' and regexp_matches(lower(content), '(^|[^\p{{L}}\p{{N}}])bicycles?([^\p{{L}}\p{{N}}]|$)')")
def q06_search_table(spark: SparkSession, d: str) -> DataFrame:
    """A search that stands in FROM, asked for more hits than there are."""
    return _door(spark, d).query("SELECT id, contains(lower(content), 'bicycle') AS named FROM memory_hits('bicycle', k => 100000)", TENANT)


@query(f"select key, value, version from (select event_type as key, max(id) as value, count(*)::bigint as version from episodic where tenant_id = '{TENANT}' group by 1) where key = 'ticket.closed'")
def q07_state_table(spark: SparkSession, d: str) -> DataFrame:
    return _door(spark, d).query("SELECT key, value, version FROM agent_state('a-1', 'ticket.closed')", TENANT)


@query(f"""select e.source, s.version, count(*)::bigint as n from episodic e cross join (select count(*)::bigint as version from episodic where tenant_id = '{TENANT}' and event_type = 'ticket.closed' having count(*) > 0) s
where e.tenant_id = '{TENANT}' and e.source in (select source from episodic where tenant_id = '{TENANT}' and event_type like 'run.%') group by all""")
def q08_virtual_join(spark: SparkSession, d: str) -> DataFrame:
    s = """WITH busy AS (SELECT DISTINCT source FROM episodic WHERE event_type LIKE 'run.%')
    SELECT e.source, s.version, COUNT(*) AS n FROM episodic e CROSS JOIN agent_state('a-1', 'ticket.closed') s WHERE e.source IN (SELECT source FROM busy) GROUP BY 1, 2"""
    return _door(spark, d).query(s, TENANT)


@query(f"select id from episodic where tenant_id = '{TENANT}' order by ts, id limit 100")
def q09_row_cap(spark: SparkSession, d: str) -> DataFrame:
    return _door(spark, d).query("SELECT id FROM episodic ORDER BY ts, id", TENANT, max_rows=100)


@query(f"""select '{{"id":"' || id || '","version":' || version || ',"user":' || coalesce('"' || user_id || '"', 'null') || ',"held":' || (valid_to is null) || ',"from":"' || strftime(valid_from, '%Y-%m-%dT%H:%M:%S') ||
case when epoch_us(valid_from) % 1000000 = 0 then '' else '.' || lpad((epoch_us(valid_from) % 1000000)::varchar, 6, '0') end || '+00:00","sources":[' || array_to_string(list_transform(source_event_ids, lambda x: '"' || x || '"'), ',') || ']}}' as row from {_ONCE}""")
def q11_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).select("id", "version", F.col("user_id").alias("user"), F.col("valid_to").isNull().alias("held"), F.col("valid_from").alias("from"), F.col("source_event_ids").alias("sources"))
    return results.json_rows(rows)


@query("select coalesce(max(version), 0)::bigint as version from memories where state = 'superseded' and version > 3")
def a07_schema_version(spark: SparkSession, d: str) -> DataFrame:
    return results.schema_version(memories(spark, d).filter("state = 'superseded' and version > 3"))


@query(f"""select id, length(content)::bigint * 2 as weight from {_ONCE} where tenant_id = '{TENANT}' and content is not null""")
def x01_registered_function(spark: SparkSession, d: str) -> DataFrame:
    door = _door(spark, d)
    door.functions = {"memlake_weight": (lambda s: s.str.len() * 2, "bigint")}
    return door.query("SELECT id, memlake_weight(content) AS weight FROM memories WHERE content IS NOT NULL", TENANT)


# --- ingest --------------------------------------------------------------------------------------------------------
@query("""select id, '{"_tenant_id":"acme"' || case when regexp_full_match(payload, '\\s*\\{\\s*\\}\\s*') then '}' else ',' || regexp_replace(payload, '^\\s*\\{\\s*', '') end as payload, 'acme' as tenant_id from (select distinct id, payload from episodic) where regexp_matches(payload, '^\\s*\\{')""".replace("\\\\", "\\"))
def e04_tenant_tag(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").select("id", "payload").distinct().filter(r"payload rlike '^\\s*[{]'")
    return ingest.tenant_tagged(e, "acme").select("id", "payload", "tenant_id")


@query("select id, coalesce(embedded, false) or id in (select unnest(source_event_ids) from memories) as embedded from (select id, bool_or(embedded) as embedded from episodic group by 1)")
def e13_marked(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").groupBy("id").agg(F.bool_or("embedded").alias("embedded"))
    vectors = load(spark, d, "memories").select(F.explode("source_event_ids").alias("id"))
    return ingest.marked(e, vectors).select("id", F.coalesce("embedded", F.lit(False)).alias("embedded"))


@query()
def e12_embed_and_index(spark: SparkSession, d: str) -> DataFrame:
    """Every event without a vector, with a stand-in for a provider: letters counted."""
    letters = lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]
    return ingest.embedded_and_indexed(load(spark, d, "episodic"), letters).select("id", "tenant_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vowels"))


@query(f"""with old as (select idempotency_key from episodic where tenant_id = '{TENANT}'), k as (select *, row_number() over (partition by idempotency_key order by ts, id) as r from episodic where tenant_id <> '{TENANT}' or tenant_id is null)
select id, epoch_us(ts) as ts from k where idempotency_key is null or (r = 1 and idempotency_key not in (select idempotency_key from old where idempotency_key is not null))""")
def j09_append_to_table(spark: SparkSession, d: str) -> DataFrame:
    """One tenant's events are there; those of all others are appended."""
    e = load(spark, d, "episodic").drop("tags")
    own = F.coalesce(F.col("tenant_id") == TENANT, F.lit(False))
    return ingest.appendable(e.filter(own), e.filter(~own)).select("id", us("ts"))


@query("select vec_id::varchar as id, label % 3 as modality, (case when vec_id % 4 = 0 then 1 else 0 end)::int as fresh from embeddings")
def e16_modal_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), (F.col("label") % 3).alias("modality"), "embedding", F.lit(0).alias("fresh"), "vec_id")
    return v.modal_upsert(e.drop("vec_id"), e.filter("vec_id % 4 = 0").drop("vec_id").withColumn("fresh", F.lit(1))).select("id", "modality", "fresh")


# --- vectors and attachments ---------------------------------------------------------------------------------------
@query("select vec_id, label from embeddings order by vec_id limit 100")
def v05_entries(spark: SparkSession, d: str) -> DataFrame:
    return v.entries(load(spark, d, "embeddings"), 100, "vec_id").select("vec_id", "label")


@query("select vec_id, label, len(embedding)::int as dim from embeddings")
def v07_saved_index(spark: SparkSession, d: str) -> DataFrame:
    """Saved twice and loaded: the second state is what a reader finds."""
    e, folder = load(spark, d, "embeddings"), f"{shared_dir(spark)}/memlake-index-{uuid.uuid4().hex}"
    v.save_index(e.filter("label = 0"), folder)
    v.save_index(e, folder)
    return v.load_index(spark, folder).select("vec_id", "label", F.size("embedding").alias("dim"))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) where label <> 3 and {_COS} >= 0.1 order by {_COS} desc, vec_id limit 30")
def v08_embed_and_search(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in for a provider knows one question, with the prefix of its model."""
    q = query_vector(spark, d)
    known = lambda texts: [q if t == "search_query: where is it" else [0.0] * len(q) for t in texts]
    e = load(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    return v.embed_and_search(e, "where is it", known, 30, "nomic-embed-text", F.col("label") != 3, 0.1).select("vec_id", F.round("score", 6).alias("score"))


def _attachments(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.concat(F.lit("att-"), "doc_id").alias("id"), "tenant_id", F.col("source").alias("memory_id"), F.lit("text/plain").alias("content_type"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.col("updated_at").alias("created_at"))
    none = spark.createDataFrame([], "id string, tenant_id string, memory_id string, content_type string, filename string, size bigint, storage_key string, created_at timestamp")
    return at.put(none, docs.unionByName(docs.filter("content_type is null")))


_ATT = "select 'att-' || doc_id as id, tenant_id, source as memory_id, doc_id || '.txt' as filename, strlen(coalesce(text, ''))::bigint as size, concat_ws('/', 'attachments', tenant_id, 'att-' || doc_id) as storage_key, updated_at as created_at from documents"


@query(f"select id, size, storage_key from ({_ATT}) where tenant_id = '{TENANT}' and not ends_with(id, '7')")
def b23_attachments(spark: SparkSession, d: str) -> DataFrame:
    a = _attachments(spark, d)
    left = at.removed(a, TENANT, a.filter(F.col("id").endswith("7")).select("id"))
    return at.listed(left, TENANT).select("id", "size", "storage_key")


@query(f"""select id, filename, score from (select 'att-' || vec_id as id, round({_COS}, 6) as score, {_COS} as s from embeddings, (select embedding as q from embeddings where vec_id = 0) where label % 2 = 0) e join ({_ATT}) a using (id) where tenant_id = '{TENANT}' order by s desc, id limit 10""")
def v10_image_search(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.concat(F.lit("att-"), "vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "image").otherwise("text").alias("modality"), "embedding")
    return at.search(e, _attachments(spark, d), TENANT, query_vector(spark, d), 10).select("id", "filename", F.round("score", 6).alias("score"))


@query(f"""with h as (select vec_id as hit_id from embeddings, (select embedding as q from embeddings where vec_id = 0) order by {_COS} desc, vec_id limit 3)
select id, hit_id from (select distinct id from episodic where event_type = 'ticket.closed') cross join h""")
def j13_events_and_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = v.knn(load(spark, d, "embeddings").withColumn("id", F.col("vec_id")), query_vector(spark, d), 3)
    return v.joined_hits(load(spark, d, "episodic").filter("event_type = 'ticket.closed'").select("id").distinct(), hits).select("id", "hit_id")


# --- memories ------------------------------------------------------------------------------------------------------
_ALL = f"select *, trim(regexp_replace(lower(subject), '[\\s\\x{{00A0}}]+', ' ', 'g')) as j from {_ONCE}"


@query(f"""with a as ({_ALL}), k as (select tenant_id, user_id, agent_id, session_id, j, min(id) as keep from a where j <> '' group by all having count(*) > 1 order by count(*) desc, keep limit 1)
select a.id, 'superseded' as state, {NOW_US} as valid_to from a join k on a.j = k.j and a.tenant_id = k.tenant_id and a.user_id is not distinct from k.user_id and a.agent_id is not distinct from k.agent_id and a.session_id is not distinct from k.session_id where a.id <> k.keep""")
def b13_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The fullest subject, as if nothing had been closed: all but the smallest id give way."""
    mem = memories(spark, d).withColumn("state", F.lit("active"))
    top = m.contradictions(mem).withColumn("keep", F.element_at("ids", 1)).orderBy(F.desc("n"), "keep").first()
    return m.resolved(mem, m.Scope(top.tenant_id, top.user_id, top.agent_id, top.session_id), top.subject, top.keep, instant(NOW)).select("id", "state", us("valid_to"))


@query(f"select id from {_ONCE} where not (tenant_id = '{TENANT}' and coalesce(user_id, '') = 'u-00000001')")
def b21_user_erasure(spark: SparkSession, d: str) -> DataFrame:
    return m.erased({"memories": memories(spark, d)}, TENANT, "u-00000001")["memories"].select("id")


@query(f"select distinct tenant_id, src as grantee_user_id, dst as grantor_user_id from memory_edges where tenant_id = '{TENANT}' and src is not null and dst is not null and src <> 'tenant-wide'")
def b22_revoke(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "memory_edges").filter("src is not null and dst is not null").select("tenant_id", F.col("src").alias("grantee_user_id"), F.col("dst").alias("grantor_user_id"))
    all_ = m.add_grants(e.limit(0), e)
    return m.grants_of(m.revoked(all_, TENANT, all_.filter("grantee_user_id = 'tenant-wide'")), TENANT)


@query(f"""select 'from' as side, id from {_ONCE} where tenant_id <> '{TENANT}' union all select 'to', id from {_ONCE} where tenant_id = '{TENANT}' union all select 'to', id from {_ONCE} where tenant_id = 'verdigris'""")
def b25_migrate(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d)
    there = mem.filter(F.col("tenant_id").isin("verdigris", TENANT) & ((F.col("tenant_id") != TENANT) | (F.col("version") > 1)))
    a, b = m.migrated({"memories": (mem, there)}, TENANT)["memories"]
    return a.select(F.lit("from").alias("side"), "id").unionByName(b.select(F.lit("to").alias("side"), "id"))


@query(f"select id from {_EDGES} union all select 'new-' || id from {_EDGES} where state = 'active'")
def g01_add_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge sent again, and a copy of each active one under a new id, sent twice."""
    e = edges(spark, d)
    fresh = e.filter("state = 'active'").withColumn("id", F.concat(F.lit("new-"), "id"))
    return g.add_edges(e, e.unionByName(fresh).unionByName(fresh)).select("id")


@query(f"""with a as (select * from {_EDGES}), n as (select 'n-' || id as id, tenant_id, src, relation, timestamp '{NOW}' + to_microseconds(epoch_us(created_at) % 1000) as t from a where state <> 'active'),
m as (select *, lead(id) over w as nxt, lead(t) over w as until from n window w as (partition by tenant_id, src, relation order by t, id)), f as (select tenant_id, src, relation, min_by(id, (t, id)) as fid, min(t) as ft from n group by all)
select id, state, epoch_us(valid_to) as valid_to, invalidated_by from (
select a.id, case when a.state = 'active' and f.fid is not null then 'superseded' else a.state end as state, case when a.state = 'active' and f.fid is not null then f.ft else a.valid_to end as valid_to, case when a.state = 'active' and f.fid is not null then f.fid else a.invalidated_by end as invalidated_by
  from a left join f on a.tenant_id is not distinct from f.tenant_id and a.src is not distinct from f.src and a.relation is not distinct from f.relation
union all select id, case when nxt is null then 'active' else 'superseded' end, until, nxt from m)""")
def g02_linked(spark: SparkSession, d: str) -> DataFrame:
    """A functional link for each closed edge, into the table of edges."""
    e = edges(spark, d)
    when = F.timestamp_micros(F.lit(NOW_US) + F.unix_micros("created_at") % 1000)
    new = e.filter("state <> 'active'").select(F.concat(F.lit("n-"), "id").alias("id"), "tenant_id", "src", "relation", "dst", "weight", when.alias("valid_from"))
    return g.linked(e, new).select("id", "state", us("valid_to"), "invalidated_by")


@query(f"""with o as (select row_number() over (order by valid_from, id) % 3 as shard, id, importance from {_ONCE}), t as (select id, importance, row_number() over (partition by shard order by importance desc, id) as r from o)
select id, round(importance, 6) as score from (select id, importance from o order by importance desc, id limit 20)""")
def h10_cross_shard(spark: SparkSession, d: str) -> DataFrame:
    """The best of three shards' own best."""
    mem = ev.sharded(memories(spark, d), HashRing(3), "id")
    shards = [mem.filter(F.col("shard") == i).select("id", F.col("importance").alias("score")).orderBy(F.desc("score"), "id").limit(20) for i in range(3)]
    return r.merged_shards(shards, 20).select("id", F.round("score", 6).alias("score"))


@query(f"""with e as (select distinct on (id) * from episodic where tenant_id = '{TENANT}'), m as (select * from {_ONCE} where tenant_id = '{TENANT}' and state = 'active')
select 'recent' as part, row_number() over (order by ts desc, id)::int as place, '[' || source || '] ' || event_type || ': ' || coalesce(payload, '')[1:300] as line from (select * from e where source is not null and event_type is not null order by ts desc, id limit 5)
union all select 'memory', row_number() over (order by importance desc, id)::int, coalesce(content, '')[1:300] from (select * from m order by importance desc, id limit 5)
union all select 'similar', row_number() over (order by importance desc, id)::int, coalesce(content, '')[1:300] from (select * from m where importance >= 0.3 order by importance desc, id limit 5)""")
def h11_rag_context(spark: SparkSession, d: str) -> DataFrame:
    """Importance stands in for both scores."""
    e = load(spark, d, "episodic").filter((F.col("tenant_id") == TENANT) & F.col("source").isNotNull() & F.col("event_type").isNotNull()).dropDuplicates(["id"])
    hits = memories(spark, d, TENANT).filter("state = 'active'").withColumn("score", F.col("importance"))
    return r.rag_context(hits, e, hits)


# --- joins ---------------------------------------------------------------------------------------------------------
@query("select n_name, s.s_suppkey from supplier s right join nation on s_nationkey = n_nationkey and s_acctbal > 9000")
def j12_right_join(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").filter("s_acctbal > 9000")
    return s.join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@query("select r_name, n_name from region cross join nation where n_regionkey <> r_regionkey")
def j12_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Five regions with twenty-five nations."""
    return load(spark, d, "region").crossJoin(F.broadcast(load(spark, d, "nation"))).filter("n_regionkey <> r_regionkey").select("r_name", "n_name")


@query("select c.c_custkey, o.o_orderkey, o.o_totalprice from customer c, lateral (select o_orderkey, o_totalprice from orders where o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 2) o")
def j12_lateral_join(spark: SparkSession, d: str) -> DataFrame:
    for t in ("customer", "orders"):
        load(spark, d, t).createOrReplaceTempView(f"lateral_{t}")
    return spark.sql("select c.c_custkey, o.o_orderkey, o.o_totalprice from lateral_customer c, lateral (select o_orderkey, o_totalprice from lateral_orders where o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 2) o")


@query("select session_id, count(*)::bigint as n from (select distinct id, session_id from episodic) join (select distinct session_id, agent_id from sessions) using (session_id) group by 1")
def j12_using(spark: SparkSession, d: str) -> DataFrame:
    e, s = load(spark, d, "episodic").select("id", "session_id").distinct(), load(spark, d, "sessions").select("session_id", "agent_id").distinct()
    return e.join(s, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


# --- state, runs, audit --------------------------------------------------------------------------------------------
@query(f"""select id, epoch_us(ts) as ts from (select distinct id, ts from episodic where tenant_id = '{TENANT}' and session_id = (select min(session_id) from episodic where tenant_id = '{TENANT}' and session_id in (select session_id from sessions where tenant_id = '{TENANT}')) order by ts desc, id desc limit 20)""")
def t10_recall(spark: SparkSession, d: str) -> DataFrame:
    s, e = load(spark, d, "sessions"), load(spark, d, "episodic").select("id", "ts", "session_id", "tenant_id").distinct()
    own = e.filter(F.col("tenant_id") == TENANT).join(s.filter(F.col("tenant_id") == TENANT).select("session_id").distinct(), "session_id", "left_semi")
    return st.recalled(s, e, TENANT, own.agg(F.min("session_id").alias("s")).first().s, 20).select("id", us("ts"))


_LEDGER = "select trace_id as id, event_type as status, source as agent, session_id as note, ts as t0, id as eid from (select distinct id, trace_id, event_type, source, session_id, ts from episodic) where trace_id is not null"


@query(f"""select id, max_by(status, (t0, status)) filter (where status is not null) as status, max_by(agent, (t0, agent)) filter (where agent is not null) as agent, max_by(note, (t0, note)) filter (where note is not null) as note, epoch_us(min(t0)) as created_at, epoch_us(max(t0)) as updated_at
from ({_LEDGER}) group by 1""")
def t13_run_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").select("id", "trace_id", "event_type", "source", "session_id", "ts").distinct().filter("trace_id is not null")
    log = e.select(F.col("trace_id").alias("id"), F.col("event_type").alias("status"), F.col("source").alias("agent"), F.col("session_id").alias("note"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return st.fold_runs(log).select("id", "status", "agent", "note", us("created_at"), us("updated_at"))


@query(f"select {NOW_US} as at, identity, path, status from audit_log where identity is not null and identity <> '' and method = 'POST'")
def t15_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return ev.audit_rows(load(spark, d, "audit_log").filter("method = 'POST'"), instant(NOW)).select(us("timestamp", "at"), "identity", "path", "status")


# --- sinks and placement -------------------------------------------------------------------------------------------
@query(f"select id, version, state from {_ONCE}")
def k02_backup_and_restore(spark: SparkSession, d: str) -> DataFrame:
    """Backed up, restored over something else, and read back."""
    base = f"{shared_dir(spark)}/memlake-backup-{uuid.uuid4().hex}"
    sinks.backup({"memories": memories(spark, d).select("id", "version", "state")}, f"{base}/b1")
    spark.range(3).write.parquet(f"{base}/live/memories")
    return sinks.restore(spark, f"{base}/b1", f"{base}/live")["memories"]


@query(f"select id, concat_ws(chr(31), coalesce(nullif(tenant_id, ''), 'default'), coalesce(user_id, ''), coalesce(agent_id, ''), coalesce(session_id, '')) as scope from {_ONCE}")
def s_scope_key(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("id", scope_key(*[F.col(c) for c in m.SCOPE]).alias("scope"))


@query("select doc_id, sha256(coalesce(text, '')) as digest from documents")
def s_sha256(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query()
def x14_resharding(spark: SparkSession, d: str) -> DataFrame:
    """The memories that move when three shards become four."""
    return ev.moved(memories(spark, d).select("id", "tenant_id"), HashRing(3), HashRing(4)).select("id", "from_shard", "to_shard")


@query(f"select id from {_ONCE} where tenant_id = '{TENANT}' and user_id in ('u-00000001', 'u-00000003', 'u-00000005')")
def x12_authorised(spark: SparkSession, d: str) -> DataFrame:
    backend = lambda tenant, user: spark.createDataFrame([("u-00000003",), ("u-00000005",), ("u-00000003",)], "grantor_user_id string")
    return ev.authorised(memories(spark, d), backend, TENANT, "u-00000001").select("id")


QUERIES, ORACLES = query.queries, query.sql
