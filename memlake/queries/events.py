"""Events, sessions, audit, SQL front door, ingest and relational coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.scalars import json_text, parse_ts
from memlake.operators import events as ev
from memlake.operators import state as st
from memlake.operators.joins import as_of_join, wildcard_match
from memlake.operators.retrieval import nearest_rank
from memlake.plans.sql_guard import TenantSql
from memlake.queries.registry import MIDDLE, NOW, NOW_US, Registry, instant, load, us
from memlake.sources import ingest, sinks

query = Registry()
TENANT = "larkfield"


def sql_door(spark: SparkSession, d: str) -> TenantSql:
    return TenantSql(spark, {t: load(spark, d, t) for t in ("episodic", "sessions", "memories", "memory_edges")}, max_rows=1_000_000)


# --- SQL front door and events -------------------------------------------------------------------------------------
@query(f"select source, event_type, count(*)::bigint as n from episodic where tenant_id = '{TENANT}' group by 1, 2")
def q03_tenant_sql(spark: SparkSession, d: str) -> DataFrame:
    return sql_door(spark, d).query("SELECT source, event_type, COUNT(*) AS n FROM episodic GROUP BY 1, 2", TENANT)


@query(f"""select json_extract_string(metadata, '$.lang') as lang, count(*)::bigint as n, max(epoch_us(updated_at)) as last from memories
where tenant_id = '{TENANT}' and json_extract_string(metadata, '$.lang') is not null group by 1""")
def q08_dialect_sql(spark: SparkSession, d: str) -> DataFrame:
    s = "SELECT metadata->>'lang' AS lang, COUNT(*)::BIGINT AS n, cast(max(EXTRACT(EPOCH FROM updated_at)) * 1e6 as bigint) AS last FROM memories WHERE metadata->>'$.lang' IS NOT NULL GROUP BY 1"
    return sql_door(spark, d).query(s, TENANT)


@query(f"""select s.agent_id, count(*)::bigint as n_events, count(distinct e.session_id)::bigint as n_sessions from episodic e
join (select distinct session_id, agent_id from sessions where tenant_id = '{TENANT}') s on e.session_id = s.session_id where e.tenant_id = '{TENANT}' group by 1""")
def q05_cross_store_sql(spark: SparkSession, d: str) -> DataFrame:
    s = """SELECT s.agent_id, COUNT(*) AS n_events, COUNT(DISTINCT e.session_id) AS n_sessions FROM episodic e
    JOIN (SELECT DISTINCT session_id, agent_id FROM sessions) s ON e.session_id = s.session_id GROUP BY 1"""
    return sql_door(spark, d).query(s, TENANT)


@query("select distinct source from episodic")
def q12_sources(spark: SparkSession, d: str) -> DataFrame:
    return ev.sources(load(spark, d, "episodic"))


@query("select user_id, agent_id, session_id, count(*)::bigint as n from memories where state = 'active' group by all order by n desc, user_id nulls first, agent_id nulls first, session_id nulls first limit 10000")
def q12_scopes(spark: SparkSession, d: str) -> DataFrame:
    return ev.scopes(load(spark, d, "memories"))


@query("select distinct agent_id[3:] as agent_id from (select 'a-' || agent_id as agent_id from sessions where agent_id is not null)")
def q12_agents(spark: SparkSession, d: str) -> DataFrame:
    state = load(spark, d, "sessions").filter("agent_id is not null").select(F.concat(F.lit("a-"), "agent_id").alias("agent_id"))
    return ev.agents(state, "a-")


@query(f"select id, source, epoch_us(ts) as ts from episodic where source = 'billing-bot' and event_type like 'ticket.%' and ts >= timestamp '2018-01-03' order by ts desc, id limit 500")
def q13_event_builder(spark: SparkSession, d: str) -> DataFrame:
    built = ev.EventQuery().source("billing-bot").event_type("ticket.*").since(instant("2018-01-03")).order_by("ts").limit(500)
    return built.over(load(spark, d, "episodic")).select("id", "source", us("ts"))


@query(f"select id, epoch_us(ts) as ts, event_type from episodic where ts >= timestamp '2018-01-05' and ts <= timestamp '{MIDDLE}'")
def f02_time_range(spark: SparkSession, d: str) -> DataFrame:
    return ev.in_time_range(load(spark, d, "episodic"), instant("2018-01-05"), instant(MIDDLE)).select("id", us("ts"), "event_type")


@query("select id, epoch_us(ts) as ts from episodic where source = 'desk-assistant' order by ts desc, id limit 100")
def f03_by_source(spark: SparkSession, d: str) -> DataFrame:
    return ev.of_source(load(spark, d, "episodic"), "desk-assistant", 100).select("id", us("ts"))


@query(f"select id, epoch_us(ts) as ts from episodic where tenant_id = '{TENANT}' order by ts, id limit 10000")
def f05_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return ev.of_tenant(load(spark, d, "episodic"), TENANT, 10_000).select("id", us("ts"))


@query(f"select id, epoch_us(ts) as ts from episodic where tenant_id = '{TENANT}' and id in (select unnest(source_event_ids) from memories)")
def f04_events_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "memories").select(F.explode("source_event_ids").alias("id"))
    return ev.of_ids(load(spark, d, "episodic"), ids, TENANT).select("id", us("ts"))


@query(f"""select epoch_us("timestamp") as at, identity, path, status from audit_log where "timestamp" >= timestamp '{MIDDLE}' and tenant = 'dunlin' order by "timestamp" desc, identity, path limit 1000""")
def f15_audit_since(spark: SparkSession, d: str) -> DataFrame:
    return st.audit_since(load(spark, d, "audit_log"), instant(MIDDLE), "dunlin").select(us("timestamp", "at"), "identity", "path", "status")


@query("""select identity, case when status_code >= 400 then 'bad' else 'ok' end as verdict, path from (select identity, status as status_code, path, method, duration_ms from audit_log) t
where method in ('GET', 'POST') and duration_ms between 5 and 50 and path like '/v1/%' and status_code in (select distinct status from audit_log where status >= 400)""")
def f16_arbitrary_sql(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "audit_log").createOrReplaceTempView("audit_view")
    return spark.sql("""select identity, case when status_code >= 400 then 'bad' else 'ok' end as verdict, path from (select identity, status as status_code, path, method, duration_ms from audit_view) t
    where method in ('GET', 'POST') and duration_ms between 5 and 50 and path like '/v1/%' and status_code in (select distinct status from audit_view where status >= 400)""")


# --- ingest --------------------------------------------------------------------------------------------------------
@query("""with k as (select *, row_number() over (partition by idempotency_key order by ts, id) as r from episodic)
select id, idempotency_key, epoch_us(ts) as ts from k where idempotency_key is null or r = 1""")
def e03_idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").drop("tags")
    return ingest.appendable(None, e).select("id", "idempotency_key", us("ts"))


@query("""with v as (select event_id, case event_type when 'signup' then 'github' when 'error' then 'sentry' when 'click' then 'slack' when 'view' then 'pagerduty' else 'shop' end as vendor,
  event_id % 4 as kind, user_id from events),
b as (select *, case vendor when 'github' then '{"action":"opened","repository":{"full_name":"org/r' || user_id || '"}' || case kind when 0 then ',"pull_request":{"n":1}' when 1 then ',"issue":{"n":1}' when 2 then ',"commits":[]' else '' end || '}' else '{"action":"opened"}' end as raw from v)
select event_id, case vendor when 'github' then '{"action":"opened","repository":"org/r' || user_id || '","sender":"unknown","raw":' || raw || '}'
    when 'sentry' then '{"project":"p' || user_id || '","title":"","level":"error","action":"opened"}' when 'slack' then '{"channel":"c' || user_id || '","user":"unknown","text":"hi"}'
    when 'pagerduty' then '{"service":"s' || user_id || '","title":"","event_type":"incident.trigger"}' else raw end as payload,
  case vendor when 'github' then 'github/org/r' || user_id when 'sentry' then 'sentry/p' || user_id when 'slack' then 'slack/c' || user_id when 'pagerduty' then 'pagerduty/s' || user_id else 'shop' end as source,
  case vendor when 'github' then case kind when 0 then 'pull_request.opened' when 1 then 'issue.opened' when 2 then 'push' else 'github.opened' end
    when 'sentry' then 'issue.opened' when 'slack' then 'message' when 'pagerduty' then 'incident.trigger' else 'opened' end as event_type
from b""")
def e10_webhooks(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") == "signup", "github").when(F.col("event_type") == "error", "sentry").when(F.col("event_type") == "click", "slack").when(F.col("event_type") == "view", "pagerduty").otherwise("shop")
    extra = F.element_at(F.array(F.lit(',"pull_request":{"n":1}'), F.lit(',"issue":{"n":1}'), F.lit(',"commits":[]'), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    u = F.col("user_id").cast("string")
    body = (
        F.when(v == "github", F.concat(F.lit('{"action":"opened","repository":{"full_name":"org/r'), u, F.lit('"}'), extra, F.lit("}")))
        .when(v == "sentry", F.concat(F.lit('{"action":"opened","project_slug":"p'), u, F.lit('"}')))
        .when(v == "slack", F.concat(F.lit('{"event":{"channel":"c'), u, F.lit('","text":"hi"}}')))
        .when(v == "pagerduty", F.concat(F.lit('{"event":{"data":{"service":{"name":"s'), u, F.lit('"}}}}')))
        .otherwise(F.lit('{"action":"opened"}'))
    )
    raw = load(spark, d, "events").select("event_id", v.alias("vendor"), body.alias("body"))
    return ingest.webhook_events(raw).select("event_id", "source", "event_type", "payload")


@query()
def e11_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return ingest.with_embedding_text(load(spark, d, "episodic"))


@query("select id, epoch_us(ts) as ts from episodic where embedded is not true")
def e13_unembedded(spark: SparkSession, d: str) -> DataFrame:
    return ingest.unembedded(load(spark, d, "episodic")).select("id", us("ts"))


@query(r"""with t as (select distinct session_id, summary || chr(10) || chr(10) || agent_id || chr(10) || ' ' || chr(10) || summary || chr(10) || chr(10) || session_id || '!' as t from sessions where summary <> ''),
p as (select session_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') as p from t),
c as (select session_id, string_split(list_reduce(p, lambda a, x: case when length(string_split(a, chr(1))[-1]) + length(x) + 2 <= 40 then a || chr(10) || chr(10) || x else a || chr(1) || x end), chr(1)) as c from p),
k as (select session_id, list_filter(c, lambda x: length(x) >= 14) as c from c)
select session_id as id, (i - 1)::int as index, len(c)::int as total, c[i] as chunk from (select *, unnest(range(1, len(c) + 1)) as i from k)""")
def e25_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Four paragraphs of each session, packed to chunks of 40 characters; those under 14 are dropped."""
    s = load(spark, d, "sessions").filter("summary <> ''").select("session_id", "summary", "agent_id").distinct()
    text = F.concat("summary", F.lit("\n\n"), "agent_id", F.lit("\n \n"), "summary", F.lit("\n\n"), "session_id", F.lit("!"))
    return ingest.chunks(s.select("session_id", text.alias("text")).filter("text is not null"), "session_id", "text", 40, 14)


@query("select id, epoch_us(ts) as ts from episodic where contains(payload, 'retry after')")
def k05_entity_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.entity_export(load(spark, d, "episodic"), "retry after").select("id", us("ts"))


# --- aggregates, windows, sets -------------------------------------------------------------------------------------
@query("select date_trunc('hour', ts)::varchar as hour, event_type, count(*)::bigint as n from episodic group by 1, 2")
def a05_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "episodic").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select source, count(distinct session_id)::bigint as sessions, count(distinct trace_id)::bigint as traces from episodic group by 1")
def a03_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "episodic").groupBy("source").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("trace_id").alias("traces"))


@query("select source, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 9) as per_second from episodic group by 1")
def a06_event_rate(spark: SparkSession, d: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return load(spark, d, "episodic").groupBy("source").agg(F.round(F.count(F.lit(1)) / F.greatest(span, F.lit(1.0)), 9).alias("per_second"))


@query("""with r as (select path, duration_ms as v, row_number() over (partition by path order by duration_ms) - 1 as r, count(*) over (partition by path) as n from audit_log where duration_ms is not null)
select path, max(v) as value from r where r = least(floor(n * 0.95), n - 1) group by path""")
def a10_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(load(spark, d, "audit_log"), "duration_ms", 0.95, ["path"])


@query("""select tenant_id, source, grouping(tenant_id)::int as gt, grouping(source)::int as gs, count(*)::bigint as n, count(*) filter (where embedded)::bigint as n_embedded from episodic group by cube (tenant_id, source)""")
def a11_cube(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "episodic").cube("tenant_id", "source")
    return c.agg(F.grouping("tenant_id").cast("int").alias("gt"), F.grouping("source").cast("int").alias("gs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedded")).alias("n_embedded")).select("tenant_id", "source", "gt", "gs", "n", "n_embedded")


@query("""select tenant_id, event_type, count(*)::bigint as n from episodic group by grouping sets ((tenant_id), (event_type)) having count(*) > 10""")
def a11_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic")
    return e.groupingSets([["tenant_id"], ["event_type"]], "tenant_id", "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@query("""select id, rank() over w::bigint as rk, epoch_us(lag(ts) over w) as before, (sum(1) over (partition by trace_id order by ts, id rows between 2 preceding and current row))::bigint as last3
from (select distinct id, ts, trace_id from episodic where trace_id is not null) window w as (partition by trace_id order by ts, id)""")
def w01_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("trace_id").orderBy("ts", "id")
    e = load(spark, d, "episodic").filter("trace_id is not null").select("id", "ts", "trace_id").distinct()
    return e.select("id", F.rank().over(w).cast("bigint").alias("rk"), F.unix_micros(F.lag("ts").over(w)).alias("before"), F.sum(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("last3"))


@query("""select identity, status from (select identity, status from audit_log where status >= 400 intersect select identity, status from audit_log where method = 'POST')
union all select identity, status from (select identity, status from audit_log where status >= 500 except select identity, status from audit_log where method = 'GET')""")
def u04_set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "audit_log").select("identity", "status", "method")
    pick = lambda c: a.filter(c).select("identity", "status")
    return pick("status >= 400").intersect(pick("method = 'POST'")).unionAll(pick("status >= 500").subtract(pick("method = 'GET'")))


@query("""select identity, status, count(*)::bigint as n from (select identity, status from audit_log where method <> 'GET' except all select identity, status from audit_log where method = 'GET') group by 1, 2""")
def u04_except_all(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "audit_log")
    return a.filter("method <> 'GET'").select("identity", "status").exceptAll(a.filter("method = 'GET'").select("identity", "status")).groupBy("identity", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive r(n, total) as (select 1, 1::bigint union all select n + 1, total * (n + 1) from r where n < 12) select n::int as n, total from r""")
def u05_recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("with recursive r(n, total) as (select 1, cast(1 as bigint) union all select n + 1, total * (n + 1) from r where n < 12) select n, total from r")


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by 1""")
def j12_star_join(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (load(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""select c.c_custkey, o.o_orderkey from customer c full join (select * from orders where o_totalprice > 200000) o on c.c_custkey = o.o_custkey""")
def j12_full_join(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter("o_totalprice > 200000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def j12_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    c = load(spark, d, "customer").join(o.filter(F.col("o_orderpriority").startswith("1")), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.join(o.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(avg(l_discount), 9) as avg_disc, count(*)::bigint as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def a02_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= instant("1998-09-02"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""with m as (select distinct id as mid, tenant_id, user_id, lower(trim(subject)) as subject, valid_from, valid_to, version from memories where user_id is not null and subject is not null),
e as (select distinct id, tenant_id, src, valid_from from memory_edges where valid_from is not null),
h as (select e.id, e.tenant_id, e.src, e.valid_from, m.subject from e join m on e.tenant_id = m.tenant_id and e.src = m.user_id and m.valid_from <= e.valid_from and (m.valid_to is null or m.valid_to > e.valid_from)
  qualify row_number() over (partition by e.id, e.tenant_id, e.src, e.valid_from order by m.valid_from desc, m.version desc, m.mid, m.subject desc) = 1)
select id, tenant_id, src, epoch_us(valid_from) as at, subject from e left join h using (id, tenant_id, src, valid_from)""")
def j03_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Of memories with one start the highest version counts, then the smallest id."""
    m = load(spark, d, "memories").filter("user_id is not null and subject is not null").select(F.col("id").alias("mid"), "tenant_id", F.col("user_id").alias("src"), F.lower(F.trim("subject")).alias("subject"), F.col("valid_from").alias("s"), F.col("valid_to").alias("e"), "version").distinct()
    e = load(spark, d, "memory_edges").filter("valid_from is not null").select("id", "tenant_id", "src", "valid_from").distinct()
    return as_of_join(e, m, ["tenant_id", "src"], "valid_from", "s", "e", ["subject"], {"version": True, "mid": False}).select("id", "tenant_id", "src", us("valid_from", "at"), "subject")


TRIGGERS = [("t1", "larkfield", "*", "ticket.closed"), ("t2", "verdigris", "billing-bot", "*"), ("t3", "default", "*", "*")]


@query(f"""select e.id, t.trigger_id from (select distinct id, tenant_id, source, event_type from episodic) e join (values {', '.join(map(str, TRIGGERS))}) t(trigger_id, tenant_id, s, k)
on e.tenant_id = t.tenant_id and (t.s = '*' or t.s = e.source) and (t.k = '*' or t.k = e.event_type)""")
def j11_triggers(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(TRIGGERS, "trigger_id string, t string, match_source string, match_type string")
    e = load(spark, d, "episodic").select("id", "tenant_id", "source", "event_type").distinct()
    return wildcard_match(e, t, {"match_source": "source", "match_type": "event_type"}).filter("t = tenant_id").select("id", "trigger_id")


POLICIES = [("desk-assistant", 40), ("billing-bot", 0)]


@query(f"""select e.id, epoch_us(e.ts) as ts from episodic e left join (values {', '.join(map(str, POLICIES))}) p(source, days) using (source)
where coalesce(days, 45) = 0 or ts >= timestamp '{NOW}' - to_days(coalesce(days, 45))""")
def t07_retention(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(POLICIES, "source string, days int")
    return st.retained(load(spark, d, "episodic"), p, 45, instant(NOW)).select("id", us("ts"))


@query("""with l as (select id as seq, tenant_id as agent_id, event_type as key, payload as value, epoch_us(ts) as a, epoch_us(ts) % 7 = 0 as gone from (select distinct id, tenant_id, event_type, payload, ts from episodic)),
g as (select *, sum(gone::int) over (partition by agent_id, key order by a, seq) as life, first_value(gone) over (partition by agent_id, key order by a desc, seq desc) as ends from l)
select agent_id, key, max_by(value, (a, seq)) as value, count(*)::bigint as version from (select *, max(life) over (partition by agent_id, key) as top from g) where not gone and not ends and life = top group by 1, 2""")
def t05_state(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").select("id", "tenant_id", "event_type", "payload", "ts").distinct()
    at = F.unix_micros("ts")
    log = e.select(F.col("tenant_id").alias("agent_id"), F.col("event_type").alias("key"), F.when(at % 7 == 0, "delete").otherwise("set").alias("op"), F.col("payload").alias("value"), F.lit(None).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("ttl_us"), at.alias("at"), F.col("id").alias("seq"))
    return st.fold_state(log).select("agent_id", "key", "value", "version")


@query(f"""with l as (select id, tenant_id as agent_id, event_type as key, payload as value, epoch_us(ts) as a from (select distinct id, tenant_id, event_type, payload, ts from episodic)),
t as (select agent_id, key, max_by(value, (a, id)) as value, count(*)::bigint as version, max(a) as a from l group by 1, 2)
select agent_id, key, value, version, case when a % 3 = 0 then a + 30 * 86400000000 end as expires_at from t where a % 3 <> 0 or a + 30 * 86400000000 > {NOW_US}""")
def t06_ttl(spark: SparkSession, d: str) -> DataFrame:
    """A third of the writes live for thirty days; what has not expired by now."""
    at = F.unix_micros("ts")
    e = load(spark, d, "episodic").select("id", "tenant_id", "event_type", "payload", "ts").distinct()
    log = e.select(F.col("tenant_id").alias("agent_id"), F.col("event_type").alias("key"), F.when(at % 3 == 0, "set_ttl").otherwise("set").alias("op"), F.col("payload").alias("value"), F.lit(None).cast("bigint").alias("expected"), F.lit(30 * 86_400_000_000).alias("ttl_us"), at.alias("at"), F.col("id").alias("seq"))
    return st.fold_state(log, F.lit(NOW_US)).select("agent_id", "key", "value", "version", "expires_at")


@query("""with recursive l as (select id, tenant_id as agent_id, event_type as key, payload as value, epoch_us(ts) % 5 as m, row_number() over (partition by tenant_id, event_type order by ts, id) as k from (select distinct id, tenant_id, event_type, payload, ts from episodic)),
r(agent_id, key, k, version, value, applied) as (select agent_id, key, 0, 0::bigint, null::varchar, 0::bigint from (select distinct agent_id, key from l)
  union all select r.agent_id, r.key, l.k, case when m = 0 then 0 when m = 1 and version <> 1 then version else version + 1 end, case when m = 0 then null when m = 1 and version <> 1 then r.value else l.value end, applied + (m = 1 and version = 1)::int
  from r join l on r.agent_id is not distinct from l.agent_id and r.key is not distinct from l.key and l.k = r.k + 1)
select agent_id, key, value, version, applied from r qualify row_number() over (partition by agent_id, key order by k desc) = 1 and version > 0""")
def t05_compare_and_set(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the events delete, a fifth write only on version 1, the rest write."""
    e = load(spark, d, "episodic").select("id", "tenant_id", "event_type", "payload", "ts").distinct()
    at = F.unix_micros("ts")
    op = F.when(at % 5 == 0, "delete").when(at % 5 == 1, "cas").otherwise("set")
    log = e.select(F.col("tenant_id").alias("agent_id"), F.col("event_type").alias("key"), op.alias("op"), F.col("payload").alias("value"), F.lit(1).cast("bigint").alias("expected"), F.lit(None).cast("bigint").alias("ttl_us"), at.alias("at"), F.col("id").alias("seq"))
    return st.replay_state(log).select("agent_id", "key", "value", "version", "applied")


@query("select session_id, epoch_us(started_at) as started_at from (select distinct * from sessions) where agent_id = 'triage-agent-01' order by started_at desc, session_id limit 50")
def t10_sessions(spark: SparkSession, d: str) -> DataFrame:
    return st.session_list(load(spark, d, "sessions").distinct(), "triage-agent-01", 50).select("session_id", us("started_at"))


@query("""with e as (select *, row_number() over (partition by session_id order by ts, id) as r from (select distinct id, session_id, event_type, payload, ts from episodic) where session_id is not null)
select session_id, count(*)::bigint as n, 'Session ' || session_id || ':' || chr(10) || string_agg('[' || event_type || '] ' || payload[1:300], chr(10) order by r) as digest from e where r <= 200 group by 1""")
def t11_session_digest(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").select("id", "session_id", "event_type", "payload", "ts").distinct()
    return st.session_digest(e)


RUNS = """select tenant_id || '/' || trace_id as id, min(ts) as created_at, max(ts) as updated_at, case when max_by(event_type, (ts, id)) like '%.closed' then 'done' when max_by(event_type, (ts, id)) like '%.started' then 'pending' else 'running' end as status
from (select distinct id, tenant_id, trace_id, event_type, ts from episodic) where trace_id is not null group by 1"""


@query(f"select id, status, epoch_us(updated_at) as updated_at from ({RUNS}) where status in ('pending', 'running') and updated_at < timestamp '{MIDDLE}' order by updated_at, id limit 200")
def t12_stale_runs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").select("id", "tenant_id", "trace_id", "event_type", "ts").distinct().filter("trace_id is not null")
    last = F.max_by("event_type", F.struct("ts", "id"))
    runs = e.groupBy(F.concat_ws("/", "tenant_id", "trace_id").alias("id")).agg(F.max("ts").alias("updated_at"), F.when(last.endswith(".closed"), "done").when(last.endswith(".started"), "pending").otherwise("running").alias("status"))
    return st.stale_runs(runs, instant(MIDDLE), 200).select("id", "status", us("updated_at"))


@query("""select id, epoch_us(try_strptime(ts_text, ['%Y-%m-%dT%H:%M:%S.%fZ', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S'])) as at from (
select id, case when epoch_us(ts) % 3 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') when epoch_us(ts) % 3 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S.%f') else 'garbage' end as ts_text from (select distinct id, ts from episodic))""")
def s_parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    m = F.unix_micros("ts") % 3
    e = load(spark, d, "episodic").select("id", "ts").distinct()
    text = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("garbage")
    return e.select("id", text.alias("text")).select("id", F.unix_micros(parse_ts(F.col("text"))).alias("at"))


@query("select id, json_extract_string(metadata, '$.origin') as origin, json_extract_string(metadata, '$.batch') as batch from memories where metadata is not null")
def s_json_paths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "memories").filter("metadata is not null").select("id", json_text(F.col("metadata"), "origin").alias("origin"), json_text(F.col("metadata"), "batch").alias("batch"))


QUERIES, ORACLES = query.queries, query.sql
