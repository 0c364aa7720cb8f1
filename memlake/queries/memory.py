"""Memories, retrieval, vectors and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.scalars import cosine, recency
from memlake.functions.text import STOP_WORDS, normalize_subject, token_f1, tokenize
from memlake.operators import graph as g
from memlake.operators import memory as m
from memlake.operators import retrieval as r
from memlake.operators import vector as v
from memlake.operators.joins import interval_join
from memlake.operators.state import by_prefix as state_by_prefix
from memlake.plans.shared import written
from memlake.queries.registry import MIDDLE, NOW, NOW_US, Registry, instant, load, us
from memlake.sources import sinks
from memlake.streaming.pipelines import change_stream, watch

query = Registry()
TENANT = "larkfield"
SCOPE = m.Scope(TENANT)
_SCOPE = f"tenant_id = '{TENANT}' and user_id is null and agent_id is null and session_id is null"
ASK = "keyboard layout of the billing agents"

# Memories in SQL: rows sent twice come once, terms are split, stopped and stemmed as in the library.
_ONCE = "(select distinct on (id) * from memories)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEM = """case when not regexp_full_match(w, '[\\x00-\\x7F]*') then w when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 3 and w like '%ies' then w[:-4] || 'y'
 when length(w) > 3 and w like '%ed' then w[:-3] when length(w) > 3 and w like '%s' and w not like '%ss' and w not like '%us' then w[:-2] else w end"""


def _terms(text: str) -> str:
    return f"list_transform(list_filter(list_transform(list_filter(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x)), lambda x: x not in ({_STOP})), lambda w: {_STEM})"


_NORM = r"trim(regexp_replace(lower({}), '[\s\x{{00A0}}]+', ' ', 'g'))"


def memories(spark: SparkSession, d: str, tenant: str | None = None) -> DataFrame:
    """The test memories, or one tenant's, rows of one id once."""
    mem = load(spark, d, "memories")
    return (mem if tenant is None else mem.filter(F.col("tenant_id") == tenant)).dropDuplicates(["id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "memory_edges").dropDuplicates(["id"])


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The first vector of the table of embeddings: a stand-in for an embedded question."""
    return list(load(spark, d, "embeddings").filter("vec_id = 0").first().embedding)


# --- predicates and lists ------------------------------------------------------------------------------------------
@query(f"select id, content, importance from {_ONCE} where {_SCOPE}")
def f01_exact_scope(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).filter(SCOPE.predicate()).select("id", "content", "importance")


@query(f"select id, epoch_us(valid_from) as valid_from from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' and {_NORM.format('subject')} = 'user.theme'")
def f07_by_subject(spark: SparkSession, d: str) -> DataFrame:
    a = memories(spark, d).filter((F.col("tenant_id") == TENANT) & (F.col("state") == "active") & (normalize_subject(F.col("subject")) == "user.theme"))
    return a.orderBy(F.desc("valid_from")).select("id", us("valid_from"))


@query(f"select id, importance from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' order by importance desc, valid_from desc, id limit 200")
def f08_list_active(spark: SparkSession, d: str) -> DataFrame:
    return r.list_active(memories(spark, d, TENANT), F.col("tenant_id") == TENANT, 200).select("id", "importance")


@query(f"""select id, importance from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' and mem_type = 'semantic' and importance >= 0.2 and updated_at >= timestamp '2018-01-03' and updated_at < timestamp '{NOW}'
and json_extract_string(metadata, '$.published') = 'true' order by importance desc, valid_from desc, id limit 20 offset 5""")
def f09_filtered_page(spark: SparkSession, d: str) -> DataFrame:
    return m.list_paged(memories(spark, d, TENANT), F.col("tenant_id") == TENANT, 20, 5, "semantic", 0.2, instant("2018-01-03"), instant(NOW), ("published", "true")).select("id", "importance")


@query(f"select id, epoch_us(updated_at) as updated_at from {_ONCE} where tenant_id = '{TENANT}' order by updated_at desc, id limit 100")
def f11_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, TENANT).filter(F.col("tenant_id") == TENANT).orderBy(F.desc("updated_at"), "id").limit(100).select("id", us("updated_at"))


# --- vectors -------------------------------------------------------------------------------------------------------
_QV = "(select embedding from embeddings where vec_id = 0)"
_DOT = "list_dot_product({0}::double[], {1}::double[])"
_COS = f"({_DOT.format('embedding', 'q')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('q', 'q')})))"


@query(f"select vec_id, label, round({_COS}, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) order by {_COS} desc, vec_id limit 20")
def v01_knn(spark: SparkSession, d: str) -> DataFrame:
    return v.knn(load(spark, d, "embeddings"), query_vector(spark, d), 20, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"select vec_id, round({_COS}, 6) as score from embeddings, (select embedding as q from embeddings where vec_id = 0) where label = 1 order by {_COS} desc, vec_id limit 20")
def v02_filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    return v.knn(load(spark, d, "embeddings"), query_vector(spark, d), 20, "vec_id", where=F.col("label") == 1).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""select label, vec_id, score from (select label, vec_id, round({_COS}, 6) as score, row_number() over (partition by label order by {_COS} desc, vec_id) as rk
from embeddings, (select embedding as q from embeddings where vec_id = 0)) where rk <= 5""")
def v03_scoped_knn(spark: SparkSession, d: str) -> DataFrame:
    return v.knn_by_scope(load(spark, d, "embeddings"), query_vector(spark, d), 5, ["label"], "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query(f"""select query, vec_id, score from (select b.vec_id::varchar as query, a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score,
row_number() over (partition by b.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, a.vec_id) as rk from embeddings a, (select * from embeddings where vec_id % 50 = 0) b) where rk <= 10""")
def v01_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50, against all."""
    e = load(spark, d, "embeddings")
    q = [(x.vec_id, list(x.embedding)) for x in e.filter("vec_id % 50 = 0").orderBy("vec_id").collect()]
    return v.knn_batch(e, q, 10, "vec_id").select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""select vec_id, score from (select vec_id, round({_COS}, 6) as score, {_COS} as s from embeddings, (select embedding as q from embeddings where vec_id = 0) order by s desc, vec_id limit 50) where s >= 0.3""")
def f13_min_score(spark: SparkSession, d: str) -> DataFrame:
    return v.knn(load(spark, d, "embeddings"), query_vector(spark, d), 50, "vec_id", min_score=0.3).select("vec_id", F.round("score", 6).alias("score"))


@query("""select embeddings.vec_id, case when embeddings.vec_id % 5 = 0 then 7 else label end::int as label from embeddings where vec_id % 11 <> 3""")
def v06_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").withColumn("label", F.col("label").cast("int"))
    new = e.filter("vec_id % 5 = 0").withColumn("label", F.lit(7))
    return v.delete(v.upsert(e, new, "vec_id"), e.filter("vec_id % 11 = 3"), "vec_id").select("vec_id", "label")


# --- lexical and hybrid --------------------------------------------------------------------------------------------
@query(rf"select id, array_to_string({_terms('content')}, ' ') as terms from {_ONCE} where content is not null")
def h01_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).filter("content is not null").select("id", F.array_join(tokenize(F.col("content")), " ").alias("terms"))


def _bm25_sql(cand: str, ask: str) -> str:
    return f"""c as ({cand}), q as (select unnest(list_distinct({_terms(f"'{ask}'")})) as term), t as (select id, {_terms('content')} as ts from c),
s as (select count(*)::double as n, greatest(avg(len(ts)), 1.0) as avgdl from t),
f as (select id, len(ts)::double as dl, term, len(list_filter(ts, lambda x: x = term))::double as tf from t, q),
df as (select term, count(*)::double as nq from f where tf > 0 group by term),
lex as (select id, sum(ln((n - nq + 0.5) / (nq + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from f join df using (term), s where tf > 0 group by id)"""


_CAND = f"select id, content, importance, updated_at from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' order by importance desc, valid_from desc, id limit 2048"


@query(f"with {_bm25_sql(_CAND, ASK)} select id, round(score, 6) as score from lex")
def h03_bm25(spark: SparkSession, d: str) -> DataFrame:
    cand = r.list_active(memories(spark, d, TENANT), F.col("tenant_id") == TENANT, 2048)
    return r.bm25(cand, ASK).select("id", F.round("score", 6).alias("score"))


@query(f"""with {_bm25_sql(f"select id, content from {_ONCE}", ASK)} select 'q1' as qid, id, round(score, 6) as score from lex order by score desc, id limit 10""")
def h03_bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([("q1", ASK)], "qid string, query string")
    return r.bm25_batch(memories(spark, d), q, k=10).select("qid", "id", F.round("score", 6).alias("score"))


@query(f"""with {_bm25_sql(_CAND, ASK)},
near as (select id, {_COS} as s from {_ONCE}, (select embedding as q from embeddings where vec_id = 0) where tenant_id = '{TENANT}' and state = 'active' and len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0
  and not list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x))) order by s desc, id limit 50),
arms as (select id, 1.0 / (60.0 + row_number() over (order by score desc, id)) as w from lex union all select id, 1.0 / (60.0 + row_number() over (order by s desc, id)) from near),
fused as (select id, sum(w) as rrf from arms group by id order by rrf desc, id limit 50)
select id, round(rrf * (1.0 + 0.3 * importance + 0.2 * pow(0.5, greatest(floor(({NOW_US} - epoch_us(updated_at)) / 1000000), 0) / 86400.0 / 30.0)), 9) as score from fused join {_ONCE} using (id) order by score desc, id limit 10""")
def h06_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d, TENANT).withColumn("updated_us", F.unix_micros("updated_at"))
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    mem = mem.withColumn("embedding", F.when(~bad, F.col("embedding")))
    hits = r.memory_search(mem, F.col("tenant_id") == TENANT, ASK, 10, NOW_US, query_vector(spark, d))
    return hits.select("id", F.round("score", 9).alias("score"))


# Candidates are far fewer than the scope here, so that the graph arm has to find memories beyond them.
_FEW = f"select id, content, importance, updated_at from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' order by importance desc, valid_from desc, id limit 60"


@query(f"""with {_bm25_sql(_FEW, 'reports for the triage hub')},
e as (select *, row_number() over (order by weight desc, id) as place from (select distinct on (id) * from memory_edges) where tenant_id = '{TENANT}' and state = 'active'),
hit as (select source_memory_id as id, min(place) as place from e where place <= 2048 and source_memory_id is not null and (list_has_any({_terms('src')}, (select list(term) from q)) or list_has_any({_terms('dst')}, (select list(term) from q))) group by 1),
gr as (select id, place from hit where id in (select id from {_ONCE} where tenant_id = '{TENANT}' and state = 'active')),
arms as (select id, 1.0 / (60.0 + row_number() over (order by score desc, id)) as w from lex union all select id, 1.0 / (60.0 + row_number() over (order by place, id)) from gr)
select id, round(sum(w), 9) as rrf from arms group by id""")
def h07_graph_arm(spark: SparkSession, d: str) -> DataFrame:
    ask = "reports for the triage hub"
    live = memories(spark, d, TENANT).filter("state = 'active'")
    cand = r.list_active(live, F.lit(True), 60)
    arms = [r.ranked(r.bm25(cand, ask), [F.desc("score"), F.col("id")]), r.ranked(r.graph_arm(edges(spark, d), live, ask, 2048, TENANT), [F.col("first"), F.col("id")])]
    return r.rrf(arms).select("id", F.round("rrf", 9).alias("rrf"))


_ASKED = "select item_id as qid, text as query, embedding as q from eval_items join embeddings on vec_id = item_id % 500"
_LIVE = f"select id, content, importance, valid_from, updated_at, embedding from {_ONCE} where tenant_id = '{TENANT}' and state = 'active'"
_BLEND = f"(1.0 + 0.3 * importance + 0.2 * pow(0.5, greatest(floor(({NOW_US} - epoch_us(updated_at)) / 1000000), 0) / 86400.0 / 30.0))"
_BATCH_LEX = f"""live as ({_LIVE}), asked as ({_ASKED}), c as (select id, {_terms('content')} as ts from live order by importance desc, valid_from desc, id limit 2048),
s as (select count(*)::double as n, greatest(avg(len(ts)), 1.0) as avgdl from c), q as (select distinct qid, unnest({_terms('query')}) as term from asked),
p as (select id, len(ts)::double as dl, unnest(ts) as term from c), f as (select id, dl, term, count(*)::double as tf from p group by all), df as (select term, count(*)::double as nq from f group by 1),
lex as (select qid, id, sum(ln((n - nq + 0.5) / (nq + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join f using (term) join df using (term), s group by 1, 2)"""


@query(f"""with {_BATCH_LEX},
near as (select qid, id, {_COS} as s from live, asked where len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0 and not list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x)))
  qualify row_number() over (partition by qid order by s desc, id) <= 50),
arms as (select qid, id, 1.0 / (60.0 + row_number() over (partition by qid order by round(score, 12) desc, id)) as w from lex union all select qid, id, 1.0 / (60.0 + row_number() over (partition by qid order by s desc, id)) from near),
fused as (select qid, id, sum(w) as rrf from arms group by 1, 2 qualify row_number() over (partition by qid order by rrf desc, id) <= 50),
best as (select qid, id, rrf * {_BLEND} as score from fused join live using (id))
select qid, id, round(score, 9) as score from best qualify row_number() over (partition by qid order by score desc, id) <= 10""")
def h06_hybrid_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item as a question, all at once."""
    vec = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = load(spark, d, "eval_items").join(vec, F.col("item_id") % 500 == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("text").alias("query"), "vector")
    mem = memories(spark, d, TENANT).withColumn("updated_us", F.unix_micros("updated_at"))
    return r.memory_search_batch(mem, F.col("tenant_id") == TENANT, asked, 10, NOW_US).select("qid", "id", F.round("score", 9).alias("score"))


@query(f"""with {_bm25_sql(_CAND, ASK)},
fused as (select id, 1.0 / (60.0 + row_number() over (order by score desc, id)) as rrf from lex order by rrf desc, id limit 50),
hits as (select id, content, pow(0.5, greatest(floor(({NOW_US} - epoch_us(updated_at)) / 1000000), 0) / 86400.0 / 30.0) as fresh from fused join {_ONCE} using (id))
select id, round(length(content) * (1.0 + 0.1 * fresh), 6) as score from hits order by length(content) * (1.0 + 0.1 * fresh) desc, id limit 10""")
def h08_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A second stage that takes the length of a text for its relevance."""
    mem = memories(spark, d, TENANT).withColumn("updated_us", F.unix_micros("updated_at"))
    hits = r.memory_search(mem, F.col("tenant_id") == TENANT, ASK, 10, NOW_US, rerank=lambda _, texts: [float(len(t)) for t in texts])
    return hits.select("id", F.round("score", 6).alias("score"))


_WORDS = "list_filter(list_transform(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: x <> '')"


@query(f"""with p as (select a.id, {_WORDS.format('a.content')} as p, {_WORDS.format('b.content')} as g from {_ONCE} a join {_ONCE} b on b.id = a.supersedes where a.content is not null and b.content is not null),
c as (select id, len(p) as np, len(g) as ng, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) as c from p)
select id, round(case when np = 0 and ng = 0 then 1.0 when np = 0 or ng = 0 or c = 0 then 0.0 else 2 * (c / np) * (c / ng) / (c / np + c / ng) end, 9) as f1 from c""")
def h12_token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Each memory's text against that of the memory it superseded."""
    a = memories(spark, d).filter("content is not null")
    old = a.select(F.col("id").alias("supersedes"), F.col("content").alias("before"))
    return a.join(old, "supersedes").select("id", F.round(token_f1(F.col("content"), F.col("before")), 9).alias("f1"))


_SUBJECTS = f"select distinct {_NORM.format('subject')} as query from {_ONCE} where tenant_id = '{TENANT}' and subject is not null and trim(subject) <> ''"


@query(f"""with asked as ({_SUBJECTS}), c as (select id, content, {_terms('content')} as ts from {_ONCE}), s as (select count(*)::double as n, greatest(avg(coalesce(len(ts), -1)), 1.0) as avgdl from c),
q as (select distinct query as qid, unnest({_terms('query')}) as term from asked), p as (select id, len(ts)::double as dl, unnest(ts) as term from c), f as (select id, dl, term, count(*)::double as tf from p group by all), df as (select term, count(*)::double as nq from f group by 1),
lex as (select qid, id, sum(ln((n - nq + 0.5) / (nq + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join f using (term) join df using (term), s group by 1, 2),
hits as (select qid, id, row_number() over (partition by qid order by round(score, 12) desc, id) as rank from lex qualify rank <= 10),
k as (select query as qid, min(rank) as rank from asked left join (select qid, rank, content from hits join c using (id)) h on h.qid = query and contains(lower(h.content), lower(regexp_extract(query, '[^ ]+$'))) group by 1)
select round(avg(coalesce((rank <= 1)::int, 0)), 9) as r1, round(avg(coalesce((rank <= 3)::int, 0)), 9) as r3, round(avg(coalesce((rank <= 5)::int, 0)), 9) as r5, round(avg(coalesce(1.0 / rank, 0)), 9) as mrr from k""")
def h12_recall(spark: SparkSession, d: str) -> DataFrame:
    """Every subject of the tenant as a question to all memories; expected is a text that holds the subject's last word."""
    mem = written(memories(spark, d).select("id", "tenant_id", "subject", "content"), "memories")
    asked = mem.filter((F.col("tenant_id") == TENANT) & (F.trim("subject") != "")).select(normalize_subject(F.col("subject")).alias("query")).distinct()
    hits = r.bm25_top(mem, asked.select(F.col("query").alias("qid"), "query"), 10).join(mem.select("id", "content"), "id")
    gold = asked.select(F.col("query").alias("qid"), F.regexp_extract("query", "[^ ]+$", 0).alias("expected"))
    return r.retrieval_metrics(r.first_hit(hits, gold)).select(*[F.round(c, 9).alias(c) for c in ("r1", "r3", "r5", "mrr")])


@query(f"""select id, round(pow(0.5, greatest(floor(({NOW_US} - epoch_us(updated_at)) / 1000000), 0) / 86400.0 / 30.0), 9) as fresh from {_ONCE}""")
def s_recency(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("id", F.round(recency(F.unix_micros("updated_at"), F.lit(NOW_US)), 9).alias("fresh"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cos from embeddings a join embeddings b on a.vec_id = b.vec_id - 1""")
def s_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.join(b, F.col("vec_id") == F.col("b") - 1).select(F.col("vec_id").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("eb")), 6).alias("cos"))


# --- bi-temporal ---------------------------------------------------------------------------------------------------
@query(f"select id, {_NORM.format('subject')} as subject from {_ONCE} where subject is not null")
def b01_normalize_subject(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).filter("subject is not null").select("id", normalize_subject(F.col("subject")).alias("subject"))


@query("""with e as (select user_id, event_type, floor(value / 10)::bigint::varchar as content, epoch_us(ts) as t, event_id from events),
c as (select *, (lag(content) over w is distinct from content)::int as chg from e window w as (partition by user_id, event_type order by t, event_id)),
i as (select *, sum(chg) over (partition by user_id, event_type order by t, event_id rows unbounded preceding) as island from c),
k as (select user_id, event_type, island, min(content) as content, min(t) as valid_from, max(t) as seen, count(*)::bigint as version from i group by all)
select user_id, event_type, island::bigint as island, content, version, valid_from, lead(valid_from) over w as valid_to, case when lead(valid_from) over w is null then 'active' else 'superseded' end as state, lag(island) over w::bigint as supersedes
from k window w as (partition by user_id, event_type order by island)""")
def b02_contradiction_fold(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).cast("string").alias("content"), F.unix_micros("ts").alias("t"), "event_id", F.lit(0.5).alias("importance"))
    return m.fold_contradictions(e, ["user_id", "event_type"], "content", "t", "event_id").select("user_id", "event_type", "island", "content", "version", "valid_from", "valid_to", "state", "supersedes")


# What adding every superseded memory again, in order of its start, does to the active ones.
_SAME = r"regexp_replace(content, '^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')"
_OF = "tenant_id, user_id, agent_id, session_id"
_PLAN = f"""one as (select *, nullif({_NORM.format('subject')}, '') as j, {_SAME} as t from {_ONCE}),
newest as (select {_OF}, j, max_by(id, (valid_from, id)) as nid, max_by(t, (valid_from, id)) as nt from one where state = 'active' and j is not null group by all),
asked as (select n.*, a.nid, a.nt from (select * from one where state = 'superseded') n left join newest a on n.j = a.j and n.tenant_id = a.tenant_id and n.user_id is not distinct from a.user_id and n.agent_id is not distinct from a.agent_id and n.session_id is not distinct from a.session_id),
w as (select *, row_number() over v as k, lag(t) over v as bt from asked window v as (partition by {_OF}, j, case when j is null then id end order by valid_from, id)),
x as (select *, (k > 1 or nid is not null) as there, (k > 1 or nid is not null) and (t is not distinct from case when k = 1 then nt else bt end) as same from w),
y as (select *, sum((not same)::int) over v as island, last_value(case when not same then id end ignore nulls) over v as own, last_value(case when not same then id end ignore nulls) over (partition by {_OF}, j, case when j is null then id end order by valid_from, id rows between unbounded preceding and 1 preceding) as former
  from x window v as (partition by {_OF}, j, case when j is null then id end order by valid_from, id rows unbounded preceding)),
plan as (select *, case when same then 'confirmed' when not there then 'inserted' else 'superseded' end as outcome, coalesce(former, nid) as target, coalesce(own, nid) as head from y)"""


def _planned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mem = memories(spark, d)
    new = mem.filter("state = 'superseded'").withColumn("at", F.col("valid_from")).withColumn("seq", F.col("valid_from"))
    new = new.select("id", *m.SCOPE, "subject", "content", "importance", "source_event_ids", "metadata", "mem_type", "embedding", "at", "seq")
    return mem, m.additions(mem, new)


@query(f"with {_PLAN} select id as new_id, outcome, target from plan")
def b02_plan_additions(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, d)[1].select(F.col("id").alias("new_id"), "outcome", "target")


@query(f"""with {_PLAN}, runs as (select {_OF}, j, case when j is null then id end as solo, island, head, min_by(outcome, (valid_from, id)) as outcome, min_by(target, (valid_from, id)) as target, min(valid_from) as began, max(valid_from) as seen, max(importance) as importance, count(*) as n from plan group by all),
r as (select *, lead(began) over v as until, lead(outcome) over v as nxt from runs window v as (partition by {_OF}, j, case when j is null then head end order by island)),
closing as (select {_OF}, j, min(began) as closing from r where outcome = 'superseded' group by all),
made as (select head as id, importance, began as valid_from, case when nxt = 'superseded' then until end as valid_to, case when nxt = 'superseded' then 'superseded' else 'active' end as state, case when outcome = 'superseded' then target end as supersedes, n as version, case when nxt = 'superseded' then until else seen end as updated_at from r where outcome <> 'confirmed'),
kept as (select head as id, n, importance, seen from r where outcome = 'confirmed' and island = 0 and j is not null),
old as (select o.id, greatest(o.importance, coalesce(k.importance, o.importance)) as importance, o.valid_from, coalesce(c.closing, o.valid_to) as valid_to, case when c.closing is null then o.state else 'superseded' end as state, o.supersedes, o.version + coalesce(k.n, 0) as version, coalesce(c.closing, k.seen) as updated_at
  from one o left join closing c on o.j = c.j and o.tenant_id = c.tenant_id and o.user_id is not distinct from c.user_id and o.agent_id is not distinct from c.agent_id and o.session_id is not distinct from c.session_id left join kept k on o.id = k.id where o.state = 'active' and (c.closing is not null or k.id is not null))
select id, round(importance, 6) as importance, epoch_us(valid_from) as valid_from, epoch_us(valid_to) as valid_to, state, supersedes, version::bigint as version, epoch_us(updated_at) as updated_at from (select * from made union all by name select * from old)""")
def b05_apply_rows(spark: SparkSession, d: str) -> DataFrame:
    made = m.applied(*_planned(spark, d))
    return made.select("id", F.round("importance", 6).alias("importance"), us("valid_from"), us("valid_to"), "state", "supersedes", F.col("version").cast("bigint").alias("version"), us("updated_at"))


@query(f"""select id, epoch_us(valid_from) as valid_from from (select *, row_number() over (partition by tenant_id, user_id, agent_id, session_id, {_NORM.format('subject')} order by valid_from desc, id) as rn
from {_ONCE} where subject is not null and valid_from <= timestamp '{MIDDLE}' and (valid_to is null or valid_to > timestamp '{MIDDLE}')) where rn = 1""")
def b07_as_of(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d).filter("subject is not null").withColumn("subject", normalize_subject(F.col("subject")))
    return m.as_of(mem, instant(MIDDLE)).select("id", us("valid_from"))


@query(f"select id, epoch_us(valid_from) as valid_from, version from {_ONCE} where tenant_id = 'verdigris' and user_id = 'u-00000017' and agent_id is null and session_id is null and {_NORM.format('subject')} = 'desk number'")
def b08_history(spark: SparkSession, d: str) -> DataFrame:
    return m.history(memories(spark, d), m.Scope("verdigris", "u-00000017"), "Desk  NUMBER ").select("id", us("valid_from"), "version")


@query(f"""select id, round(importance * pow(0.5, date_diff('day', valid_from, timestamp '{NOW}') / 30.0), 9) as strength from {_ONCE}
where state = 'active' and importance * pow(0.5, date_diff('day', valid_from, timestamp '{NOW}') / 30.0) < 0.05""")
def b09_decay(spark: SparkSession, d: str) -> DataFrame:
    return m.decayed(memories(spark, d), instant(NOW)).select("id", F.round(m.strength(instant(NOW)), 9).alias("strength"))


@query(f"""select id from (select *, row_number() over (partition by tenant_id, user_id, agent_id, session_id order by importance desc, updated_at desc, id) as rn from {_ONCE} where state = 'active') where rn > 3""")
def b11_over_cap(spark: SparkSession, d: str) -> DataFrame:
    return m.over_cap(memories(spark, d), 3).select("id")


@query(f"""select tenant_id, user_id, agent_id, session_id, {_NORM.format('subject')} as subject, count(*)::bigint as n, string_agg(id, ',' order by id) as ids from {_ONCE}
where {_NORM.format('subject')} <> '' group by all having count(*) > 1""")
def b12_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """The queue as it would be had no memory been closed."""
    return m.contradictions(memories(spark, d).withColumn("state", F.lit("active"))).withColumn("ids", F.array_join("ids", ","))


@query(f"""select id, round(case when ascii(id[1:1]) % 2 = 0 then least(importance + 0.1, 1.0) else importance end, 9) as importance, version + (case when ascii(id[1:1]) % 2 = 0 then 1 else 0 end) as version,
case when ascii(id[1:1]) % 2 = 0 then 'active' else 'expired' end as state from {_ONCE} where state = 'active'""")
def b14_feedback(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d)
    votes = mem.select("id", F.when(F.ascii(F.substring("id", 1, 1)) % 2 == 0, "helpful").otherwise("wrong").alias("verdict"))
    return m.feedback(mem, votes, instant(NOW)).select("id", F.round("importance", 9).alias("importance"), "version", "state")


@query("""select m.id as memory_id, e.id as event_id, e.event_type from (select id, tenant_id, unnest(source_event_ids) as eid from (select distinct on (id) * from memories)) m
join (select distinct id, tenant_id, event_type from episodic) e on e.id = m.eid and e.tenant_id = m.tenant_id""")
def b15_provenance(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "episodic").dropDuplicates(["id"])
    return m.provenance(memories(spark, d), e).select("memory_id", "event_id", "event_type")


@query(f"""with t as (select *, row_number() over (partition by tenant_id, user_id, agent_id, session_id order by importance desc, valid_from desc, id) as rn from {_ONCE} where state = 'active')
select tenant_id, user_id, agent_id, session_id, count(*)::bigint as n, 'Consolidated ' || count(*) || ' memories:' || chr(10) || string_agg('- ' || content, chr(10) order by rn) as content from t where rn > 2 group by all""")
def b17_consolidate_tail(spark: SparkSession, d: str) -> DataFrame:
    return m.consolidated_tail(memories(spark, d), 2).select("tenant_id", "user_id", "agent_id", "session_id", "n", "content")


@query()
def b18_consolidate_similar(spark: SparkSession, d: str) -> DataFrame:
    return m.consolidated_similar(memories(spark, d), 0.3).withColumn("ids", F.array_join("ids", ",")).withColumn("source_event_ids", F.array_join("source_event_ids", ","))


@query()
def b03_semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    """The superseded memories without subject, added again to what is stored."""
    mem = memories(spark, d)
    new = mem.filter("subject is null and state = 'superseded'").withColumn("seq", F.col("valid_from"))
    return m.merged_similar(new, mem).withColumn("source_event_ids", F.array_join("source_event_ids", ","))


@query("""with x as (select doc_id as id, coalesce(lang, 'none') as a, coalesce(source, '') as b, doc_id % 4 as k from documents)
select id, case k when 0 then a || ': ' || id when 1 then case when b = '' then a else a || ' — ' || b end when 2 then 'Decision on ' || a || ': ' || id else b end as content,
case when k = 3 then b else a end as subject, case when k = 3 then 'procedural' else 'semantic' end as mem_type from x where k <> 3 or trim(b) <> ''""")
def b20_templates(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("a"), F.coalesce("source", F.lit("")).alias("b"), (F.col("doc_id") % 4).alias("k"))
    text = F.col("id").cast("string")
    name = F.element_at(F.array(*[F.lit(x) for x in ("preference", "person", "decision", "task")]), (F.col("k") + 1).cast("int"))
    fields = F.to_json(F.when(F.col("k") == 0, F.create_map(F.lit("subject"), "a", F.lit("value"), text)).when(F.col("k") == 1, F.create_map(F.lit("name"), "a", F.lit("detail"), "b")).when(F.col("k") == 2, F.create_map(F.lit("topic"), "a", F.lit("decision"), text)).otherwise(F.create_map(F.lit("task"), "b")))
    return docs.select("id", m.template(name, fields).alias("t")).filter("t is not null").select("id", "t.*")


@query(f"select id from {_ONCE} where tenant_id <> '{TENANT}'")
def b21_erasure(spark: SparkSession, d: str) -> DataFrame:
    return m.erased({"memories": memories(spark, d)}, TENANT)["memories"].select("id")


@query(f"select id, epoch_us(updated_at) as updated_at from {_ONCE} where state = 'active' order by updated_at, id limit 500")
def b24_reembed_plan(spark: SparkSession, d: str) -> DataFrame:
    return m.reembed_plan(memories(spark, d), 500).select("id", us("updated_at"))


@query("""select id, max(version) as version, max_by(state, (version, updated_at)) as state from (select distinct id, version, updated_at, state from memories) group by id""")
def b06_latest(spark: SparkSession, d: str) -> DataFrame:
    return m.latest(load(spark, d, "memories").select("id", "version", "updated_at", "state")).select("id", "version", "state")


# --- graph ---------------------------------------------------------------------------------------------------------
_EDGES = "(select distinct on (id) * from memory_edges)"
_HELD = f"(valid_from is null or valid_from <= timestamp '{MIDDLE}') and (valid_to is null or valid_to > timestamp '{MIDDLE}')"


@query(f"""select id, lead(id) over w as invalidated_by, epoch_us(lead(valid_from) over w) as valid_to, case when lead(valid_from) over w is null then 'active' else 'superseded' end as state
from {_EDGES} where valid_from is not null window w as (partition by tenant_id, src, relation order by valid_from, id)""")
def g02_functional_links(spark: SparkSession, d: str) -> DataFrame:
    return g.functional_links(edges(spark, d).filter("valid_from is not null")).select("id", "invalidated_by", us("valid_to"), "state")


@query(f"select id, src, dst, weight from {_EDGES} where tenant_id = '{TENANT}' and (src = 'tenant-wide' or dst = 'tenant-wide') order by weight desc, id limit 50")
def g03_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(edges(spark, d), TENANT, "tenant-wide", 50).select("id", "src", "dst", "weight")


@query(f"select id, weight from {_EDGES} where tenant_id = '{TENANT}' and (src = 'tenant-wide' or dst = 'tenant-wide') and {_HELD} order by weight desc, id limit 50")
def g04_neighbours_as_of(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(edges(spark, d), TENANT, "tenant-wide", 50, instant(MIDDLE)).select("id", "weight")


@query(f"select id, src, relation, dst, weight from {_EDGES} where tenant_id = '{TENANT}' and state = 'active'")
def g05_active_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.listed_edges(edges(spark, d), TENANT).select("id", "src", "relation", "dst", "weight")


@query(f"select tenant_id, src, dst, weight from {_EDGES} where {_HELD}")
def g06_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return g.snapshot(edges(spark, d), instant(MIDDLE))


@query(f"""with e as (select src, dst from {_EDGES} where state = 'active'), x as (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e)
select node, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from x group by 1""")
def g08_degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(edges(spark, d).filter("state = 'active'"))


_RANK = ", ".join(
    f"r{i} as materialized (select x.node, 0.15 / n + 0.85 * (select coalesce(sum(r), 0) from r{i - 1} where node not in (select src from o)) / n + 0.85 * coalesce(s, 0) as r from nodes x cross join k left join (select dst as node, sum(w / total * r) as s from e join o using (src) join r{i - 1} q on q.node = e.src group by 1) y on x.node = y.node)"
    for i in range(1, 41)
)


@query(f"""with e as (select src, dst, sum(case when weight > 0 then weight else 1.0 end) as w from {_EDGES} where state = 'active' group by 1, 2), o as (select src, sum(w) as total from e group by 1),
nodes as (select src as node from e union select dst from e), k as (select count(*)::double as n from nodes), r0 as (select node, 1.0 / n as r from nodes, k), {_RANK} select node, round(r, 9) as pagerank from r40""")
def g09_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return g.pagerank(edges(spark, d).filter("state = 'active'")).select("node", F.round("pagerank", 9).alias("pagerank"))


@query(f"""with recursive e as (select src as a, dst as b from {_EDGES} where state = 'active' union select dst, src from {_EDGES} where state = 'active'),
n as (select distinct a from e), c(a, b) as (select a, a from n union select c.a, e.b from c join e on c.b = e.a)
select a as node, min(b) as component from c group by 1""")
def g11_components(spark: SparkSession, d: str) -> DataFrame:
    return g.components(edges(spark, d).filter("state = 'active'"))


@query(f"""with e as (select * from {_EDGES} where tenant_id = '{TENANT}'), h1 as (select *, 1 as hop from e where src = 'tenant-wide' or dst = 'tenant-wide'),
n1 as (select src as n from h1 union select dst from h1), h2 as (select *, 2 as hop from e where id not in (select id from h1) and (src in (select n from n1) or dst in (select n from n1)))
select id, src, dst, hop from (select * from h1 union all select * from h2) order by hop, weight desc, id limit 5000""")
def g07_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return g.subgraph(edges(spark, d), TENANT, "tenant-wide", 2, 5_000).select("id", "src", "dst", "hop")


_VERBS, _COMPOUND, _PREPOSITIONS = (", ".join(f"'{x}'" for x in w) for w in (g.VERBS, g.COMPOUND_VERBS, g.PREPOSITIONS))
_TRIPLES = rf"""s as (select id, state, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(content, '[.\n;!?]')), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+'), lambda x: x <> '') as w from {_ONCE}),
p as (select id, state, w, unnest(range(2, len(w))) as i from s where len(w) >= 3),
v as (select *, lower(w[i]) as verb, lower(w[i + 1]) as nx from p),
t as (select id, state, array_to_string(w[1:i - 1], ' ') as subject, case when verb in ({_VERBS}) then verb else verb || '_' || nx end as relation, array_to_string(w[case when verb in ({_VERBS}) then i + 1 else i + 2 end:], ' ') as object
  from v where verb in ({_VERBS}) or (verb in ({_COMPOUND}) and nx in ({_PREPOSITIONS})) or (verb = 'married' and nx = 'to'))"""


@query(f"with {_TRIPLES} select id, subject, relation, object from t where object <> ''")
def g12_triples(spark: SparkSession, d: str) -> DataFrame:
    return g.triples(memories(spark, d), "id", "content")


@query(f"with {_TRIPLES} select distinct subject as src, relation, object as dst, id as source_memory_id from t where object <> '' and state = 'active'")
def g14_auto_graph(spark: SparkSession, d: str) -> DataFrame:
    """The ids of these edges are name-based UUIDs, which the twin has no function for; tests compare them."""
    return g.auto_graph(memories(spark, d)).select("src", "relation", "dst", "source_memory_id")


@query(f"with a as (select 'hub:triage' as n), e as (select * from {_EDGES} where tenant_id = '{TENANT}') select id from e where src = 'hub:triage' or dst = 'hub:triage'")
def j05_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return g.subgraph(edges(spark, d), TENANT, "hub:triage", 1, 1_000_000).select("id")


# The ends of a shortest path: the smallest source, and the greatest node that it reaches at its greatest distance.
_WALK = """e as (select distinct src, dst from memory_edges where state = 'active'), n as (select min(src) as s from e),
w(node, d) as (select s, 0 from n union select e.dst, w.d + 1 from w join e on w.node = e.src where w.d < 40), near as (select node, min(d) as d from w group by 1)"""


@query(f"""with recursive {_WALK}, goal as (select node, d from near order by d desc, node desc limit 1),
back(node, d, path) as (select node, d, node from goal union all select (select min(e.src) from e join near on near.node = e.src where e.dst = back.node and near.d = back.d - 1), d - 1, (select min(e.src) from e join near on near.node = e.src where e.dst = back.node and near.d = back.d - 1) || '>' || path from back where d > 0)
select path from back where d = 0""")
def g10_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    e = written(load(spark, d, "memory_edges").filter("state = 'active'").select("src", "dst").distinct(), "active-edges")
    start = e.agg(F.min("src").alias("s")).first().s
    far = seen = front = spark.createDataFrame([(start,)], "node string")
    while front.limit(1).count():
        far = front
        front = written(e.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"), "reach")
        seen = seen.union(front)
    goal = far.agg(F.max("node").alias("n")).first().n
    return spark.createDataFrame([(">".join(g.shortest_path(e, start, goal)),)], "path string")


@query(f"""with recursive e as (select src as a, dst as b from {_EDGES} where state = 'active' union select dst, src from {_EDGES} where state = 'active'),
n as (select distinct a from e), c(a, b) as (select a, a from n union select c.a, e.b from c join e on c.b = e.a), m as (select a as node, min(b) as component from c group by 1),
z as (select component, count(*) as size, row_number() over (order by count(*) desc, component) - 1 as place from m group by 1)
select component, size::bigint as size, place::bigint as place, node from m join z using (component)""")
def g11_communities(spark: SparkSession, d: str) -> DataFrame:
    return g.communities(edges(spark, d).filter("state = 'active'"))


@query(f"""with a as (select distinct on (id) * from memory_edges) select e.id, m.content from a e join {_ONCE} m on m.id = e.source_memory_id and m.tenant_id = e.tenant_id where m.state = 'active' and e.state = 'active'""")
def j07_edge_memories(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).filter("state = 'active'").select("id", "tenant_id", F.col("source_memory_id").alias("mid"))
    mem = memories(spark, d).filter("state = 'active'").select(F.col("id").alias("mid"), "tenant_id", "content")
    return e.join(mem, ["mid", "tenant_id"]).select("id", "content")


@query(f"""select a.id as edge, b.id as memory from (select distinct on (id) * from memory_edges) a join {_ONCE} b on a.tenant_id = b.tenant_id and a.src = b.user_id
where epoch_us(a.valid_from) >= epoch_us(b.valid_from) and (b.valid_to is null or a.valid_from < b.valid_to)""")
def j04_interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).filter("valid_from is not null").select(F.col("id").alias("edge"), "tenant_id", F.col("src").alias("u"), us("valid_from", "at"))
    mem = memories(spark, d).filter("user_id is not null").select(F.col("id").alias("memory"), "tenant_id", F.col("user_id").alias("u"), us("valid_from", "s"), us("valid_to", "e"))
    return interval_join(e, mem, ["tenant_id", "u"], "at", "s", "e", 86_400_000_000).select("edge", "memory")


# --- more of the engine's verbs ------------------------------------------------------------------------------------
@query(f"select id from {_ONCE} where tenant_id = '{TENANT}' and state = 'active' and json_extract_string(metadata, '$.published') = 'true' order by importance desc, valid_from desc, id limit 100")
def f10_published(spark: SparkSession, d: str) -> DataFrame:
    return m.list_paged(memories(spark, d), F.col("tenant_id") == TENANT, 100, metadata=("published", "true")).select("id")


@query(f"select id, content, version from {_ONCE} where id = (select min(id) from memories) and tenant_id = (select tenant_id from memories order by id limit 1)")
def f06_get_scoped(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d)
    first = mem.orderBy("id").select("id", "tenant_id").first()
    return mem.filter((F.col("id") == first.id) & (F.col("tenant_id") == first.tenant_id)).select("id", "content", "version")


@query("select distinct 'a-' || tenant_id as agent_id, event_type as key from episodic where starts_with('a-' || tenant_id, 'a-l')")
def f14_state_prefix(spark: SparkSession, d: str) -> DataFrame:
    kv = load(spark, d, "episodic").select(F.concat(F.lit("a-"), "tenant_id").alias("agent_id"), F.col("event_type").alias("key")).distinct()
    return state_by_prefix(kv, "a-l")


@query(f"select label % 2 as modality, vec_id, score from (select label, vec_id, round({_COS}, 6) as score, row_number() over (order by {_COS} desc, vec_id) as rk from embeddings, (select embedding as q from embeddings where vec_id = 0) where label % 2 = 1) where rk <= 10")
def v04_modal_knn(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").withColumn("modality", (F.col("label") % 2).cast("string")).withColumn("id", F.col("vec_id"))
    return v.knn_modal(e, query_vector(spark, d), 10, "1").select(F.col("modality").cast("int").alias("modality"), "vec_id", F.round("score", 6).alias("score"))


@query("""with q as (select vec_id, case when vec_id % 3 = 0 then 'exact' else 'near' end as hit from embeddings where vec_id % 50 = 0) select vec_id, hit from q""")
def v12_response_cache(spark: SparkSession, d: str) -> DataFrame:
    """The stated questions, every vector whose id is divisible by 50, against a cache of all rows."""
    e = load(spark, d, "embeddings")
    cache = e.select(F.lit("s").alias("scope"), F.concat(F.lit("Question  "), "vec_id").alias("query"), F.col("vec_id").cast("string").alias("response"), "embedding", F.lit(10).cast("bigint").alias("stored_us"))
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.lit("s").alias("scope"), F.concat(F.when(F.col("vec_id") % 3 == 0, "question ").otherwise("other "), "vec_id").alias("query"), "embedding")
    return v.cached_answers(cache, asked, 20, 100).select(F.col("qid").alias("vec_id"), "hit")


@query(f"""with a as (select id, 1.0 / (60 + row_number() over (order by importance desc, id)) as w from {_ONCE} where tenant_id = '{TENANT}' union all
select id, 2.0 / (60 + row_number() over (order by updated_at desc, id)) from {_ONCE} where tenant_id = '{TENANT}') select id, round(sum(w), 9) as rrf from a group by 1""")
def h05_weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    own = memories(spark, d).filter(F.col("tenant_id") == TENANT)
    return r.rrf([r.ranked(own, [F.desc("importance"), F.col("id")]), r.ranked(own, [F.desc("updated_at"), F.col("id")], 2.0)]).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"""with u as (select distinct user_id from {_ONCE} where tenant_id = '{TENANT}' and user_id is not null order by 1 limit 3),
c as (select user_id, id, importance, updated_at, source_event_ids, {_terms('content')} as ts from {_ONCE} where tenant_id = '{TENANT}' and user_id in (select * from u) and state = 'active'),
q as (select unnest(list_distinct({_terms("'" + 'agent step notes' + "'")})) as term), s as (select user_id, count(*)::double as n, greatest(avg(len(ts)), 1.0) as avgdl from c group by 1),
f as (select user_id, id, len(ts)::double as dl, term, len(list_filter(ts, lambda x: x = term))::double as tf from c, q), df as (select user_id, term, count(*)::double as nq from f where tf > 0 group by all),
lex as (select user_id, id, sum(ln((n - nq + 0.5) / (nq + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from f join df using (user_id, term) join s using (user_id) where tf > 0 group by 1, 2),
hits as (select c.user_id, id, 1.0 / (60.0 + row_number() over (partition by user_id order by round(score, 12) desc, id)) * {_BLEND} as score from lex join c using (user_id, id) qualify row_number() over (partition by user_id order by score desc, id) <= 25),
none as (select user_id, id, 0.0 as score from c where user_id not in (select user_id from lex) qualify row_number() over (partition by user_id order by importance desc, id) <= 25)
select id, round(max(score), 9) as score, (select count(distinct x) from (select unnest(source_event_ids) as x from c where c.id = h.id))::bigint as sources from (select * from hits union all select * from none) h group by 1 order by max(score) desc, id limit 25""")
def h09_shared_search(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d, TENANT).withColumn("updated_us", F.unix_micros("updated_at"))
    users = [x.user_id for x in mem.filter(F.col("user_id").isNotNull()).select("user_id").distinct().orderBy("user_id").limit(3).collect()]
    grants = spark.createDataFrame([(TENANT, users[0], u) for u in users[1:]], "tenant_id string, grantee_user_id string, grantor_user_id string")
    ask = lambda s: r.memory_search(mem, s, "agent step notes", 25, NOW_US).select("id", "score", "source_event_ids")
    return r.shared_search(mem, grants, TENANT, users[0], ask, 25).select("id", F.round("score", 9).alias("score"), F.size("source_event_ids").cast("bigint").alias("sources"))


@query(f"""select id, 'expired' as state, {NOW_US} as valid_to from {_ONCE} where state = 'active' and importance < 0.2""")
def b10_expire(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d)
    return m.expired(mem, mem.filter("importance < 0.2"), instant(NOW)).select("id", "state", us("valid_to"))


@query(f"""select id, 'patched' as content, least(1.0, importance + 0.3) as importance, version + 1 as version from {_ONCE} where state = 'active' and mem_type = 'procedural'""")
def b16_patch(spark: SparkSession, d: str) -> DataFrame:
    mem = memories(spark, d)
    none = F.lit(None).cast("string")
    patch = mem.filter("mem_type = 'procedural'").select("id", F.lit("patched").alias("content"), (F.col("importance") + 0.3).alias("importance"), none.alias("mem_type"), none.alias("metadata"))
    return m.patched(mem, patch, instant(NOW)).select("id", "content", "importance", "version")


@query("select distinct tenant_id, src as grantee_user_id, 'u-admin' as grantor_user_id from memory_edges where src like 'u-%'")
def b22_grants(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "memory_edges").filter(F.col("src").startswith("u-")).select("tenant_id", F.col("src").alias("grantee_user_id"), F.lit("u-admin").alias("grantor_user_id"))
    return m.add_grants(e.filter(F.col("tenant_id") == TENANT).distinct(), e)


@query(f"""with x as (select id, trim(content) as c, subject as s, ascii(id[1:1]) % 3 as k from {_ONCE} where trim(content) <> '')
select id, null as subject, c as fact from x where k in (0, 2) union all select id, null, coalesce(s, '-') from x where k = 0 and trim(coalesce(s, '-')) <> '' union all select id, s, c from x where k = 1""")
def b19_extract_facts(spark: SparkSession, d: str) -> DataFrame:
    """Contents as a list of texts, as a list of objects, and as plain text."""
    x = memories(spark, d).filter("trim(content) <> ''").select("id", F.trim("content").alias("c"), F.col("subject").alias("s"), (F.ascii(F.substring("id", 1, 1)) % 3).alias("k"))
    text = F.when(F.col("k") == 0, F.to_json(F.array("c", F.coalesce("s", F.lit("-"))))).when(F.col("k") == 1, F.to_json(F.array(F.struct(F.col("s").alias("subject"), F.col("c").alias("content"))))).otherwise(F.col("c"))
    return x.select("id", F.explode(m.extracted_facts(text)).alias("f")).select("id", "f.subject", F.col("f.content").alias("fact"))


_STATE_LOG = "select id as seq, tenant_id, 'a-' || tenant_id as agent_id, event_type as key, payload as value, case when epoch_us(ts) % 7 = 0 then 'delete' else 'set' end as op from (select distinct id, tenant_id, event_type, payload, ts from episodic)"


@query(f"""select 'memory' as stream, case when state = 'active' then 'upserted' else state end as event, id as key, tenant_id from {_ONCE}
union all select 'state', op, coalesce(agent_id || '/', '') || key, tenant_id from ({_STATE_LOG})""")
def t01_change_stream(spark: SparkSession, d: str) -> DataFrame:
    return change_stream(memories(spark, d), state_log(spark, d)).select("stream", "event", "key", "tenant_id")


@query(f"""select 'state' as stream, op as event, agent_id || '/' || key as key from ({_STATE_LOG}) where tenant_id = '{TENANT}'""")
def t03_watch(spark: SparkSession, d: str) -> DataFrame:
    return watch(change_stream(memories(spark, d), state_log(spark, d)), TENANT, "state", f"a-{TENANT}").select("stream", "event", "key")


def state_log(spark: SparkSession, d: str) -> DataFrame:
    """The distinct events as operations on state."""
    e = load(spark, d, "episodic").select("id", "tenant_id", "event_type", "payload", "ts").distinct()
    return e.select(F.col("id").alias("seq"), "tenant_id", F.concat(F.lit("a-"), "tenant_id").alias("agent_id"), F.col("event_type").alias("key"), F.col("payload").alias("value"), F.when(F.unix_micros("ts") % 7 == 0, "delete").otherwise("set").alias("op"))


# --- sinks ---------------------------------------------------------------------------------------------------------
@query()
def k06_note_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.note_export(memories(spark, d), edges(spark, d))


@query(f"select id from {_ONCE} where tenant_id = '{TENANT}' and state = 'active'")
def k07_tenant_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tenant_export({"memories": memories(spark, d)}, TENANT)["memories"].select("id")


QUERIES, ORACLES = query.queries, query.sql
