"""The queries of the training-data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.features import entity_features, feature_columns
from memlake.operators.hierarchy import descendants, hierarchy, paths
from memlake.operators.history import merged_updates, update_log, version_history, versions
from memlake.operators.intervals import periods_and_gaps, subject_entity
from memlake.operators.sessions import sessionize
from memlake.plans.shared import written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(spark.read.parquet(f"{d}/audit_log.parquet"), "identity", "timestamp")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cells = entity_features(spark.read.parquet(f"{d}/episodic.parquet"), "source", "event_type", "ts", "payload", "id", "idempotency_key")
    return cells.select(F.col("entity").alias("source"), F.col("kind").alias("event_type"), F.col("n").alias("n_events"), "last_us", F.col("total").alias("total_units"))


def p3_features(spark: SparkSession, d: str) -> DataFrame:
    """One row for each source, with one feature column group for each of its tables' event types in order of name."""
    cells = written(entity_features(spark.read.parquet(f"{d}/episodic.parquet"), "source", "event_type", "ts", "payload", "id", "idempotency_key"), "cells")
    types = [r.kind for r in cells.select("kind").distinct().orderBy("kind").limit(10_001).collect()]
    wide = feature_columns(cells, types)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    return wide.select(F.col("entity").alias("source"), F.lit(len(types)).cast("bigint").alias("n_types"), text("n").alias("n_events"), text("last_us").alias("last_us"), text("total").alias("total_units"))


_OUTER = r"(?U)^\s+|\s+$"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = version_history(spark.read.parquet(f"{d}/memories.parquet"), subject_entity(), [F.regexp_replace("content", _OUTER, "")], "valid_from", "valid_to", "version", "id")
    return found.select("entity", "from_us", "to_us")


def p4_merge(spark: SparkSession, d: str) -> DataFrame:
    """The history of all rows, built from three quarters of them and the rest merged in as one batch of updates."""
    log = update_log(spark.read.parquet(f"{d}/memories.parquet"), subject_entity(), [F.regexp_replace("content", _OUTER, "")], "valid_from", "valid_to", "version", "id")
    late = F.pmod(F.coalesce(F.xxhash64("id", "s", "h"), F.lit(0)), F.lit(4)) == 0
    return merged_updates(versions(log.where(~late)), log.where(~late), log.where(late)).select("entity", "from_us", "to_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(spark.read.parquet(f"{d}/memories.parquet"), subject_entity(), "valid_from", "valid_to", "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(spark.read.parquet(f"{d}/episodic.parquet"), "id", "parent_id", "trace_id")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    way = paths(spark.read.parquet(f"{d}/episodic.parquet"), "id", "parent_id", "trace_id")
    return way.select("id", F.array_join("path", ">").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(spark.read.parquet(f"{d}/episodic.parquet"), "id", "parent_id", "trace_id")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_features, p4_found, p4_merge, p5_found, p6_found, p6_paths, p6_descendants)}

_ENTITY = r"""coalesce(tenant_id, '') || '|' || coalesce(user_id, '') || '|' ||
  trim(regexp_replace(lower(subject), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"""
_PERIODS = f"""select distinct on (coalesce(id, '')) {_ENTITY} as entity, epoch_us(valid_from) as s,
  coalesce(epoch_us(valid_to), 9223372036854775807) as e, version,
  regexp_replace(content, '^\\s+|\\s+$', '', 'g') as content from memories"""

ORACLES = {
    "p1_found": """
with e as (select distinct * from audit_log),
n as (select lower(trim(identity, ' \t')) as identity, epoch_us("timestamp") as t from e),
g as (select *, coalesce(t - lag(t) over w > 1800000000, true) as opens from n where identity <> '' and t is not null
      window w as (partition by identity order by t)),
s as (select *, sum(opens::int) over (partition by identity order by t rows unbounded preceding) as k from g)
select identity, min(t) as start_us, max(t) as end_us, count(*)::bigint as n_entries from s group by identity, k""",
    "p3_found": """
with one as (select id, max(source) as source, max(event_type) as event_type, max(payload) as payload, max(ts) as ts, max(idempotency_key) as k
             from episodic where id is not null group by id),
f as (select * from (select *, row_number() over (partition by k order by ts, id) as r from one) where k is null or r = 1),
u as (select source, lower(trim(event_type, ' \t')) as event_type, epoch_us(ts) as t,
      case when json_valid(payload) and regexp_full_match(json_extract_string(payload, '$.units'), '\\s*[+-]?\\d{1,19}\\s*')
           then cast(json_extract_string(payload, '$.units') as bigint) else 0 end as units from f)
select source, event_type, count(*)::bigint as n_events, max(t) as last_us, sum(units)::bigint as total_units from u group by 1, 2""".replace("\\\\", "\\"),
    "p4_found": f"""
with r as ({_PERIODS}),
k as (select * from (select *, row_number() over (partition by entity, s order by version desc) as rn from r
      where entity not like '%|' and e > s) where rn = 1),
h as (select *, least(e, coalesce(lead(s) over (partition by entity order by s), 9223372036854775807)) as till from k),
c as (select *, coalesce(lag(content) over w is distinct from content or lag(till) over w <> s, true) as opens from h
      window w as (partition by entity order by s)),
v as (select *, sum(opens::int) over (partition by entity order by s rows unbounded preceding) as n from c)
select entity, min(s) as from_us, case when max(till) = 9223372036854775807 then -1 else max(till) end as to_us from v group by entity, n""",
    "p5_found": f"""
with r as (select * from ({_PERIODS}) where entity not like '%|' and e > s),
m as (select *, max(e) over (partition by entity order by s, e rows between unbounded preceding and 1 preceding) as before from r),
i as (select *, sum((before is null or s > before)::int) over (partition by entity order by s, e rows unbounded preceding) as n from m),
p as (select entity, n, min(s) as a, max(e) as b from i group by entity, n),
q as (select *, lag(b) over (partition by entity order by a) as last from p)
select entity, 'period' as kind, a as from_us, case when b = 9223372036854775807 then -1 else b end as to_us from p
union all select entity, 'gap', last, a from q where last is not null""",
    "p6_found": """
with recursive one as (select lower(trim(id)) as id, max(nullif(lower(trim(parent_id)), '')) as p from episodic where trim(id) <> '' group by 1),
n as (select a.id, b.id as p from one a left join one b on a.p = b.id),
up(id, anc) as (select id, p from n where p is not null union select up.id, n.p from up join n on up.anc = n.id where n.p is not null),
circle as (select id from up where id = anc),
hang as (select distinct id from up where anc in (select id from circle) and id not in (select id from circle)),
top as (select id, max(case when anc in (select id from n where p is null) then anc end) as root, count(*) as d from up group by id),
below as (select anc as id, count(*) as c from up where anc <> id group by 1)
select n.id, case when c.id is not null or h.id is not null then '' else coalesce(t.root, n.id) end as root_id,
  (case when c.id is not null then -1 when h.id is not null then -2 else coalesce(t.d, 0) end)::bigint as depth, coalesce(b.c, 0)::bigint as n_descendants
from n left join circle c using (id) left join hang h using (id) left join top t using (id) left join below b using (id)""",
    "p6_paths": """
with recursive one as (select lower(trim(id)) as id, max(nullif(lower(trim(parent_id)), '')) as p from episodic where trim(id) <> '' group by 1),
n as (select a.id, b.id as p from one a left join one b on a.p = b.id),
way(id, path) as (select id, id from n where p is null union all select n.id, way.path || '>' || n.id from way join n on n.p = way.id)
select n.id, way.path from n left join way using (id)""",
    "p6_descendants": """
with recursive one as (select lower(trim(id)) as id, max(nullif(lower(trim(parent_id)), '')) as p from episodic where trim(id) <> '' group by 1),
n as (select a.id, b.id as p from one a left join one b on a.p = b.id),
way(id, path) as (select id, [id] from n where p is null union all select n.id, list_append(way.path, n.id) from way join n on n.p = way.id)
select path[i] as id, id as descendant, (len(path) - i)::bigint as steps from (select id, path, unnest(range(1, len(path))) as i from way)""",
}
ORACLES["p4_merge"] = ORACLES["p4_found"]
ORACLES["p3_features"] = f"""with c as ({ORACLES["p3_found"]}), t as (select distinct event_type from c), s as (select distinct source from c)
select s.source, count(*)::bigint as n_types, string_agg(coalesce(n_events, 0), ',' order by t.event_type) as n_events, string_agg(coalesce(last_us::varchar, '-'), ',' order by t.event_type) as last_us,
string_agg(coalesce(total_units, 0), ',' order by t.event_type) as total_units from s cross join t left join c on c.source = s.source and c.event_type = t.event_type group by 1"""
