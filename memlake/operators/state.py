"""Versioned key-value state, retention, sessions and the run ledger, over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_state(log: DataFrame, now: Column | None = None) -> DataFrame:
    """The visible state from a log of (agent_id, key, op, value, expected, ttl_us, at, seq), in order of (at, seq).

    ``set`` writes and clears the time to live, ``set_ttl`` writes with one, ``delete`` removes, ``cas`` writes only on
    the expected version. Without ``cas`` in the log this is one window; a key is visible until it expires. Versions
    count the writes since the last deletion.
    """
    w = Window.partitionBy("agent_id", "key").orderBy("at", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    life = F.sum((F.col("op") == "delete").cast("int")).over(upto)
    alive = log.filter("op in ('set', 'set_ttl', 'delete')").withColumn("life", life).filter("op <> 'delete'")
    count = alive.groupBy("agent_id", "key", "life").agg(
        F.count(F.lit(1)).alias("version"),
        F.max_by(F.struct("value", "at", F.when(F.col("op") == "set_ttl", F.col("at") + F.col("ttl_us")).alias("expires_at")), F.struct("at", "seq")).alias("r"),
        F.max(F.struct("at", "seq")).alias("last"),
    )
    top = log.groupBy("agent_id", "key").agg(F.max(F.struct("at", "seq")).alias("end"), F.max_by("op", F.struct("at", "seq")).alias("op"))
    newest = count.groupBy("agent_id", "key").agg(F.max_by(F.struct("version", "r"), "life").alias("x"))
    out = newest.join(top.filter("op <> 'delete'").select("agent_id", "key"), ["agent_id", "key"]).select("agent_id", "key", "x.r.value", "x.version", F.col("x.r.at").alias("updated_at"), "x.r.expires_at")
    return out if now is None else out.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def replay_state(log: DataFrame) -> DataFrame:
    """As ``fold_state``, for logs with compare-and-set: each key's operations are replayed in order; a column ``applied``
    (of the cas operations, how many took hold) is added. Work on one key is sequential by nature: its sorted
    operations pass through one task as a stream, of which a task only keeps the current value."""
    cols = ["agent_id", "key", "op", "value", "expected", "ttl_us", "at", "seq"]
    out = pa.schema([("agent_id", pa.string()), ("key", pa.string()), ("value", pa.string()), ("version", pa.int64()), ("updated_at", pa.int64()), ("expires_at", pa.int64()), ("applied", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, version, value, at, expires, applied = None, 0, None, None, None, 0
        for b in batches:
            done = []
            for agent, key, op, new, expected, ttl, when in zip(*(b.column(c).to_pylist() for c in cols[:-1]), strict=True):
                if (agent, key) != name:
                    if version:
                        done.append((*name, value, version, at, expires, applied))
                    name, version, value, at, expires, applied = (agent, key), 0, None, None, None, 0
                if op == "delete":
                    version, value = 0, None
                elif op in ("set", "set_ttl") or (op == "cas" and expected == version):
                    version, value, at, applied = version + 1, new, when, applied + (op == "cas")
                    expires = when + ttl if op == "set_ttl" else None
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in done], schema=out)
        if version:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*name, value, version, at, expires, applied), strict=True))], schema=out)

    placed = log.select(*cols).repartition("agent_id", "key").sortWithinPartitions("agent_id", "key", "at", "seq")
    return placed.mapInArrow(run, "agent_id string, key string, value string, version bigint, updated_at bigint, expires_at bigint, applied bigint")


def by_prefix(state: DataFrame, prefix: str) -> DataFrame:
    """Entries whose agent begins with ``prefix``, taken literally."""
    return state.filter(F.col("agent_id").startswith(prefix))


def retained(events: DataFrame, policies: DataFrame, default_days: int, now: Column) -> DataFrame:
    """Events that retention keeps: younger than their source's days (0 keeps for ever), else than the default's.

    ``policies`` (source, days) meets the events as a left join; Spark broadcasts it only below its size threshold.
    """
    p = policies.groupBy("source").agg(F.max("days").alias("days"))
    days = F.coalesce("days", F.lit(default_days))
    return events.join(p, "source", "left").filter((days == 0) | (F.col("ts") >= now - F.make_dt_interval(days))).drop("days")


def session_list(sessions: DataFrame, agent: str, limit: int) -> DataFrame:
    """An agent's sessions, newest start first."""
    return sessions.filter(F.col("agent_id") == agent).orderBy(F.desc("started_at"), "session_id").limit(limit)


def ended(sessions: DataFrame, session_id: str, at: Column, summary: str | None) -> DataFrame:
    """The sessions with one ended."""
    hit = F.col("session_id") == session_id
    return sessions.withColumn("ended_at", F.when(hit, at).otherwise(F.col("ended_at"))).withColumn("summary", F.when(hit, F.lit(summary)).otherwise(F.col("summary")))


def session_digest(events: DataFrame, first: int = 200, chars: int = 300) -> DataFrame:
    """(session_id, n, digest): the first events of each session as lines, each payload cut to ``chars``."""
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    top = events.filter("session_id is not null").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first)
    line = F.concat(F.lit("["), F.col("event_type"), F.lit("] "), F.substring("payload", 1, chars)).alias("line")
    g = top.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("r", line))).alias("l"))
    return g.select("session_id", "n", F.concat(F.lit("Session "), "session_id", F.lit(":\n"), F.array_join("l.line", "\n")).alias("digest"))


def session_start(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """The sessions with new ones (session_id, parent_session_id, agent_id, started_at, metadata, tenant_id); an id that
    is there stays as it is."""
    once = new.dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti")
    return sessions.unionByName(once, allowMissingColumns=True)


def recalled(sessions: DataFrame, events: DataFrame, tenant: str, session_id: str, limit: int) -> DataFrame:
    """The last events of one session of a tenant, oldest first; none for another tenant's session."""
    own = sessions.filter((F.col("tenant_id") == tenant) & (F.col("session_id") == session_id)).select("session_id").distinct()
    mine = events.filter((F.col("tenant_id") == tenant) & (F.col("session_id") == session_id)).join(own, "session_id", "left_semi")
    return mine.orderBy(F.desc("ts"), F.desc("id")).limit(limit).orderBy("ts", "id")


def swept(state: DataFrame, now: Column) -> DataFrame:
    """The state without the entries that have expired."""
    return state.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def run_list(runs: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    """Runs of a folded ledger, newest first."""
    out = runs if status is None else runs.filter(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def run_trace(events: DataFrame, run: str) -> DataFrame:
    """The steps of one run in order: the events whose session is the run."""
    return events.filter(F.col("session_id") == run).orderBy("ts", "id")


def stale_runs(runs: DataFrame, before: Column, limit: int) -> DataFrame:
    """Runs that are pending or running and not updated since ``before``, oldest first."""
    return runs.filter(F.col("status").isin("pending", "running") & (F.col("updated_at") < before)).orderBy("updated_at", "id").limit(limit)


def fold_runs(log: DataFrame) -> DataFrame:
    """The current row of each run from a log of patches: the last non-null value of every column (of equal times the greatest), created once."""
    rest = [c for c in log.columns if c not in ("id", "created_at", "updated_at")]
    return log.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", c))).alias(c) for c in rest], F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    ).select(*log.columns)


def audit_since(audit: DataFrame, since: Column, tenant: str | None = None, limit: int = 1000) -> DataFrame:
    """Audit entries since an instant, newest first."""
    out = audit.filter(F.col("timestamp") >= since)
    out = out if tenant is None else out.filter(F.col("tenant") == tenant)
    return out.orderBy(F.desc("timestamp"), "identity", "path").limit(limit)


def topological_order(nodes: dict[str, list[str]]) -> list[str] | None:
    """Kahn's order of a small workflow (node -> what it waits for), in the order given; None on a circle or an unknown name."""
    if any(d not in nodes for deps in nodes.values() for d in deps):
        return None
    done: list[str] = []
    waiting = {n: set(d) for n, d in nodes.items()}
    while waiting:
        ready = [n for n, d in waiting.items() if not d]
        if not ready:
            return None
        done.append(ready[0])
        waiting.pop(ready[0])
        for d in waiting.values():
            d.discard(ready[0])
    return done
