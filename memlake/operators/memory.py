"""Bi-temporal memories: contradiction folds, time travel, forgetting, consolidation and the change log.

A table of memories is a log: the current row of an id is its latest version. Operators that change memories return the
new rows to append; ``latest`` folds the log. Times are passed in, never read from a clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from memlake.functions.scalars import json_text, scope_key
from memlake.functions.text import normalize_subject
from memlake.plans.runs import changes, numbered, ordered_blocks, rescanned
from memlake.plans.shared import micros

SCOPE = ["tenant_id", "user_id", "agent_id", "session_id"]


@dataclass(frozen=True)
class Scope:
    """An exact owner: a field left None matches null alone; an empty tenant is ``default``."""

    tenant_id: str
    user_id: str | None = None
    agent_id: str | None = None
    session_id: str | None = None

    def predicate(self) -> Column:
        out = F.col("tenant_id") == (self.tenant_id or "default")
        for c in SCOPE[1:]:
            out = out & F.col(c).eqNullSafe(F.lit(getattr(self, c)))
        return out


def key_of_scope() -> Column:
    return scope_key(*[F.col(c) for c in SCOPE])


def latest(log: DataFrame, id: str = "id") -> DataFrame:
    """The current row of each id: highest version, then latest update, then by all columns."""
    rest = [c for c in log.columns if c != id]
    order = F.struct(*[F.col(c) for c in ("version", "updated_at") if c in rest], F.struct(*[F.col(c) for c in rest if log.schema[c].dataType.typeName() not in ("map", "variant")]))
    return log.groupBy(id).agg(F.max_by(F.struct(*rest), order).alias("r")).select(id, "r.*").select(*log.columns)


_BLANK = r"(?U)^\s+|\s+$"


def same_text(c: Column) -> Column:
    """A content as it is compared: without white space at its ends, of whatever kind."""
    return F.regexp_replace(c, _BLANK, "")


def fold_contradictions(events: DataFrame, key: list[str], content: str, time: str, seq: str) -> DataFrame:
    """Memories from a stream of statements: equal ones confirm, a different one supersedes.

    One row for each run of equal trimmed contents of a key, in order of (time, seq): version counts the statements,
    importance is their maximum, the run holds until the next begins. A null content equals another null. The
    statements are walked in ordered blocks (``plans.runs``), so a hot key spreads over many tasks.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    keyed = events.select(
        F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).alias("k"),
        F.col(time).alias("at"),
        F.xxhash64(F.col(content).isNull(), same_text(F.col(content))).alias("h"),
        F.col(content).cast("string").alias("content"),
        F.col("importance").cast("double").alias("importance"),
        F.col(seq).alias("__seq"),
    )

    def fold(t: pa.Table) -> tuple[dict, pa.Table]:
        new, h = changes(t, ["k"]), t.column("h").to_numpy()
        opens = new.copy()
        opens[1:] |= h[1:] != h[:-1]
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(h)) - 1
        at = t.column("at").cast(pa.int64()).to_numpy()
        best = np.maximum.reduceat(np.nan_to_num(t.column("importance").to_numpy(zero_copy_only=False), nan=-np.inf), first)
        names = t.column("k").take(pa.array(first))
        runs = pa.table({"k": names, "content": t.column("content").take(pa.array(first)), "s": at[first], "seen": at[last], "n": last - first + 1, "best": best})
        tail = int(np.count_nonzero(opens[np.flatnonzero(new)[-1] :]))  # runs of the block's last key
        head = {"k0": names[0].as_py(), "h0": int(h[0]), "s0": int(at[0]), "k1": names[-1].as_py(), "h1": int(h[-1]), "s1": int(at[first[-1]]), "e1": int(at[-1]), "n1": int(last[-1] - first[-1] + 1), "b1": float(best[-1]), "c1": runs.column("content")[-1].as_py(), "runs": int(len(first)), "tail": tail}
        return head, runs

    def carry(heads: list) -> list:
        """The open run that each block may go on with, its number, and how the block's last run ends."""
        out, run, number = [], None, 0
        for i, x in enumerate(heads):
            q = heads[i + 1] if i + 1 < len(heads) else None
            same = run is not None and run["k"] == x.k0
            joins = same and run["h"] == x.h0
            goes_on = bool(q and q.k0 == x.k1 and q.h0 == x.h1)
            base = (number if joins else number + 1) if same else 1
            out.append({"run": run if joins else None, "base": base, "open": goes_on, "until": q.s0 if q and q.k0 == x.k1 and not goes_on else None})
            number = base + x.runs - 1 if x.k1 == x.k0 else x.tail
            alone = joins and x.runs == 1
            run = {"k": x.k1, "h": x.h1, "s": run["s"] if alone else x.s1, "n": x.n1 + (run["n"] if alone else 0), "best": max(x.b1, run["best"]) if alone else x.b1, "content": run["content"] if alone else x.c1}
        return out

    def emit(runs: pa.Table, c: dict) -> pa.Table:
        new = changes(runs, ["k"])
        s, n, best, content = runs.column("s").to_numpy().copy(), runs.column("n").to_numpy().copy(), runs.column("best").to_numpy().copy(), runs.column("content").to_pylist()
        if r := c["run"]:
            s[0], n[0], best[0], content[0] = r["s"], n[0] + r["n"], max(best[0], r["best"]), r["content"]
        place = np.arange(len(s))
        number = place - np.maximum.accumulate(np.where(new, place, 0)) + 1
        second = int(np.flatnonzero(new)[1]) if new.sum() > 1 else len(s)
        number[:second] += c["base"] - 1
        until = pa.array(np.append(s[1:], 0), mask=np.append(new[1:], True))
        if c["until"] is not None:
            until = pa.concat_arrays([until.slice(0, len(s) - 1), pa.array([c["until"]], pa.int64())])
        out = pa.table({"k": runs.column("k"), "island": number, "content": pa.array(content, pa.string()), "importance": pa.array(best, mask=np.isneginf(best)), "version": n, "valid_from": s, "valid_to": until, "seen": runs.column("seen")})
        return out.slice(0, len(s) - c["open"])

    edges = "k0 string, h0 bigint, s0 bigint, k1 string, h1 bigint, s1 bigint, e1 bigint, n1 bigint, b1 double, c1 string, runs bigint, tail bigint"
    numeric = micros(keyed, "at")
    blocks = ordered_blocks(keyed.withColumn("at", numeric), ["k", "at", "__seq"], [F.col("k"), F.col("at"), F.col("__seq")], fold, edges, events.count(), "statements")
    rows = rescanned(blocks, carry, emit, "k string, island bigint, content string, importance double, version bigint, valid_from bigint, valid_to bigint, seen bigint")
    back = (lambda c: F.timestamp_micros(c)) if kinds[time].typeName().startswith("timestamp") else (lambda c: F.col(c).cast(kinds[time]))
    whole = F.from_json("k", StructType([StructField(c, kinds[c]) for c in key]))
    return rows.select(
        *[whole[c].alias(c) for c in key],
        "island",
        F.col("content").cast(kinds[content]).alias("content"),
        "importance",
        "version",
        back("valid_from").alias("valid_from"),
        back("valid_to").alias("valid_to"),
        F.when(F.col("valid_to").isNull(), "active").otherwise("superseded").alias("state"),
        F.coalesce(back("valid_to"), back("seen")).alias("updated_at"),
        F.when(F.col("island") > 1, F.col("island") - 1).alias("supersedes"),
    )


def additions(current: DataFrame, new: DataFrame, review: bool = False) -> DataFrame:
    """What adding each statement of a batch does, one after the other, given the memories that are there.

    ``new`` has id, the scope, subject, content, importance, source_event_ids, metadata, mem_type, embedding, at
    (timestamp) and seq, the order of arrival. Per scope and subject, a statement whose trimmed content is that of the
    newest active memory *confirms* it; else, where some are active, it *supersedes* them all (or, in review, stands
    beside them as a *conflict*); else it is *inserted*. Statements with a null or blank subject are always inserted;
    a null importance is 0.5.
    Columns: those of ``new``, subject normalised, with outcome, target (the newest active memory before it), island
    (the number of changes of content so far) and head (the id of the memory that holds its content). A batch's
    statements on one subject are sorted in one task; a stream of any size goes through ``fold_contradictions``.
    """
    j = F.when(normalize_subject(F.col("subject")) != "", normalize_subject(F.col("subject")))
    newest = current.filter("state = 'active'").select(*SCOPE, j.alias("subject"), "valid_from", "id", same_text(F.col("content")).alias("t")).filter("subject is not null")
    newest = newest.groupBy(*[F.col(c).alias(f"__{c}") for c in (*SCOPE, "subject")]).agg(F.max_by(F.struct("id", "t"), F.struct("valid_from", "id")).alias("a"))
    asked = new.withColumn("tenant_id", F.coalesce(F.when(F.col("tenant_id") != "", F.col("tenant_id")), F.lit("default"))).withColumn("subject", j).withColumn("importance", F.coalesce("importance", F.lit(0.5)))
    place = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SCOPE] + [F.col("subject") == F.col("__subject")]
    met = asked.join(newest, reduce(and_, place), "left").select(*asked.columns, F.col("a.id").alias("__id"), F.col("a.t").alias("__t"))
    own = F.when(F.col("subject").isNull(), F.col("id"))  # a statement without subject stands for itself
    w = Window.partitionBy(*SCOPE, "subject", own).orderBy("seq", "id")
    text, before = same_text(F.col("content")), F.lag(same_text(F.col("content"))).over(w)
    first = F.row_number().over(w) == 1
    there = ~first | F.col("__id").isNotNull()
    same = there & text.eqNullSafe(F.when(first, F.col("__t")).otherwise(before))
    out = met.withColumn("__same", same).withColumn("__there", there)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("island", F.sum((~F.col("__same")).cast("bigint")).over(upto))
    out = out.withColumn("head", F.coalesce(F.last(F.when(~F.col("__same"), F.col("id")), True).over(upto), F.col("__id")))
    earlier = F.coalesce(F.last(F.when(~F.col("__same"), F.col("id")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__id"))
    return out.select(
        *asked.columns,
        F.when(F.col("__same"), "confirmed").when(~F.col("__there"), "inserted").when(F.lit(review), "conflict").otherwise("superseded").alias("outcome"),
        earlier.alias("target"),
        "island",
        "head",
    )


def applied(current: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows to append to the log of memories for a batch planned by ``additions``: new memories, and the old ones
    that it confirmed or closed. A memory that several statements confirm comes once, with all of them counted."""
    group = [*SCOPE, "subject"]
    key = [*group, F.when(F.col("subject").isNull(), F.col("id"))]
    runs = plan.groupBy(*key, "island", "head").agg(
        F.min_by(F.struct("id", "content", "source_event_ids", "metadata", "mem_type", "embedding", "at", "outcome", "target"), F.struct("seq", "id")).alias("f"),
        F.max("importance").alias("importance"), F.count(F.lit(1)).alias("n"), F.max("at").alias("seen"),
    )
    w = Window.partitionBy(*group, F.when(F.col("subject").isNull(), F.col("head"))).orderBy("island")
    runs = runs.withColumn("until", F.lead("f.at").over(w)).withColumn("next", F.lead("f.outcome").over(w))
    closed = F.col("next") == "superseded"
    made = runs.filter("f.outcome <> 'confirmed'").select(
        F.col("f.id").alias("id"), *group, "f.content", "importance", F.col("f.at").alias("valid_from"), F.when(closed, F.col("until")).alias("valid_to"), F.when(closed, "superseded").otherwise("active").alias("state"),
        F.when(F.col("f.outcome") == "superseded", F.col("f.target")).alias("supersedes"), "f.source_event_ids", F.col("n").alias("version"), F.col("f.at").alias("created_at"), F.when(closed, F.col("until")).otherwise(F.col("seen")).alias("updated_at"), "f.metadata", "f.mem_type", "f.embedding",
    )
    # what happened to memories that were there: confirmations of the newest one, then the first change closes all
    kept = runs.filter("f.outcome = 'confirmed' and subject is not null and island = 0").select(F.col("head").alias("id"), F.struct("n", "importance", "seen", F.col("f.embedding").alias("embedding")).alias("c"))
    change = runs.filter("f.outcome = 'superseded'").groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.min("f.at").alias("closing"))
    live = current.filter("state = 'active'").withColumn("__j", normalize_subject(F.col("subject")))
    place = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SCOPE] + [F.col("__j") == F.col("__subject")]
    old = live.join(change, reduce(and_, place), "left").select(*current.columns, "closing").join(kept, "id", "left").filter("closing is not null or c is not null")
    old = (
        old.withColumn("importance", F.greatest("importance", F.coalesce("c.importance", "importance")))
        .withColumn("version", F.col("version") + F.coalesce("c.n", F.lit(0)))
        .withColumn("embedding", F.coalesce("c.embedding", "embedding"))
        .withColumn("state", F.when(F.col("closing").isNotNull(), "superseded").otherwise(F.col("state")))
        .withColumn("valid_to", F.coalesce("closing", "valid_to"))
        .withColumn("updated_at", F.coalesce("closing", "c.seen"))
    )
    cols = [f.name for f in current.schema.fields]
    return old.select(*cols).unionByName(made.select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in cols]))


def as_of(mem: DataFrame, at: Column, keys: list[str] | None = None) -> DataFrame:
    """The memory of each scope and subject that held at an instant (half-open, state ignored): the newest start, ties by id."""
    keys = keys or [*SCOPE, "subject"]
    held = mem.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    w = Window.partitionBy(*keys).orderBy(F.desc("valid_from"), "id")
    return held.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def history(mem: DataFrame, scope: Scope, subject: str) -> DataFrame:
    """All versions of a subject in a scope, oldest first."""
    return mem.filter(scope.predicate() & (normalize_subject(F.col("subject")) == normalize_subject(F.lit(subject)))).orderBy("valid_from", "id")


def strength(now: Column, half_life_days: float = 30.0) -> Column:
    """Importance halved for every ``half_life_days`` of calendar days since the start."""
    return F.col("importance") * F.pow(F.lit(0.5), F.datediff(now, F.col("valid_from")) / max(half_life_days, 0.001))


def decayed(mem: DataFrame, now: Column, half_life_days: float = 30.0, threshold: float = 0.05) -> DataFrame:
    """The active memories that are due to be forgotten."""
    return mem.filter((F.col("state") == "active") & (strength(now, half_life_days) < threshold))


def expired(mem: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """New rows that expire the active memories among ``ids``."""
    return mem.filter("state = 'active'").join(ids.select("id").distinct(), "id", "left_semi").withColumn("valid_to", now).withColumn("updated_at", now).withColumn("state", F.lit("expired")).select(*mem.columns)


def over_cap(mem: DataFrame, cap: int) -> DataFrame:
    """Active memories beyond the ``cap`` best of their scope by importance, then last update; none for cap 0."""
    if cap <= 0:
        return mem.limit(0)
    return numbered(mem.filter("state = 'active'"), SCOPE, [F.desc("importance"), F.desc("updated_at"), F.col("id")]).filter(F.col("__r") > cap).drop("__r")


def contradictions(mem: DataFrame) -> DataFrame:
    """(scope, subject, n, ids): subjects with several active memories, ids sorted. Groups are the live versions of one subject."""
    act = mem.filter("state = 'active'").select(*SCOPE, normalize_subject(F.col("subject")).alias("subject"), "id").filter("subject <> ''")
    return act.groupBy(*SCOPE, "subject").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).filter("n > 1")


def resolved(mem: DataFrame, scope: Scope, subject: str, keep: str, now: Column) -> DataFrame:
    """New rows that supersede all active memories of a subject but one; fails if that one is not active."""
    act = mem.filter(scope.predicate() & (F.col("state") == "active") & (normalize_subject(F.col("subject")) == normalize_subject(F.lit(subject))))
    if not act.filter(F.col("id") == keep).limit(1).count():
        raise ValueError(f"{keep} is not an active memory of this subject")
    return act.filter(F.col("id") != keep).withColumn("state", F.lit("superseded")).withColumn("valid_to", now).withColumn("updated_at", now)


def verdict(text: str) -> str | None:
    """A feedback verdict from loose text."""
    t = text.strip().lower()
    return {"helpful": "helpful", "good": "helpful", "useful": "helpful", "up": "helpful", "wrong": "wrong", "incorrect": "wrong", "bad": "wrong", "down": "wrong", "obsolete": "obsolete", "stale": "obsolete", "outdated": "obsolete"}.get(t)


def feedback(mem: DataFrame, votes: DataFrame, now: Column) -> DataFrame:
    """New rows after feedback (id, verdict): helpful adds 0.1 to the importance (1 at most) and a version, wrong or obsolete expires."""
    v = mem.filter("state = 'active'").join(votes.groupBy("id").agg(F.max("verdict").alias("verdict")), "id")
    good = F.col("verdict") == "helpful"
    return (
        v.withColumn("importance", F.when(good, F.least(F.col("importance") + 0.1, F.lit(1.0))).otherwise(F.col("importance")))
        .withColumn("version", F.when(good, F.col("version") + 1).otherwise(F.col("version")))
        .withColumn("state", F.when(good, F.col("state")).otherwise("expired"))
        .withColumn("valid_to", F.when(good, F.col("valid_to")).otherwise(now))
        .withColumn("updated_at", now)
        .select(*mem.columns)
    )


def patched(mem: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """New rows after a patch (id, content, importance, mem_type, metadata; null leaves): active ones only, importance kept in [0, 1]."""
    p = patch.select("id", *[F.col(c).alias(f"p_{c}") for c in ("content", "importance", "mem_type", "metadata")])
    new = mem.filter("state = 'active'").join(p, "id")
    for c in ("content", "mem_type", "metadata"):
        new = new.withColumn(c, F.coalesce(f"p_{c}", c))
    imp = F.when(F.col("p_importance").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_importance")))).otherwise(F.col("importance"))
    return new.withColumn("importance", imp).withColumn("version", F.col("version") + 1).withColumn("updated_at", now).select(*mem.columns)


def provenance(mem: DataFrame, events: DataFrame) -> DataFrame:
    """(id, event_id, event_type, ts): the source events of each memory, within its tenant."""
    m = mem.select(F.col("id").alias("memory_id"), "tenant_id", F.explode("source_event_ids").alias("event_id"))
    e = events.select(F.col("id").alias("event_id"), "tenant_id", "event_type", "ts")
    return m.join(e, ["event_id", "tenant_id"]).select("memory_id", "event_id", "event_type", "ts")


def list_paged(mem: DataFrame, scope: Column, limit: int, offset: int = 0, mem_type: str | None = None, min_importance: float | None = None, since: Column | None = None, until: Column | None = None, metadata: tuple[str, str] | None = None) -> DataFrame:
    """Active memories of a scope under all given filters, a page of them by importance, then newest start.

    A metadata key with other characters than letters, digits, ``_`` and ``.`` gives an empty result."""
    out = mem.filter(scope & (F.col("state") == "active"))
    if mem_type is not None:
        out = out.filter(F.col("mem_type") == mem_type)
    if min_importance is not None:
        out = out.filter(F.col("importance") >= max(0.0, min(1.0, min_importance)))
    if since is not None:
        out = out.filter(F.col("updated_at") >= since)
    if until is not None:
        out = out.filter(F.col("updated_at") < until)
    if metadata is not None:
        out = out.filter(json_text(F.col("metadata"), metadata[0]) == metadata[1])
    return out.orderBy(F.desc("importance"), F.desc("valid_from"), "id").offset(offset).limit(limit)


def consolidated_tail(mem: DataFrame, keep: int = 20, each: int = 1_000) -> DataFrame:
    """Bullet summaries (importance 0.6) of the active memories of each scope beyond its ``keep`` best, with their ids.

    One for each ``each`` memories in order of importance (column part, from 0), so that no row grows with the scope;
    a scope with fewer has one summary.
    """
    tail = numbered(mem.filter("state = 'active'"), SCOPE, [F.desc("importance"), F.desc("valid_from"), F.col("id")], "r").filter(F.col("r") > keep)
    lines = F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("- "), F.col("content")).alias("line"), "id")))
    grouped = tail.groupBy(*SCOPE, F.floor((F.col("r") - keep - 1) / each).alias("part")).agg(F.count(F.lit(1)).alias("n"), lines.alias("l"))
    text = F.concat(F.lit("Consolidated "), F.col("n").cast("string"), F.lit(" memories:\n"), F.array_join("l.line", "\n"))
    return grouped.select(*SCOPE, "part", "n", text.alias("content"), F.lit(0.6).alias("importance"), F.col("l.id").alias("expired_ids"))


def consolidated_similar(mem: DataFrame, threshold: float = 0.92, max_rows: int | None = None) -> DataFrame:
    """Greedy clusters of at least two similar active memories of a scope, in order of importance.

    The order decides, so a scope is one task's work; its rows come sorted and are compared in blocks of one matrix
    product each, with the heads of clusters alone carried on. ``max_rows`` cuts a scope to its most important
    memories, as a search does; by default all take part. Columns: the scope's key, ids, importance (maximum), content
    (bullets), source_event_ids (all members' once).
    """
    order = [F.desc("importance"), F.desc("valid_from"), F.col("id")]
    act = numbered(mem.filter("state = 'active' and embedding is not null"), SCOPE, order, "r")
    act = act if max_rows is None else act.filter(F.col("r") <= max_rows)
    act = act.select(key_of_scope().alias("scope"), "r", "id", "content", "importance", "source_event_ids", "embedding")
    act = act.join(act.groupBy("scope").count().filter("count > 1").select("scope"), "scope", "left_semi")  # one memory alone is no cluster

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("r"), []
        for _, part in pdf.groupby(pdf.embedding.map(len)):
            x = np.stack(part.embedding.to_list()).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            x, part = x[ok] / norm[ok, None], part[ok]
            for members in greedy(x, threshold):
                if len(members) > 1:
                    c = part.iloc[members]
                    out.append((c.scope.iloc[0], c.id.to_list(), float(c.importance.max()), f"Consolidated {len(c)} memories:\n" + "\n".join("- " + (t or "") for t in c.content), list(dict.fromkeys(e for s in c.source_event_ids if s is not None for e in s))))
        return pd.DataFrame(out, columns=["scope", "ids", "importance", "content", "source_event_ids"])

    return act.groupBy("scope").applyInPandas(cluster, "scope string, ids array<string>, importance double, content string, source_event_ids array<string>")


def greedy(x: np.ndarray, threshold: float, block: int = 1_024) -> list[list[int]]:
    """Clusters of unit vectors: each, in order, joins the first head of at least ``threshold`` or becomes a head; members
    by falling similarity to their head."""
    heads: list[int] = []
    members: dict[int, list[tuple[float, int]]] = {}
    for a in range(0, len(x), block):
        part = x[a : a + block]
        free = np.ones(len(part), bool)
        for h in range(0, len(heads), block):  # the heads so far, in their order
            own = np.array(heads[h : h + block])
            s = part @ x[own].T
            near = s >= threshold
            first = near.argmax(1)
            for i in np.flatnonzero(free & near.any(1)).tolist():
                members[int(own[first[i]])].append((-float(s[i, first[i]]), a + i))
                free[i] = False
        s = part @ part.T
        for i in range(len(part)):
            if free[i]:
                heads.append(a + i)
                free[i] = False
                near = np.flatnonzero(free & (s[i] >= threshold))
                members[a + i] = [(-np.inf, a + i), *((-float(s[i, k]), a + k) for k in near.tolist())]
                free[near] = False
    return [[k for _, k in sorted(members[h])] for h in heads]


def merged_similar(new: DataFrame, current: DataFrame | None = None, threshold: float = 0.92) -> DataFrame:
    """Sequential merge of subject-less memories into each scope, in order of arrival (``seq``).

    A memory whose best active neighbour, among those stored in ``current`` and those added before it, reaches the
    threshold closes it and takes over its subject, importance (maximum) and sources (union). Columns: scope, id,
    outcome (inserted or merged), target, subject, importance, source_event_ids. The order decides, so a scope is one
    task's work, in blocks of one matrix product each against all that is live.
    """
    cols = ["id", "subject", "importance", "source_event_ids", "embedding"]
    rows = new.select(key_of_scope().alias("scope"), F.col("seq"), F.lit(True).alias("fresh"), *[c if c != "subject" else F.lit(None).cast("string").alias(c) for c in cols])
    if current is not None:
        stored = current.filter("state = 'active' and embedding is not null").select(key_of_scope().alias("scope"), F.lit(None).cast(new.schema["seq"].dataType).alias("seq"), F.lit(False).alias("fresh"), *cols)
        rows = stored.join(rows.select("scope").distinct(), "scope", "left_semi").unionByName(rows)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fresh", "seq", "id"])
        ids, fresh = pdf.id.to_list(), pdf.fresh.to_numpy()
        subject, importance = pdf.subject.where(pdf.subject.notna(), None).to_list(), pdf.importance.to_numpy(float).copy()
        sources = [list(s) if s is not None else [] for s in pdf.source_event_ids]
        sizes = np.array([0 if v is None else len(v) for v in pdf.embedding])
        target: dict[int, int] = {}
        for dim in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dim)
            x = np.stack([pdf.embedding.iloc[i] for i in at]).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            live = np.isfinite(norm) & (norm > 0)
            x[live] /= norm[live, None]
            x[~live] = 0
            for a in range(int(np.count_nonzero(~fresh[at])), len(at), 256):
                s = x[a : a + 256] @ x[: a + 256].T
                for i in range(len(s)):
                    if live[a + i]:
                        score = np.where(live[: a + i], s[i, : a + i], -2.0)
                        k = int(score.argmax()) if a + i else -1
                        if k >= 0 and score[k] >= threshold:
                            me, it = int(at[a + i]), int(at[k])
                            live[k], target[me] = False, it
                            importance[me] = max(importance[me], importance[it])
                            subject[me] = subject[it]
                            sources[me] = list(dict.fromkeys([*sources[it], *sources[me]]))
        mine = np.flatnonzero(fresh).tolist()
        return pd.DataFrame([(pdf.scope.iloc[0], ids[i], "merged" if i in target else "inserted", ids[target[i]] if i in target else None, subject[i], float(importance[i]), sources[i]) for i in mine], columns=["scope", "id", "outcome", "target", "subject", "importance", "source_event_ids"])

    return rows.groupBy("scope").applyInPandas(merge, "scope string, id string, outcome string, target string, subject string, importance double, source_event_ids array<string>")


def template(name: Column, fields: Column) -> Column:
    """struct(content, subject, mem_type) of a filled template (preference, person, decision, task); null if a field is missing."""
    f = lambda k: F.trim(F.coalesce(F.get_json_object(fields, f"$.{k}"), F.lit("")))
    row = lambda c, s, t: F.struct(c.alias("content"), s.alias("subject"), F.lit(t).alias("mem_type"))
    person = F.when(f("detail") == "", f("name")).otherwise(F.concat(f("name"), F.lit(" — "), f("detail")))
    return (
        F.when((name == "preference") & (f("subject") != "") & (f("value") != ""), row(F.concat(f("subject"), F.lit(": "), f("value")), f("subject"), "semantic"))
        .when((name == "person") & (f("name") != ""), row(person, f("name"), "semantic"))
        .when((name == "decision") & (f("topic") != "") & (f("decision") != ""), row(F.concat(F.lit("Decision on "), f("topic"), F.lit(": "), f("decision")), f("topic"), "semantic"))
        .when((name == "task") & (f("task") != ""), row(f("task"), f("task"), "procedural"))
    )


def extracted_facts(text: Column) -> Column:
    """array<struct(subject, content)>: the facts of a JSON array of strings or {subject, content}; other text is one fact."""
    kind = "array<struct<subject:string,content:string>>"
    objects = F.from_json(text, kind)
    strings = F.transform(F.from_json(text, "array<string>"), lambda s: F.struct(F.lit(None).cast("string").alias("subject"), s.alias("content")))
    usable = lambda a: F.filter(a, lambda x: F.trim(F.coalesce(x["content"], F.lit(""))) != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("subject"), F.trim(text).alias("content")))
    bracket = F.trim(text).rlike(r"^\[\s*\{")
    plain = F.trim(text).rlike(r'^\[\s*"')
    out = F.when(bracket & (F.size(usable(objects)) > 0), usable(objects)).when(plain & (F.size(usable(strings)) > 0), usable(strings))
    return F.coalesce(out, F.when(F.trim(text) != "", whole).otherwise(F.array().cast(kind)))


def erased(tables: dict[str, DataFrame], tenant: str, user: str | None = None) -> dict[str, DataFrame]:
    """The tables without a tenant's rows, or without one user's memories, grants included; to be written over the old ones."""
    out = {}
    for name, df in tables.items():
        gone = F.col("tenant_id") == tenant
        if user is not None:
            owner = F.col("user_id") == user if "user_id" in df.columns else F.lit(False)
            if name == "memory_grants":
                owner = (F.col("grantee_user_id") == user) | (F.col("grantor_user_id") == user)
            gone = gone & owner
        out[name] = df.filter(~F.coalesce(gone, F.lit(False)))
    return out


def add_grants(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Grants with new ones added; the same grant again changes nothing."""
    key = ["tenant_id", "grantee_user_id", "grantor_user_id"]
    return grants.unionByName(new.dropDuplicates(key).join(grants.select(*key), key, "left_anti").select(*grants.columns))


def revoked(grants: DataFrame, tenant: str, gone: DataFrame) -> DataFrame:
    """Grants without those of ``gone`` (grantee_user_id, grantor_user_id) in a tenant."""
    key = ["grantee_user_id", "grantor_user_id"]
    own = gone.select(F.lit(tenant).alias("tenant_id"), *key).distinct()
    return grants.join(own, ["tenant_id", *key], "left_anti").select(*grants.columns)


def grants_of(grants: DataFrame, tenant: str, user: str | None = None) -> DataFrame:
    """A tenant's grants, or those that one user has received, in the order of their creation."""
    out = grants.filter(F.col("tenant_id") == tenant)
    out = out if user is None else out.filter(F.col("grantee_user_id") == user)
    return out.orderBy(*[c for c in ("created_at",) if c in grants.columns], "grantee_user_id", "grantor_user_id")


def migrated(tables: dict[str, tuple[DataFrame, DataFrame]], tenant: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each (source, destination) after a tenant's rows have moved over; what the destination had of it is replaced."""
    own = F.coalesce(F.col("tenant_id") == tenant, F.lit(False))
    return {name: (a.filter(~own), b.filter(~own).unionByName(a.filter(own))) for name, (a, b) in tables.items()}


def reembed_plan(mem: DataFrame, limit: int) -> DataFrame:
    """The active memories updated longest ago, to be given new vectors."""
    return mem.filter("state = 'active'").orderBy("updated_at", "id").limit(limit)


def embedded_rows(df: DataFrame, text: str, provider, out: str = "embedding", batch: int = 64) -> DataFrame:
    """The rows with vectors from ``provider`` (texts -> vectors), in Arrow batches; a failing batch leaves nulls."""
    schema = df.drop(out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = []
            texts = b.column(text).to_pylist()
            for a in range(0, len(texts), batch):
                part = texts[a : a + batch]
                try:
                    v = [[float(x) for x in y] for y in provider([t or "" for t in part])]
                    vectors += v if len(v) == len(part) else [None] * len(part)
                except Exception:  # noqa: BLE001 - a provider may fail in any way; the rows stay unembedded
                    vectors += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.drop(out).mapInArrow(run, f"{ddl}, `{out}` array<float>")
