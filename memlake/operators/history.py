"""Type-two history of changing attributes.

The updates of all entities are range-sorted by (entity, valid_from). The merge walks them in that order and compares
each update's attribute hash with the entity's current version: equal and without time between, the version goes on;
else it is closed, at its own end or where the update begins, and a new one opens. Blocks do this on their own and
carry the current version across their edges (``memlake.plans.runs``).

A history grows by merges: ``merged_updates`` takes in a batch of updates, late ones too, and rebuilds the entities that
the batch names and no others; ``merged_snapshot`` compares a whole snapshot with the current versions. A full build is
the merge into an empty history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.intervals import OPEN, one_per_id
from memlake.plans.runs import changes, ordered_blocks, rescanned
from memlake.plans.shared import micros, quoted, written


def update_log(df: DataFrame, entity: Column, attributes: list[Column], start: str, end: str, version: str, id: str | None = None) -> DataFrame:
    """(id, entity, s, e, v, h): the updates of a table, their times in microseconds and a hash of their attributes."""
    nulls = F.concat(*[F.when(a.isNull(), "0").otherwise("1") for a in attributes])
    return df.select(
        (F.col(quoted(id)).cast("string") if id else F.lit(None).cast("string")).alias("id"),
        entity.alias("entity"),
        micros(df, start).alias("s"),
        F.coalesce(micros(df, end), F.lit(int(OPEN))).alias("e"),
        F.col(quoted(version)).cast("bigint").alias("v"),
        F.xxhash64(nulls, *attributes).alias("h"),
    )


def version_history(df: DataFrame, entity: Column, attributes: list[Column], start: str, end: str, version: str, id: str | None = None) -> DataFrame:
    """(entity, from_us, to_us, attr_hash): one row for each version of an entity, in half-open periods.

    An update's attributes hold from its start until its end or the entity's next start, whichever is earlier. Of
    updates with one start the highest version counts alone (null lowest; of equals the one with the smallest hash).
    Consecutive updates with equal attributes and no time between them are one version. A null end is open and comes
    out as -1. Null attributes are a value of their own. Rows with a null entity, a null start or an end not after the
    start are ignored. With ``id``, rows of one id count once (the greatest by entity, start, end, version and hash);
    rows without id stand for themselves. An empty table gives no rows; further columns play no part.
    """
    return versions(update_log(df, entity, attributes, start, end, version, id), id is not None)


def merged_updates(history: DataFrame, log: DataFrame, updates: DataFrame, ids: bool = True) -> DataFrame:
    """The history after a batch of ``updates``, as if it had been built from ``log`` and ``updates`` at once.

    ``log`` holds the updates (``update_log``) that ``history`` was built from. The entities that the batch names, and
    those that lose a row to one sent again under its id, are rebuilt from their part of the log; all others pass.
    """
    touched = updates.select("entity")
    if ids:
        touched = touched.unionByName(log.join(updates.select("id"), "id", "left_semi").select("entity"))
    touched = written(touched.where("entity is not null").distinct(), "history-touched")
    redone = versions(log.join(touched, "entity", "left_semi").unionByName(updates), ids)
    return history.join(touched, "entity", "left_anti").unionByName(redone)


def merged_snapshot(history: DataFrame, snapshot: DataFrame, at_us: int, complete: bool = True) -> DataFrame:
    """The history after a snapshot (entity, attr_hash) taken at ``at_us``: where the hash differs from the current
    version's, that one is closed and a new one opens; new entities open; with ``complete``, entities that the snapshot
    lacks are closed. Only current versions meet the snapshot. Of an entity's several rows the smallest hash counts.
    A version that would end at its own start is dropped. Snapshots come in the order of their times.
    """
    now = snapshot.where("entity is not null").groupBy("entity").agg(F.min("attr_hash").alias("new"))
    met = history.where("to_us = -1").join(now, "entity", "full")
    known, seen = F.col("from_us").isNotNull(), F.col("new").isNotNull()
    old = F.struct("from_us", F.when((known & seen & (F.col("attr_hash") != F.col("new"))) | (~seen & F.lit(complete)), F.lit(at_us).cast("bigint")).otherwise(F.lit(-1).cast("bigint")).alias("to_us"), "attr_hash")
    new = F.struct(F.lit(at_us).cast("bigint").alias("from_us"), F.lit(-1).cast("bigint").alias("to_us"), F.col("new").alias("attr_hash"))
    rows = F.array_compact(F.array(F.when(known, old), F.when(seen & (~known | (F.col("attr_hash") != F.col("new"))), new)))
    return history.where("to_us <> -1").unionByName(met.select("entity", F.inline(rows)).where("to_us = -1 or to_us > from_us"))


def versions(log: DataFrame, ids: bool = True) -> DataFrame:
    """The version history of an update log."""
    rows = (one_per_id(log, "id") if ids else log.drop("id")).where("entity is not null and s is not null and e > s")

    def fold(t: pa.Table) -> tuple[dict, pa.Table]:
        t = t.filter(pa.array(changes(t, ["entity", "s"])))
        new, s, e, h = changes(t, ["entity"]), t.column("s").to_numpy(), t.column("e").to_numpy().copy(), t.column("h").to_numpy()
        e[:-1] = np.where(new[1:], e[:-1], np.minimum(e[:-1], s[1:]))
        opens = new.copy()
        opens[1:] |= (h[1:] != h[:-1]) | (e[:-1] != s[1:])
        first = np.flatnonzero(opens)
        end = e[np.append(first[1:], len(s)) - 1]
        names = t.column("entity").take(pa.array(first))
        head = {"k0": names[0].as_py(), "s0": int(s[0]), "h0": int(h[0]), "k1": names[-1].as_py(), "s1": int(s[first[-1]]), "e1": int(end[-1]), "h1": int(h[-1]), "one": int(len(first) == 1)}
        return head, pa.table({"entity": names, "s": s[first], "e": end, "h": h[first]})

    def carry(heads: list) -> list:
        """The current version carried into each block, and how its last one is closed or goes on."""
        out, start = [], 0
        for i, h in enumerate(heads):
            p, q = heads[i - 1] if i else None, heads[i + 1] if i + 1 < len(heads) else None
            joins = bool(p and p.k1 == h.k0 and p.h1 == h.h0 and min(p.e1, h.s0) == h.s0)
            out.append({"start": start if joins else None, "until": q.s0 if q and q.k0 == h.k1 else None, "open": bool(q and q.k0 == h.k1 and q.h0 == h.h1 and min(h.e1, q.s0) == q.s0)})
            start = start if joins and h.one else h.s1
        return out

    def emit(runs: pa.Table, c: dict) -> pa.Table:
        s, e = runs.column("s").to_numpy().copy(), runs.column("e").to_numpy().copy()
        if c["start"] is not None:
            s[0] = c["start"]
        if c["until"] is not None:
            e[-1] = min(e[-1], c["until"])
        out = pa.table({"entity": runs.column("entity"), "from_us": s, "to_us": np.where(e == OPEN, -1, e), "attr_hash": runs.column("h")})
        return out.slice(0, out.num_rows - c["open"])

    blocks = ordered_blocks(
        rows,
        ["entity", "s"],
        [F.col("entity"), F.col("s"), F.col("v").desc_nulls_last(), F.col("h"), F.col("e")],
        fold,
        "k0 string, s0 bigint, h0 bigint, k1 string, s1 bigint, e1 bigint, h1 bigint, one int",
        log.count(),
        "history",
    )
    return rescanned(blocks, carry, emit, "entity string, from_us bigint, to_us bigint, attr_hash bigint")
