"""Continuous periods and gaps of overlapping intervals.

The rows are globally range-sorted by entity and start. Every block merges its own intervals to local islands and
reports the last one (its maximum end); the prefix combination of these summaries gives each block the island carried
into it, and the rescan merges, labels and emits (``memlake.plans.runs``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.runs import changes, ordered_blocks, rescanned
from memlake.plans.shared import collapsed, micros, quoted

#: Stands for an open end while periods are compared; comes out as -1.
OPEN = np.iinfo(np.int64).max


def subject_entity(tenant: str = "tenant_id", user: str = "user_id", subject: str = "subject") -> Column:
    """``tenant|user|subject``: a null tenant or user is empty, the subject is collapsed; null for a null or blank subject."""
    s = collapsed(F.col(quoted(subject)).cast("string"))
    part = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    return F.when(s != "", F.concat_ws("|", part(tenant), part(user), s))


def one_per_id(df: DataFrame, id: str) -> DataFrame:
    """Rows of one ``id`` once: the greatest by all other columns in order. Rows without id: equal rows once."""
    rest = [c for c in df.columns if c != id]
    whole = F.struct(*[F.col(quoted(c)) for c in rest])
    key = F.when(F.col(quoted(id)).isNull(), F.concat(F.lit("\0"), F.sha2(F.to_json(whole), 256))).otherwise(F.concat(F.lit("\1"), F.col(quoted(id))))
    return df.groupBy(key.alias("__id")).agg(F.max(whole).alias("__row")).select("__row.*")


def union_ends(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows, starts and ends of the islands of intervals sorted by key number and start; touching ones merge."""
    # the running maximum end of each key: ends go by rank, and a later key's ranks lie above all earlier ones
    order = np.argsort(end, kind="stable")
    rank = np.empty(len(end), np.int64)
    rank[order] = np.arange(len(end))
    base = (np.cumsum(key) - 1) * len(end)
    top = end[order[np.maximum.accumulate(base + rank) - base]] if len(end) else end
    opens = key.copy()
    opens[1:] |= start[1:] > top[:-1]
    first = np.flatnonzero(opens)
    return first, start[first], top[np.append(first[1:], len(key)) - 1]


def periods_and_gaps(df: DataFrame, entity: Column, start: str, end: str, id: str | None = None) -> DataFrame:
    """(entity, kind, from_us, to_us): a ``period`` for each continuous period and a ``gap`` between two of an entity.

    Periods are half-open; those that overlap or touch are one. A null end is open and comes out as -1. Rows with a
    null entity, a null start or an end not after the start are ignored. With ``id``, rows of one id count once (the
    greatest by entity, start and end, if they differ); rows without id stand for themselves. Equal periods merge, an
    empty table gives no rows, further columns play no part.
    """
    rows = df.select(
        *([F.col(quoted(id)).cast("string").alias("id")] if id else []),
        entity.alias("entity"),
        micros(df, start).alias("s"),
        F.coalesce(micros(df, end), F.lit(int(OPEN))).alias("e"),
    )
    rows = (one_per_id(rows, "id") if id else rows).where("entity is not null and s is not null and e > s")

    def fold(t: pa.Table) -> tuple[dict, pa.Table]:
        first, s, e = union_ends(changes(t, ["entity"]), t.column("s").to_numpy(), t.column("e").to_numpy())
        names = t.column("entity").take(pa.array(first))
        return {"k0": names[0].as_py(), "k1": names[-1].as_py(), "s1": int(s[-1]), "e1": int(e[-1])}, pa.table({"entity": names, "s": s, "e": e})

    def carry(heads: list) -> list:
        """The island that is current where each block begins; the block's first entity may go on with it."""
        out, state = [], None
        for h in heads:
            mine = state if state and state[0] == h.k0 else None
            out.append({"in": mine, "out": True})
            if mine and h.k1 == h.k0 and h.s1 <= mine[2]:
                state = (h.k1, mine[1], max(mine[2], h.e1))
            else:
                state = (h.k1, h.s1, h.e1)
        return _with_ends(heads, out)

    def _with_ends(heads: list, out: list) -> list:
        """Whether the block's last island goes on in the next block: only the starts there can tell, so the next block emits it."""
        for a, (h, g) in enumerate(zip(heads[:-1], heads[1:], strict=True)):
            out[a]["out"] = g.k0 != h.k1
        return out

    def emit(runs: pa.Table, c: dict) -> pa.Table:
        names, s, e = runs.column("entity").combine_chunks(), runs.column("s").to_numpy(), runs.column("e").to_numpy()
        if c["in"]:
            names = pa.concat_arrays([pa.array([c["in"][0]], pa.string()), names])
            s, e = np.append(c["in"][1], s), np.append(c["in"][2], e)
            first, s, e = union_ends(changes(pa.table({"entity": names}), ["entity"]), s, e)
            names = names.take(pa.array(first))
        new = changes(pa.table({"entity": names}), ["entity"])
        after = np.flatnonzero(~new)
        stay = len(s) - (not c["out"])
        shown = np.where(e[:stay] == OPEN, -1, e[:stay])
        return pa.table(
            {
                "entity": pa.concat_arrays([names.slice(0, stay), names.take(pa.array(after))]),
                "kind": pa.array(["period"] * stay + ["gap"] * len(after), pa.string()),
                "from_us": np.concatenate([s[:stay], e[after - 1]]),
                "to_us": np.concatenate([shown, s[after]]),
            }
        )

    blocks = ordered_blocks(
        rows, ["entity", "s"], [F.col("entity"), F.col("s"), F.col("e")], fold, "k0 string, k1 string, s1 bigint, e1 bigint", df.count(), "periods"
    )
    return rescanned(blocks, carry, emit, "entity string, kind string, from_us bigint, to_us bigint")
