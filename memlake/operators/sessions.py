"""Sessions by inactivity: keyed streaming timers.

Each key has one timer in Spark's state store. An event opens a session (start, end, count) or, before the timer's
deadline, adds to it; either way it resets the deadline to its own time plus the gap. An event after the deadline finds
the timer expired: the session is final and a new one opens. What no later event closes is closed by the timer itself,
when the watermark passes the deadline. ``session_timers`` runs on a live stream, where events up to the watermark's
delay late are put in order first; ``sessionize`` replays a finished table through the same timers.

A hot key is replayed in slices of its time, each with a timer of its own, so that it spreads over many tasks; only the
first and last session of a slice can go on beyond it, and these few rows are joined up afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.plans.shared import blank_trimmed, freed_shuffles, micros, quoted, row_hashes, shared_dir

GAP_US = 30 * 60 * 1_000_000
#: Events of one timer in a replay, about and at least; with more than MAX_GROUPS times as many rows they grow, so that
#: the bounds of the hot keys' slices, which every task gets, stay few. Buckets of time for each of them.
GROUP_ROWS, MAX_GROUPS, BUCKETS_EACH = 100_000, 100_000, 4
#: An open session, whether it is its timer's first, and the events still too young to be put in order.
STATE = "start bigint, end bigint, n bigint, first boolean, at array<bigint>, h1 array<bigint>, h2 array<bigint>"
FIRED = "identity string, slice int, start_us bigint, end_us bigint, n_entries bigint, edge boolean"


def fire_timers(opened: tuple[int, int, int] | None, at: np.ndarray, gap_us: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int] | None]:
    """The sessions (start, end, count) that ordered event times close, and the one that they leave open."""
    if not len(at):
        return [], opened
    expired = np.flatnonzero(at[1:] - at[:-1] > gap_us) + 1
    first, last = np.append(0, expired), np.append(expired, len(at)) - 1
    out = list(zip(at[first].tolist(), at[last].tolist(), (last - first + 1).tolist(), strict=True))
    if opened is not None:
        if at[0] <= opened[1] + gap_us:
            out[0] = (opened[0], out[0][1], opened[2] + out[0][2])
        else:
            out.insert(0, opened)
    return out[:-1], out[-1]


def fired(key: tuple, rows: list[tuple[int, int, int, bool]]) -> pd.DataFrame:
    start, end, n, edge = zip(*rows, strict=True)
    return pd.DataFrame({"identity": [key[0]] * len(rows), "slice": np.full(len(rows), key[1], np.int32), "start_us": start, "end_us": end, "n_entries": n, "edge": edge})


def timer(gap_us: int, whole: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state function of one timer. ``whole``: all of a key's events come in one micro-batch, none has to wait."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, first, *held = state.get if state.exists else (None, None, None, True, [], [], [])
        parts = [*([held] if held[0] else []), *([p["at"].to_numpy(), p["h1"].to_numpy(), p["h2"].to_numpy()] for p in batches if len(p))]
        mark = state.getCurrentWatermarkMs() * 1000
        if key[0] == "":
            return
        if not parts and end + gap_us <= mark:  # the timer itself fires: nothing came after the session's last event
            state.remove()
            yield fired(key, [(start, end, n, True)])
            return
        parts = parts or [([], [], [])]
        at, h1, h2 = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(3))
        order = np.lexsort((h2, h1, at))
        at, h1, h2 = at[order], h1[order], h2[order]
        new = np.ones(len(at), bool)  # rows equal in all columns count once
        new[1:] = (at[1:] != at[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at, h1, h2 = at[new], h1[new], h2[new]
        ripe = len(at) if whole else int(np.searchsorted(at, mark, side="right"))
        done, opened = fire_timers(None if start is None else (start, end, n), at[:ripe], gap_us)
        young = [x[ripe:].tolist() for x in (at, h1, h2)]
        rows = [(*x, first and i == 0) for i, x in enumerate(done)]
        if opened is not None and opened[1] + gap_us <= mark:
            rows.append((*opened, True))
            opened = None
        first = first and not rows
        if opened is not None or young[0]:
            state.update((*(opened or (None, None, None)), first, *young))
            deadline = (young[0][-1] if young[0] else opened[1]) + gap_us
            state.setTimeoutTimestamp(max(-(-deadline // 1000), mark // 1000, 0) + 1)
        elif state.exists:
            state.remove()
        if rows:
            yield fired(key, rows)

    return step


def _events(df: DataFrame, key: str, time: str, normalise: bool) -> DataFrame:
    k = F.col(quoted(key)).cast("string")
    h1, h2 = row_hashes(df, df.columns)
    out = df.select((F.lower(blank_trimmed(k)) if normalise else k).alias("identity"), micros(df, time).alias("at"), h1.alias("h1"), h2.alias("h2"))
    return out.where("identity <> '' and at is not null")


def session_timers(entries: DataFrame, key: str, time: str, gap_us: int = GAP_US, delay: str = "10 minutes", normalise: bool = True) -> DataFrame:
    """(identity, start_us, end_us, n_entries) of a live stream, each session once it is final.

    As ``sessionize``, but an entry later than the watermark's delay, or of 1970 or before, is dropped. A key's state is
    its open session and the entries younger than the watermark.
    """
    marked = _events(entries, key, time, normalise).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", delay)
    timers = marked.withColumn("slice", F.lit(-1)).groupBy("identity", "slice").applyInPandasWithState(timer(gap_us, False), FIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return timers.drop("slice", "edge")


def _slices(events: DataFrame, counts: DataFrame, total: int, least: int, most: int, group_rows: int) -> DataFrame:
    """(identity, bounds) of the hot keys: the times at which each one's next slice begins."""
    rows_each = max(group_rows, total // MAX_GROUPS)
    bucket = max(1, (most - least) * rows_each // (BUCKETS_EACH * total))
    hot = counts.where(F.col("n") > rows_each).select("identity")  # fewer than MAX_GROUPS rows
    w = Window.partitionBy("identity").orderBy("b")
    seen = events.join(F.broadcast(hot), "identity").groupBy("identity", F.floor((F.col("at") - least) / bucket).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    slices = seen.withColumn("s", F.floor((F.sum("c").over(w) - F.col("c")) / rows_each))
    first = slices.groupBy("identity", "s").agg((F.min("b") * bucket + least).alias("at"))
    return first.groupBy("identity").agg(F.sort_array(F.collect_list("at")).alias("bounds"))  # all keys' together: at most 2 * MAX_GROUPS


def sessionize(df: DataFrame, key: str, time: str, gap_us: int = GAP_US, normalise: bool = True, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each session: (identity, start_us, end_us, n_entries).

    Rows equal in all columns of ``df`` count once. The key is trimmed of spaces and tabs and lower-cased (unless
    ``normalise`` is off). An event more than ``gap_us`` after its key's previous one opens a session; exactly
    ``gap_us`` does not. Rows with a null or blank key, or without a time, are ignored; events at one instant belong to
    one session and each counts; an empty table gives no rows; further columns only take part in telling rows apart.
    The replay is a streaming query that ends when all is worked off; no row is ever late.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/memlake-sessions-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        kinds = "identity string, at bigint, h1 bigint, h2 bigint"
        _events(df, key, time, normalise).write.parquet(f"{base}/events")
        events = spark.read.schema(kinds).parquet(f"{base}/events")
        events.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"), F.max("at").alias("most")).write.parquet(f"{base}/keys")
        counts = spark.read.schema("identity string, n bigint, least bigint, most bigint").parquet(f"{base}/keys")
        all_ = counts.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("n").alias("top")).first()
        if not all_.n:
            return spark.createDataFrame([], FIRED).drop("slice", "edge")
        place: Column = F.lit(-1)
        entries = spark.readStream.schema(kinds).parquet(f"{base}/events")
        if all_.top > max(group_rows, all_.n // MAX_GROUPS):
            _slices(events, counts, all_.n, all_.least, all_.most, group_rows).write.parquet(f"{base}/slices")
            bounds = spark.read.schema("identity string, bounds array<bigint>").parquet(f"{base}/slices")
            entries = entries.join(F.broadcast(bounds), "identity", "left")
            place = F.when(F.col("bounds").isNull(), -1).otherwise(F.size(F.filter("bounds", lambda b: b <= F.col("at"))))
        # an event of nobody's, later than all deadlines, lets the watermark pass them
        over = spark.createDataFrame([("", all_.most + gap_us + 10_000_000, 0, 0)], kinds)
        over.coalesce(1).write.mode("append").parquet(f"{base}/events")
        zero = all_.least - 1_000_000  # a watermark begins at 1970: times are counted from the first one
        marked = entries.select("identity", place.alias("slice"), (F.col("at") - zero).alias("at"), "h1", "h2").withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "0 seconds")
        fired = marked.groupBy("identity", "slice").applyInPandasWithState(timer(gap_us, True), FIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        run = fired.writeStream.format("parquet").option("path", f"{base}/fired").option("checkpointLocation", f"{base}/timers").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.schema(FIRED).parquet(f"{base}/fired")
    out = out.select("identity", "slice", *[(F.col(c) + zero).alias(c) for c in ("start_us", "end_us")], "n_entries", "edge")
    w = Window.partitionBy("identity").orderBy("start_us")
    edges = out.where("slice >= 0 and edge").withColumn("opens", F.coalesce(F.col("start_us") - F.lag("end_us").over(w) > gap_us, F.lit(True)).cast("int"))
    joined = edges.withColumn("session", F.sum("opens").over(w)).groupBy("identity", "session").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_entries").alias("n_entries"))
    return out.where("slice < 0 or not edge").drop("slice", "edge").unionByName(joined.drop("session"))
