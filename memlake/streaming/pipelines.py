"""Structured Streaming versions: idempotent ingest, change streams, sessions by timers, windows, state, triggers.

The batch operators need no watermark; here late data are defined: what comes later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.joins import wildcard_match
from memlake.operators.sessions import session_timers  # noqa: F401 - one of the streaming verbs


def table_stream(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """A growing Parquet table as a stream of its new files."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(folder)


def idempotent(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of one idempotency key once within the watermark; events without key all pass, whatever their id."""
    keyed = events.filter("idempotency_key is not null").withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["idempotency_key"]).unionByName(events.filter("idempotency_key is null").withWatermark("ts", delay))


def windowed_counts(events: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """(from_us, event_type, n) in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("from_us"), "event_type", "n")


def change_stream(memory_log: DataFrame, state_log: DataFrame) -> DataFrame:
    """(stream, event, key, tenant_id, row) of memory and state changes together."""
    m = memory_log.select(
        F.lit("memory").alias("stream"),
        F.when(F.col("state") == "active", "upserted").otherwise(F.col("state")).alias("event"),
        F.col("id").alias("key"),
        "tenant_id",
        F.to_json(F.struct("*")).alias("row"),
    )
    s = state_log.select(F.lit("state").alias("stream"), F.when(F.col("op") == "delete", "delete").otherwise("set").alias("event"), F.concat_ws("/", "agent_id", "key").alias("key"), "tenant_id", F.to_json(F.struct("*")).alias("row"))
    return m.unionByName(s)


def watch(changes: DataFrame, tenant: str, stream: str | None = None, agent: str | None = None) -> DataFrame:
    """The changes that one watcher may see."""
    out = changes.filter(F.col("tenant_id") == tenant)
    out = out if stream is None else out.filter(F.col("stream") == stream)
    return out if agent is None else out.filter(F.col("key").startswith(agent + "/"))


def triggered(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each event with every trigger of its tenant whose source and type are ``*`` or equal (stream-static joins)."""
    return wildcard_match(events, triggers.withColumnRenamed("tenant_id", "t"), {"match_source": "source", "match_type": "event_type"}).filter(F.col("t") == F.col("tenant_id")).drop("t")


def stored_state(log: DataFrame) -> DataFrame:
    """(agent_id, key, value, version, applied) after each micro-batch of a state log with set, delete and cas operations."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, value = state.get if state.exists else (0, None)
        applied = 0
        for r in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
            if r.op == "delete":
                version, value = 0, None
            elif r.op != "cas" or (not pd.isna(r.expected) and int(r.expected) == version):
                version, value, applied = version + 1, r.value, applied + 1
        state.update((version, value))
        yield pd.DataFrame([(*k, value, version, applied)], columns=["agent_id", "key", "value", "version", "applied"])

    return log.groupBy("agent_id", "key").applyInPandasWithState(
        step, "agent_id string, key string, value string, version bigint, applied bigint", "version bigint, value string", "update", GroupStateTimeout.NoTimeout
    )


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Works off all that a stream has now, micro-batch by micro-batch, and returns; the checkpoint resumes it."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch once, under its number, so a repeated batch replaces itself."""

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return each


def reindex(events: DataFrame, provider, path: str, checkpoint: str) -> None:
    """Embeds the stream's events that are not embedded yet and appends their vectors."""
    from memlake.operators.memory import embedded_rows
    from memlake.sources.ingest import with_embedding_text

    def each(df: DataFrame, batch: int) -> None:
        todo = with_embedding_text(df.filter("embedded is not true"))
        embedded_rows(todo, "text", provider).filter("embedding is not null").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run_available(events, checkpoint, each)


def watched_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of the Markdown notes of a folder as they appear or change: each new state of a file once."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).schema("value string")
    return files.load(folder).select(F.col("_metadata.file_path").alias("path"), "value")


def periodic(name: str, seconds: float, work: Callable[[int], None], spark: SparkSession, checkpoint: str):
    """A loop that calls ``work`` with the number of its round every so many seconds; the query that runs it is returned.

    Retention, reindexing, decay and triggers run in it. A round that fails ends the query, whose checkpoint goes on
    with the next one when it is started again."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, n: work(n)).start()
