"""An engine in one object: open, remember, add, recall, all, flush, over Parquet logs in one folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import memory as m
from memlake.operators.retrieval import memory_search
from memlake.plans.shared import written

SCHEMA = (
    "id string, tenant_id string, user_id string, agent_id string, session_id string, subject string, content string, importance double, "
    "valid_from timestamp, valid_to timestamp, state string, supersedes string, source_event_ids array<string>, version bigint, "
    "created_at timestamp, updated_at timestamp, metadata string, mem_type string, embedding array<float>"
)


class Embedded:
    """Memories of one scope. Additions wait in memory and reach the log by ``flush``, or before the next read."""

    def __init__(self, spark: SparkSession, folder: str, scope: m.Scope, provider: Callable | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.scope, self.provider, self.clock = spark, f"{folder}/memories", scope, provider, clock
        self.waiting: list[tuple[str | None, str, float, float]] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, tenant: str = "default", user: str | None = None, **more) -> "Embedded":
        return cls(spark, folder, m.Scope(tenant, user), **more)

    def _log(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def add(self, content: str, subject: str | None = None, importance: float = 0.5) -> None:
        self.waiting.append((subject, content, importance, self.clock()))

    def remember(self, text: str) -> int:
        """Adds the facts of a text; returns how many."""
        facts = self.spark.range(1).select(m.extracted_facts(F.lit(text)).alias("f")).first().f
        for f in facts:
            self.add(f.content, f.subject)
        return len(facts)

    def flush(self) -> None:
        """Applies what waits as one batch, in order: equal statements confirm, others supersede. One file for each flush."""
        if not self.waiting:
            return
        batch = [(str(uuid.uuid4()), i, subject, content, float(importance), at) for i, (subject, content, importance, at) in enumerate(self.waiting)]
        new = self.spark.createDataFrame(batch, "id string, seq int, subject string, content string, importance double, at double").select(
            "id", *[F.lit(getattr(self.scope, c)).cast("string").alias(c) for c in m.SCOPE], "subject", "content", "importance", F.array().cast("array<string>").alias("source_event_ids"),
            F.lit("{}").alias("metadata"), F.lit("semantic").alias("mem_type"), F.lit(None).cast("array<float>").alias("embedding"), F.timestamp_seconds("at").alias("at"), "seq",
        )
        new = m.embedded_rows(new, "content", self.provider) if self.provider else new
        current = m.latest(self._log())
        rows = written(m.applied(current, m.additions(current, new)), "flush")
        rows.coalesce(1).write.mode("append").parquet(self.path)
        self.waiting.clear()

    def recall(self, query: str, k: int = 5) -> DataFrame:
        self.flush()
        mem = m.latest(self._log()).withColumn("updated_us", F.unix_micros("updated_at"))
        vector = [float(x) for x in self.provider([query])[0]] if self.provider else None
        return memory_search(mem, self.scope.predicate(), query, k, int(self.clock() * 1e6), vector)

    def all(self) -> DataFrame:
        self.flush()
        return m.latest(self._log()).filter(self.scope.predicate() & (F.col("state") == "active")).orderBy(F.desc("importance"), F.desc("valid_from"), "id")
