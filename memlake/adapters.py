"""The engine in the shape that prompt frameworks expect of a store of texts; none of them is imported."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import embed_prefixes
from memlake.operators.memory import embedded_rows
from memlake.operators.vector import embed_and_search, upsert

SCHEMA = "id string, tenant_id string, content string, metadata string, embedding array<float>"


class TextStore:
    """add_texts, similarity_search, similarity_search_with_score, delete and query over one table of texts and vectors."""

    def __init__(self, spark: SparkSession, folder: str, provider: Callable[[list[str]], list[list[float]]], tenant: str = "default", model: str = ""):
        self.spark, self.folder, self.provider, self.tenant, self.model = spark, folder, provider, tenant, model

    def _table(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        log = self.spark.read.schema(f"{SCHEMA}, batch bigint").parquet(self.folder) if there else self.spark.createDataFrame([], f"{SCHEMA}, batch bigint")
        rest = [c for c in log.columns if c != "id"]
        now = log.groupBy("id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("id", "r.*")
        return now.filter((F.col("tenant_id") == self.tenant) & F.col("content").isNotNull())

    def _append(self, rows: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        last = self.spark.read.parquet(self.folder).agg(F.max("batch").alias("b")).first().b if there else 0
        rows.withColumn("batch", F.lit((last or 0) + 1).cast("bigint")).write.mode("append").parquet(self.folder)

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list[str] | None = None) -> list[str]:
        ids = ids or [str(uuid.uuid4()) for _ in texts]
        rows = [(i, self.tenant, t, json.dumps(m)) for i, t, m in zip(ids, texts, metadatas or [{}] * len(texts), strict=True)]
        prefix = embed_prefixes(self.model)[1]
        new = self.spark.createDataFrame(rows, "id string, tenant_id string, content string, metadata string")
        own = upsert(new.limit(0), new)
        self._append(embedded_rows(own.withColumn("document", F.concat(F.lit(prefix), F.col("content"))), "document", self.provider).drop("document"))
        return ids

    def delete(self, ids: list[str]) -> None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("content", "string"), ("metadata", "string"), ("embedding", "array<float>"))]
        self._append(self.spark.createDataFrame([(i, self.tenant) for i in ids], "id string, tenant_id string").select("id", "tenant_id", *none))

    def similarity_search_with_score(self, query: str, k: int = 4) -> list[tuple[str, dict, float]]:
        """(text, metadata, score) of the k nearest texts."""
        found = embed_and_search(self._table(), query, self.provider, k, self.model).collect()  # k rows
        return [(r.content, json.loads(r.metadata or "{}"), r.score) for r in found]

    def similarity_search(self, query: str, k: int = 4) -> list[tuple[str, dict]]:
        return [(t, m) for t, m, _ in self.similarity_search_with_score(query, k)]

    def query(self, query: str, k: int = 4) -> DataFrame:
        """The k nearest rows with their score, lazily."""
        return embed_and_search(self._table(), query, self.provider, k, self.model)


def completed(df: DataFrame, prompt: str, complete: Callable[[list[str]], list[str]], out: str = "answer", batch: int = 16) -> DataFrame:
    """``df`` with a completion model's answer to the column ``prompt``, in Arrow batches; a failing batch leaves nulls.
    ``operators.memory.extracted_facts`` reads facts from answers, ``operators.graph.triple_lines`` triples."""
    import pyarrow as pa

    schema = df.drop(out).schema

    def run(batches):
        for b in batches:
            texts, answers = b.column(prompt).to_pylist(), []
            for a in range(0, len(texts), batch):
                part = texts[a : a + batch]
                try:
                    got = [None if x is None else str(x) for x in complete([t or "" for t in part])]
                    answers += got if len(got) == len(part) else [None] * len(part)
                except Exception:  # noqa: BLE001 - a model may fail in any way; the rows stay without answer
                    answers += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.drop(out).mapInArrow(run, f"{ddl}, `{out}` string")
