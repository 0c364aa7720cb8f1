"""Exact vector search: top-k by cosine, L2 or inner product, filtered, scoped, by modality, and in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from memlake.functions.scalars import cosine, dot
from memlake.functions.text import embed_prefixes, normalize_key

#: Questions of one pass over a cache; rows of it multiplied at a time.
QUESTION_BLOCK, CACHE_ROWS = 4_096, 2_048


def vector_literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def score(embedding: Column, query: Column, metric: str = "cosine") -> Column:
    """Higher is nearer: cosine, inner product (``ip``) or negative squared distance (``l2``)."""
    if metric == "cosine":
        return cosine(embedding, query)
    if metric == "ip":
        return F.when(F.size(embedding) == F.size(query), dot(embedding, query))
    if metric == "l2":
        return F.when(F.size(embedding) == F.size(query), -F.aggregate(F.zip_with(embedding, query, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"unknown metric {metric}")


def knn(df: DataFrame, query: list[float], k: int, id: str = "id", embedding: str = "embedding", where: Column | None = None, min_score: float | None = None, metric: str = "cosine") -> DataFrame:
    """The k nearest rows to one query vector, ties by id. The filter comes before the ranking, so k rows are found if
    they exist; vectors of another length never match; ``min_score`` cuts after the k are chosen."""
    src = df if where is None else df.filter(where)
    ranked = src.withColumn("score", score(F.col(embedding), vector_literal(query), metric)).filter("score is not null").orderBy(F.desc("score"), id).limit(k)
    return ranked if min_score is None else ranked.filter(F.col("score") >= min_score)


def knn_by_scope(df: DataFrame, query: list[float], k: int, scope: list[str], id: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows within every scope."""
    w = Window.partitionBy(*scope).orderBy(F.desc("score"), id)
    scored = df.withColumn("score", cosine(F.col(embedding), vector_literal(query))).filter("score is not null")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_modal(df: DataFrame, query: list[float], k: int, modality: str | None = None) -> DataFrame:
    """k nearest entries of one modality, or of every modality whose dimension fits, merged by score."""
    return knn(df, query, k, where=None if modality is None else F.col("modality") == modality)


def knn_batch(df: DataFrame, queries: list[tuple[object, list[float]]], k: int, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(query, id, score): the k nearest rows to each of a stated set of query vectors, in one pass over the table.

    Every task multiplies its batches with all queries and keeps k rows for each; one window merges the partial lists.
    """
    qid = [q for q, _ in queries]
    m = np.array([v for _, v in queries], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    dim = m.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_s, best_i = [np.zeros(0)] * len(qid), [[] for _ in qid]
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column("v")), dim))
            if not b.num_rows:
                continue
            x = pc.list_flatten(b.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            ids = b.column("id").filter(pa.array(ok)).to_pylist()
            s = (x[ok] / norm[ok, None]) @ m.T
            for q in range(len(qid)):
                top = np.argpartition(-s[:, q], min(k, len(ids)) - 1)[: k] if len(ids) else []
                cand = [(-float(s[i, q]), ids[i]) for i in np.flatnonzero(s[:, q] >= s[top, q].min())] if len(ids) else []
                cand += [(-float(z), i) for z, i in zip(best_s[q], best_i[q], strict=True)]
                cand.sort()
                best_s[q], best_i[q] = np.array([-z for z, _ in cand[:k]]), [i for _, i in cand[:k]]
        for q, key in enumerate(qid):
            if best_i[q]:
                yield pa.RecordBatch.from_pydict({"query": pa.array([str(key)] * len(best_i[q])), "id": pa.array(best_i[q], kind), "score": best_s[q]})

    spark_kind = df.schema[id].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[spark_kind]
    src = df.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter("v is not null and id is not null")
    merged = src.mapInArrow(partial, f"query string, id {spark_kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def check_dimension(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """The rows, failing at run time where a vector has another length than the index."""
    c = F.col(embedding)
    return df.withColumn(embedding, F.when(F.size(c) == dim, c).otherwise(F.raise_error(F.concat(F.lit(f"vector has another dimension than {dim}: "), F.size(c).cast("string"))).cast(df.schema[embedding].dataType)))


def upsert(current: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """The table after replacing and adding the rows of ``new`` by id (the last of repeated ids by all columns)."""
    rest = [c for c in new.columns if c != id]
    once = new.groupBy(id).agg(F.max(F.struct(*rest)).alias("r")).select(id, "r.*").select(*new.columns)
    return current.join(once.select(id), id, "left_anti").unionByName(once)


def delete(current: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return current.join(ids.select(id), id, "left_anti")


def modal_upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """The entries (id, modality, embedding, ..) after replacing and adding those of ``new`` by (modality, id). A modality's
    length is that of its stored vectors, else of the smallest new id's; vectors of another length fail at run time."""
    dims = current.groupBy("modality").agg(F.max(F.size("embedding")).alias("__old"))
    first = new.groupBy("modality").agg(F.min_by(F.size("embedding"), "id").alias("__first"))
    own = new.join(first, "modality", "left").join(dims, "modality", "left").withColumn("__dim", F.coalesce("__old", "__first"))
    wrong = F.raise_error(F.concat(F.lit("vector has another dimension than "), F.col("__dim").cast("string"), F.lit(": "), F.size("embedding").cast("string")))
    fit = own.withColumn("embedding", F.when(F.size("embedding") == F.col("__dim"), F.col("embedding")).otherwise(wrong.cast(new.schema["embedding"].dataType))).select(*new.columns)
    rest = [c for c in new.columns if c not in ("id", "modality")]
    once = fit.groupBy("modality", "id").agg(F.max(F.struct(*rest)).alias("r")).select("modality", "id", "r.*").select(*new.columns)
    return current.join(once.select("modality", "id"), ["modality", "id"], "left_anti").select(*current.columns).unionByName(once)


def entries(df: DataFrame, limit: int, id: str = "id") -> DataFrame:
    """Up to ``limit`` entries; by id, so that the answer is always the same."""
    return df.orderBy(id).limit(limit)


def save_index(df: DataFrame, folder: str) -> None:
    """The entries as a table in ``folder``; a reader sees the former table or this one, never half of it."""
    stage = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(stage)
    df.sparkSession.createDataFrame([(stage,)], "at string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """The entries that were saved last."""
    return spark.read.parquet(spark.read.text(f"{folder}/current").first().value)


def embed_and_search(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], k: int, model: str = "", where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The k nearest entries to a question: it gets its model's prefix for queries and goes through the provider."""
    query = embed_prefixes(model)[0] + text
    return knn(df, [float(x) for x in provider([query])[0]], k, where=where, min_score=min_score)


def joined_hits(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Every event with every one of the k hits of a search (columns hit_id, hit_score): the join of a search table on
    true. The hits are the k rows of a top-k, so they are sent to all tasks."""
    few = hits.select(F.col("id").alias("hit_id"), F.col("score").alias("hit_score"))
    return events.join(F.broadcast(few), F.lit(True))


def image_histogram(pixels: list[tuple[int, int, int]], buckets: int = 16) -> list[float]:
    """RGB histogram of ``buckets`` bins per channel, normalised to length 1."""
    p = np.asarray(pixels, np.int64).reshape(-1, 3)
    h = np.concatenate([np.bincount(np.minimum(p[:, c] * buckets // 256, buckets - 1), minlength=buckets) for c in range(3)]).astype(np.float64)
    n = np.sqrt((h * h).sum())
    return (h / n if n else h).tolist()


def decode_ppm(data: bytes) -> list[tuple[int, int, int]]:
    """Pixels of a binary PPM (P6) image, the one image format read without a further library."""
    parts = data.split(maxsplit=4)
    if len(parts) < 5 or parts[0] != b"P6":
        raise ValueError("not a P6 image")
    head = len(data) - len(parts[4])
    raw = data[head : head + 3 * int(parts[1]) * int(parts[2])]
    return [tuple(raw[i : i + 3]) for i in range(0, len(raw), 3)]


def embed_images(files: DataFrame, decode=decode_ppm) -> DataFrame:
    """(path, embedding) of a ``binaryFile`` DataFrame; unreadable images have a null embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("content").to_pylist():
                try:
                    out.append(image_histogram(decode(x)))
                except (ValueError, TypeError, IndexError, AttributeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.list_(pa.float32()))], names=["path", "embedding"])

    return files.select("path", "content").mapInArrow(run, "path string, embedding array<float>")


def cached_answers(cache: DataFrame, questions: DataFrame, now_us: int, ttl_us: int, least: float = 0.95) -> DataFrame:
    """Answers of earlier questions: by exact normalised key within a scope, else by the nearest vector of at least ``least``.

    ``cache`` has scope, query, response, embedding, stored_us; ``questions`` qid, scope, query, embedding. Entries older
    than the time to live never answer. Each question gets at most one answer, the exact one first. The open
    questions are read to the driver in blocks and sent to every task of the cache, which keeps one answer for each.
    """
    live = cache.filter(F.col("stored_us") + ttl_us > now_us).select(
        normalize_key(F.col("query"), F.col("scope")).alias("key"), F.coalesce("scope", F.lit("")).alias("s"), "response", F.col("embedding").alias("e"), "stored_us"
    )
    asked = questions.select("qid", normalize_key(F.col("query"), F.col("scope")).alias("key"), F.coalesce("scope", F.lit("")).alias("s"), F.col("embedding").alias("q"))
    exact = asked.join(live.groupBy("key").agg(F.max_by("response", "stored_us").alias("response")), "key", "left").select("qid", "s", "q", "response")
    best = _nearest_answers(live, exact.filter("response is null and q is not null").select("qid", "s", F.col("q").cast("array<double>").alias("q")), least)
    return exact.select("qid", "response").join(best, "qid", "left").select(
        "qid", F.coalesce("response", "near").alias("response"), F.when(F.col("response").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("miss").alias("hit")
    )


def _nearest_answers(live: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(qid, near, score): the response of the nearest entry of the question's scope, of equal scores the largest."""
    qid, text = asked.schema["qid"].dataType, live.schema["response"].dataType
    out = asked.sparkSession.createDataFrame([], StructType([StructField("qid", qid), StructField("response", text), StructField("score", DoubleType())]))
    src = live.select("s", "response", F.col("e").cast("array<double>").alias("e")).filter("e is not null")

    def passes() -> Iterator[list[tuple]]:
        block = []
        for r in asked.toLocalIterator():
            block.append((r.qid, r.s, r.q))
            if len(block) == QUESTION_BLOCK:
                yield block
                block = []
        if block:
            yield block

    for block in passes():
        groups: dict[tuple[str, int], tuple[list, list]] = {}
        for key, scope, q in block:
            v = np.array(q, np.float64)  # null becomes nan
            norm = np.sqrt((v * v).sum())
            if np.isfinite(norm) and norm > 0:
                ids, vectors = groups.setdefault((scope, len(q)), ([], []))
                ids.append(key)
                vectors.append(v / norm)
        if groups:
            shared = asked.sparkSession.sparkContext.broadcast({k: (ids, np.array(v)) for k, (ids, v) in groups.items()})
            out = out.union(_answers_of_block(src, shared, least, qid, text))
    return out.groupBy("qid").agg(F.max_by("response", F.struct("score", "response")).alias("near"), F.max("score").alias("score"))


def _answers_of_block(src: DataFrame, shared: Broadcast, least: float, qid: DataType, text: DataType) -> DataFrame:
    kinds = pa.schema([("qid", to_arrow_type(qid)), ("response", to_arrow_type(text)), ("score", pa.float64())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int, int], tuple] = {}
        for b in batches:
            for (scope, dim), (_, m) in shared.value.items():
                own = b.filter(pc.and_(pc.equal(b.column("s"), scope), pc.equal(pc.list_value_length(b.column("e")), dim)))
                for at in range(0, own.num_rows, CACHE_ROWS):
                    part = own.slice(at, CACHE_ROWS)
                    x = pc.list_flatten(part.column("e")).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    norm = np.sqrt((x * x).sum(1))
                    ok = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                    if not len(ok):
                        continue
                    x = x[ok] / norm[ok, None]
                    near = x @ m.T
                    top = near.max(0)
                    for q in np.flatnonzero(top >= least - 1e-9):
                        i = np.flatnonzero(near[:, q] >= top[q] - 1e-9)
                        # Summed pair by pair, so that equal vectors tie whatever their place in the product.
                        score = (x[i] * m[q]).sum(1)
                        for k in np.flatnonzero(score == score.max()):
                            r = part.column("response")[int(ok[i[k]])].as_py()
                            best[scope, dim, q] = max(best.get((scope, dim, q), (-2.0, False, "")), (float(score[k]), r is not None, r if r is not None else ""))
        found = [(shared.value[scope, dim][0][q], r if known else None, score) for (scope, dim, q), (score, known, r) in best.items() if score >= least]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    return src.mapInArrow(answer, StructType([StructField("qid", qid), StructField("response", text), StructField("score", DoubleType())]))
