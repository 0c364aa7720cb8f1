"""Lexical ranking, rank fusion and hybrid retrieval, each as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalars import recency
from memlake.functions.text import tokenize
from memlake.plans.shared import written

K1, B, RRF_K = 1.2, 0.75, 60.0
SCAN_CAP, POOL = 2048, 50
#: Classes of alike documents up to which a term is rare to ``bm25_top``; it changes the cost, not the result.
RARE_TERM = 200


def query_terms(query: str, df: DataFrame) -> list[str]:
    """The distinct terms of a query string."""
    row = df.sparkSession.range(1).select(F.array_distinct(tokenize(F.lit(query))).alias("t")).first()
    return list(row.t)


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def bm25(docs: DataFrame, query: str, id: str = "id", text: str = "content") -> DataFrame:
    """(id, score) of the documents with a positive BM25 score; statistics over the given candidates."""
    terms = query_terms(query, docs)
    if not terms:
        return docs.select(id, F.lit(0.0).alias("score")).limit(0)
    toks = docs.select(id, tokenize(F.col(text)).alias("t")).withColumn("dl", F.size("t").cast("double"))
    tf = toks.select(id, "dl", *[F.size(F.filter("t", _equals(q))).cast("double").alias(f"f{i}") for i, q in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        f, n_q = F.col(f"f{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - n_q + 0.5) / (n_q + 0.5) + 1.0)
        parts.append(F.when(f > 0, idf * (f * (K1 + 1.0)) / (f + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
    return tf.join(F.broadcast(stats)).select(id, sum(parts[1:], parts[0]).alias("score")).filter("score > 0")


def bm25_batch(docs: DataFrame, queries: DataFrame, id: str = "id", text: str = "content", k: int | None = None) -> DataFrame:
    """(qid, id, score) for many queries (qid, query) at once, through one exploded term table.

    Postings are restricted to query terms before they shuffle; corpus statistics come from all documents.
    """
    toks = docs.select(F.col(id).alias("id"), tokenize(F.col(text)).alias("t")).withColumn("dl", F.size("t").cast("double"))
    stats = toks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    q = queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"))
    wanted = q.select("term").distinct()
    post = toks.select("id", "dl", F.explode("t").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("f"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("nq"))
    w = post.join(df, "term").join(F.broadcast(stats)).select(
        "term", "id", (F.log((F.col("n") - F.col("nq") + 0.5) / (F.col("nq") + 0.5) + 1.0) * (F.col("f") * (K1 + 1.0)) / (F.col("f") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))).alias("w")
    )
    scored = q.join(w, "term").groupBy("qid", "id").agg(F.sum("w").alias("score"))
    if k is None:
        return scored
    win = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, id: str = "id", text: str = "content") -> DataFrame:
    """(qid, id, score, rank): the k best documents by BM25 for each of very many queries (qid, query).

    Exact: the ranks of ``bm25_batch``, but pairs of a query and a document are only made where they can matter.

    * Documents of one length with the same query terms score alike in every query: they are one class, of which the k
      smallest ids can be hits.
    * A term is rare if at most RARE_TERM classes hold it. All classes with a rare term of the query are scored.
    * A class without one scores by the query's other terms alone. Queries share few sets of those, and each set is
      ranked once. A document outside the k best of the set is behind k that score no less in the whole query.

    Scores are summed in the order of the terms and compared at 12 digits, ties by id. Ids are unique; texts that are
    null have no terms but count as documents, queries without known terms have no rows.
    """
    best = lambda keys, *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    weighed = lambda: F.array_sort(F.collect_list(F.struct("term", "w")))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["w"])
    toks = docs.select(F.col(id).alias("id"), tokenize(F.col(text)).alias("t")).withColumn("dl", F.size("t").cast("double"))
    stats = toks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    q = written(queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term")).distinct(), "asked")
    own = toks.select("id", "dl", F.explode("t").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    own = written(own.groupBy("id", "dl").agg(F.array_sort(F.collect_list("term")).alias("ts")), "terms")
    first = F.min("id").over(Window.partitionBy("dl", "ts").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    members = written(own.select("id", "dl", "ts", first.alias("cid"), best(["dl", "ts"], "id").alias("place")).filter(F.col("place") <= k), "classes")
    post = members.filter("place = 1").select("cid", "dl", F.explode("ts").alias("term")).groupBy("cid", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("f"))
    df = own.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("nq"))
    known = written(df.join(post.groupBy("term").agg((F.count(F.lit(1)) > RARE_TERM).alias("often")), "term"), "known")
    idf = F.log((F.col("n") - F.col("nq") + 0.5) / (F.col("nq") + 0.5) + 1.0)
    w = idf * (F.col("f") * (K1 + 1.0)) / (F.col("f") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))
    post = written(post.join(known, "term").join(F.broadcast(stats)).select("cid", "term", "often", w.alias("w")), "postings")  # stats: one row
    q = q.join(known, "term").groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.array_sort(F.collect_list(F.when(F.col("often"), F.col("term")))).alias("frequent"))
    q = written(q, "queries")

    rare = q.select("qid", F.explode(F.array_except("terms", "frequent")).alias("term")).join(post.filter("not often").select("term", "cid"), "term").select("qid", "cid")
    # what follows knows frequent terms alone: documents that have the same ones with the same weights are one class again
    alike = members.select("id", "cid").join(post.filter("often").groupBy("cid").agg(weighed().alias("tw")), "cid")
    first = F.min("id").over(Window.partitionBy("tw").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    alike = written(alike.select("id", "cid", "tw", first.alias("fid"), best(["tw"], "id").alias("place")).filter(F.col("place") <= k), "frequent")
    sets = q.select("frequent").distinct().select("frequent", F.explode("frequent").alias("term"))
    scored = sets.join(alike.filter("place = 1").select("fid", F.explode("tw").alias("x")).select("fid", "x.term", "x.w"), "term").groupBy("frequent", "fid").agg(F.round(total(weighed()), 12).alias("s"))
    near = scored.withColumn("r", best(["frequent"], F.desc("s"), "fid")).filter(F.col("r") <= k).drop("r").join(alike.select("fid", "id", "cid"), "fid")
    near = near.withColumn("r", best(["frequent"], F.desc("s"), "id")).filter(F.col("r") <= k).select("frequent", "cid").distinct()

    pairs = rare.unionByName(q.select("qid", "frequent").join(near, "frequent").select("qid", "cid")).distinct()
    each = pairs.join(q.select("qid", "terms"), "qid").join(post.groupBy("cid").agg(weighed().alias("tw")), "cid")
    each = each.select("qid", "cid", total(F.filter("tw", lambda x: F.array_contains("terms", x["term"]))).alias("score")).withColumn("s", F.round("score", 12))
    hits = each.withColumn("r", best(["qid"], F.desc("s"), "cid")).filter(F.col("r") <= k).join(members.select("cid", "id"), "cid")
    return hits.withColumn("rank", best(["qid"], F.desc("s"), "id")).filter(F.col("rank") <= k).select("qid", "id", "score", "rank")


def ranked(arm: DataFrame, by: list[Column], weight: float = 1.0, limit: int | None = None) -> DataFrame:
    """An arm of the fusion: (id, w) with 1-based ranks turned to weight / (k + rank)."""
    cut = arm.orderBy(*by).limit(limit) if limit else arm
    r = F.row_number().over(Window.orderBy(*by))
    return cut.select("id", (F.lit(weight) / (RRF_K + r)).alias("w"))


def rrf(arms: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion of ranked arms: (id, rrf)."""
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out.groupBy("id").agg(F.sum("w").alias("rrf"))


def list_active(mem: DataFrame, scope: Column, limit: int) -> DataFrame:
    """The ``limit`` best active memories of a scope by importance, then newest start, ties by id."""
    return mem.filter(scope & (F.col("state") == "active")).orderBy(F.desc("importance"), F.desc("valid_from"), "id").limit(max(1, limit))


def graph_arm(edges: DataFrame, live: DataFrame, query: str, scan_cap: int, tenant: str | None = None) -> DataFrame:
    """(id, first) of the memories among ``live`` whose source edge touches a query term; ``first`` is the edge's place by
    weight among the ``scan_cap`` heaviest active edges of the tenant. ``live`` are the active memories of the scope,
    not the lexical candidates alone: the arm is there to find what those lack."""
    terms = query_terms(query, edges)
    own = edges.filter("state = 'active'")
    top = (own if tenant is None else own.filter(F.col("tenant_id") == tenant)).orderBy(F.desc("weight"), "id").limit(scan_cap)
    q = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), "id")))  # scan_cap rows
    hit = placed.filter("source_memory_id is not null").filter(F.arrays_overlap(tokenize(F.col("src")), q) | F.arrays_overlap(tokenize(F.col("dst")), q))
    return hit.groupBy(F.col("source_memory_id").alias("id")).agg(F.min("place").alias("first")).join(live.select("id"), "id", "left_semi")


def similarity(query: list[float]) -> Callable[[Column], Column]:
    """The cosine of a vector column with ``query``: one matrix product for each Arrow batch. Null for vectors of another
    length, with nulls or numbers that are not finite, and of length 0."""
    import numpy as np
    import pyarrow.compute as pc

    q = np.array(query, np.float64)
    q = q / np.sqrt((q * q).sum())

    @F.arrow_udf("double")
    def cosines(v: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False)
        x = pc.list_flatten(v.filter(fits)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
        norm = np.sqrt((x * x).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
        out, known = np.zeros(len(v)), np.zeros(len(v), bool)
        at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[ok]
        out[at], known[at] = (x[ok] / norm[ok, None]) @ q, True
        return pa.array(out, mask=~known)

    return cosines


def memory_search(
    mem: DataFrame,
    scope: Column,
    query: str,
    k: int,
    now_us: int,
    vector: list[float] | None = None,
    edges: DataFrame | None = None,
    vector_weight: float = 1.0,
    lexical_weight: float = 1.0,
    importance_weight: float = 0.3,
    recency_weight: float = 0.2,
    scan_cap: int | None = SCAN_CAP,
    pool: int = POOL,
    rerank: Callable[[str, list[str]], list[float]] | None = None,
    tenant: str | None = None,
) -> DataFrame:
    """The k best memories of a scope by BM25, vector and graph arms, fused and blended with importance and recency.

    ``mem`` has id, content, importance, state, valid_from, updated_us and embedding. The scope is read once, without
    its vectors, and kept in a written table while the arms rank it. BM25 works on the ``scan_cap`` most important
    memories (None: on all, its statistics too). ``edges``, those of ``tenant``, switch on the graph arm. A blank
    query, and a query that no arm answers, list the scope by importance with score 0. Ties go by id. The result has
    the columns of ``mem`` but for the embedding, and the score.
    """
    near = F.lit(None).cast("double") if vector is None else similarity(vector)(F.col("embedding"))
    live = mem.filter(scope & (F.col("state") == "active"))
    cols = [c for c in mem.columns if c != "embedding"]
    plain = lambda df, n: list_active(df, F.lit(True), n).select(*cols, F.lit(0.0).alias("score"))
    if not query.strip() or k <= 0:
        return plain(live, max(k, 1))
    live = written(live.select(*cols, near.alias("__near")), "scope")
    cand = (live if scan_cap is None else list_active(live, F.lit(True), max(scan_cap, k))).select("id", "content")
    pool = max(pool, k)
    arms = [ranked(bm25(cand, query), [F.desc("score"), F.col("id")], lexical_weight)]
    if vector is not None:
        arms.append(ranked(live.filter("__near is not null").select("id", F.col("__near").alias("score")), [F.desc("score"), F.col("id")], vector_weight, max(pool, 4 * k)))
    if edges is not None:
        arms.append(ranked(graph_arm(edges, live, query, max(scan_cap or SCAN_CAP, k), tenant), [F.col("first"), F.col("id")], lexical_weight))
    fused = rrf(arms).orderBy(F.desc("rrf"), "id").limit(pool)
    fresh = recency(F.col("updated_us"), F.lit(now_us))
    hits = live.drop("__near").join(F.broadcast(fused), "id").withColumn("score", F.col("rrf") * (1.0 + importance_weight * F.col("importance") + recency_weight * fresh)).drop("rrf")  # pool rows
    if rerank is not None:
        hits = reranked(hits, query, rerank, fresh)
    best = hits.orderBy(F.desc("score"), "id").limit(k).select(*cols, "score")
    if vector is not None:  # some vector is always nearest, unless there is none
        return best
    return best.unionByName(plain(live, k).join(best.select(F.lit(1).alias("some")).limit(1), how="left_anti"))


def memory_search_batch(mem: DataFrame, scope: Column, questions: DataFrame, k: int, now_us: int, vector_weight: float = 1.0, lexical_weight: float = 1.0, importance_weight: float = 0.3, recency_weight: float = 0.2, scan_cap: int | None = SCAN_CAP, pool: int = POOL) -> DataFrame:
    """(qid, id, score, rank): ``memory_search`` for many questions (qid, query, vector) on one scope at once.

    The scope is read once; postings, vectors and fused ranks of all questions run through the same few exchanges. The
    questions are a stated set that fits the driver; one without vector, or with an unusable one, has no vector arm.
    One that nothing answers has no rows.
    """
    from memlake.operators.vector import knn_batch

    live = written(mem.filter(scope & (F.col("state") == "active")), "scope")
    cand = (live if scan_cap is None else list_active(live, F.lit(True), max(scan_cap, k))).select("id", "content")
    pool = max(pool, k)
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    lex = bm25_batch(cand, questions.select("qid", "query")).filter("score > 0").select("qid", "id", (F.lit(lexical_weight) / (RRF_K + F.row_number().over(place))).alias("w"))
    asked = [(r.qid, list(r.vector)) for r in questions.filter("vector is not null").select("qid", F.col("vector").cast("array<double>").alias("vector")).collect() if r.vector and all(x is not None and x == x and abs(x) != float("inf") for x in r.vector) and any(r.vector)]
    arms = [lex]
    for dim in sorted({len(q) for _, q in asked}):
        near = knn_batch(live, [(i, q) for i, q in asked if len(q) == dim], max(pool, 4 * k))
        arms.append(near.select(F.col("query").cast(questions.schema["qid"].dataType).alias("qid"), "id", (F.lit(vector_weight) / (RRF_K + F.col("rank"))).alias("w")))
    fused = reduce(DataFrame.unionByName, arms).groupBy("qid", "id").agg(F.sum("w").alias("rrf"))
    fused = fused.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "id"))).filter(F.col("r") <= pool)
    fresh = recency(F.col("updated_us"), F.lit(now_us))
    hits = live.select("id", "importance", "updated_us").join(fused, "id").select("qid", "id", (F.col("rrf") * (1.0 + importance_weight * F.col("importance") + recency_weight * fresh)).alias("score"))
    return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def reranked(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], fresh: Column) -> DataFrame:
    """The pool with scores from a relevance model, lifted a little by recency; a failing model keeps the fused score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("content").to_pylist()
            try:
                s = [float(x) for x in scorer(query, texts)]
                s = s if len(s) == len(texts) else [None] * len(texts)
            except Exception:  # noqa: BLE001 - any failure of a model degrades to the fused order
                s = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], names=["id", "model"])

    scores = hits.select("id", "content").coalesce(1).mapInArrow(run, "id string, model double")
    return hits.join(scores, "id").withColumn("score", F.when(F.col("model").isNull(), F.col("score")).otherwise(F.col("model") * (1.0 + 0.1 * fresh))).drop("model")


def shared_search(mem: DataFrame, grants: DataFrame, tenant: str, user: str, search: Callable[[Column], DataFrame], k: int) -> DataFrame:
    """The user's own scope and those of each grantor in the tenant, best score for an id, top k. ``search`` maps a scope
    predicate to hits; grantors are few (one user's grants). Hits with source_event_ids keep all their sources."""
    grantors = [r.grantor_user_id for r in grants.filter((F.col("tenant_id") == tenant) & (F.col("grantee_user_id") == user)).select("grantor_user_id").distinct().orderBy("grantor_user_id").collect()]
    hits = reduce(DataFrame.unionByName, [search((F.col("tenant_id") == tenant) & (F.col("user_id") == u)) for u in dict.fromkeys([user, *grantors])])
    sources = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_event_ids")))).alias("source_event_ids")] if "source_event_ids" in hits.columns else []
    return hits.groupBy("id").agg(F.max("score").alias("score"), *sources).orderBy(F.desc("score"), "id").limit(k)


def merged_shards(shards: list[DataFrame], k: int) -> DataFrame:
    """The k best hits of several shards' answers (id, score), an id of several shards with its best score."""
    return reduce(DataFrame.unionByName, [s.select("id", "score") for s in shards]).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def rag_context(hits: DataFrame, events: DataFrame, memories: DataFrame, k: int = 5, least: float = 0.3, chars: int = 300) -> DataFrame:
    """(part, place, line): what a prompt gets: the k best events by similarity (``hits``: id, content, score of at least
    ``least``), the k newest events, and the k best memories, each text cut to ``chars``; ``context_hash`` gives its hash."""
    cut = lambda c: F.substring(F.coalesce(F.col(c), F.lit("")), 1, chars)
    line = lambda df, by, text: df.orderBy(*by, "id").limit(k).select("id", text.alias("line"), F.row_number().over(Window.orderBy(*by, "id")).alias("place"))
    a = line(hits.filter(F.col("score") >= least), [F.desc("score")], cut("content")).withColumn("part", F.lit("similar"))
    b = line(events, [F.desc("ts")], F.concat(F.lit("["), F.col("source"), F.lit("] "), F.col("event_type"), F.lit(": "), cut("payload"))).withColumn("part", F.lit("recent"))
    c = line(memories, [F.desc("score")], cut("content")).withColumn("part", F.lit("memory"))
    return a.unionByName(b).unionByName(c).select("part", "place", "line")


def context_hash(context: DataFrame) -> DataFrame:
    """(sha256) of a context's lines in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"]), "\n")
    return context.agg(F.sha2(lines, 256).alias("sha256"))


def first_hit(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank): the rank of the first hit (qid, rank, content) that contains the expected text of (qid, expected),
    whatever its case; null where none does."""
    met = gold.join(hits.select("qid", "rank", "content"), "qid", "left")
    good = F.lower("content").contains(F.lower("expected"))
    return met.groupBy("qid").agg(F.min(F.when(good, F.col("rank"))).alias("rank"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """recall@1/3/5 and MRR of (qid, rank), rank null where no hit held the answer."""
    hit = lambda n: F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0)))
    return ranks.agg(hit(1).alias("r1"), hit(3).alias("r3"), hit(5).alias("r5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def nearest_rank(df: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The percentile as the value at place floor(p * n) of the sorted values: equal values are counted first, so the
    window runs over distinct values, never over all rows."""
    keys = by or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(*keys))
    placed = counts.withColumn("upto", upto).withColumn("at", F.least(F.floor(n * p), n - 1))
    return placed.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select(*keys, F.col(value).alias("value"))
