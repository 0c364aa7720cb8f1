"""Event ingest, webhook normalising, embedding text, importers and chunking."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.scalars import uuid5_text

MAX_BATCH, MAX_EMBED_BYTES = 10_000, 2_048


def appendable(current: DataFrame | None, new: DataFrame) -> DataFrame:
    """The new events that an idempotent append adds: of one non-null key the first by (ts, id), and only if the table
    has none yet; rows without key are always added."""
    keyed = new.filter("idempotency_key is not null")
    rest = [c for c in new.columns if c != "idempotency_key"]
    first = keyed.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), F.struct("ts", "id")).alias("r")).select("idempotency_key", "r.*").select(*new.columns)
    if current is not None:
        first = first.join(current.select("idempotency_key").filter("idempotency_key is not null"), "idempotency_key", "left_anti").select(*new.columns)
    return new.filter("idempotency_key is null").unionByName(first)


def append(new: DataFrame, path: str) -> int:
    """Appends events to the Parquet log at ``path``, idempotently; returns how many rows that added."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    add = appendable(spark.read.parquet(path) if there else None, new).persist()
    n = add.count()
    add.write.mode("append").parquet(path)
    add.unpersist()
    return n


def tenant_tagged(events: DataFrame, tenant: str) -> DataFrame:
    """Events with the tenant as column and, in object payloads, as ``_tenant_id``."""
    p = F.col("payload")
    obj = F.regexp_replace(p, r"^\s*\{\s*", "{")
    rest = F.substring(obj, 2, 1 << 30)
    head = F.concat(F.lit('{"_tenant_id":'), F.to_json(F.array(F.lit(tenant))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(tenant)))) - 2))
    return events.withColumn("payload", F.when(p.rlike(r"^\s*\{"), F.when(rest.rlike(r"^\s*\}"), F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(","), rest))).otherwise(p)).withColumn("tenant_id", F.lit(tenant))


def rest_batch(spark: SparkSession, source: str, events: list[dict], at_us: int) -> DataFrame:
    """A batch of events as sent to an endpoint: type ``unknown`` where missing, at most 10 000."""
    if len(events) > MAX_BATCH:
        raise ValueError(f"a batch takes at most {MAX_BATCH} events")
    rows = [(source, e.get("event_type") or "unknown", json.dumps(e.get("payload", {}), separators=(",", ":")), at_us, e.get("idempotency_key")) for e in events]
    return spark.createDataFrame(rows, "source string, event_type string, payload string, at_us bigint, idempotency_key string").withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")


def webhook_events(df: DataFrame, vendor: str = "vendor", body: str = "body") -> DataFrame:
    """(…, source, event_type, payload) of raw webhooks by vendor: github, sentry, slack, pagerduty, or generic."""
    b, v = F.col(body), F.col(vendor)
    j = lambda *paths, default: F.coalesce(*[F.get_json_object(b, "$." + p) for p in paths], F.lit(default))
    has = lambda p: F.get_json_object(b, "$." + p).isNotNull()
    action = j("action", default="unknown")
    kind = (
        F.when(has("pull_request"), F.concat(F.lit("pull_request."), action))
        .when(has("issue"), F.concat(F.lit("issue."), action))
        .when(has("commits"), F.lit("push"))
        .when(has("release"), F.concat(F.lit("release."), action))
        .otherwise(F.concat(F.lit("github."), action))
    )
    repo, project = j("repository.full_name", default="unknown"), j("data.issue.project.slug", "project_slug", default="unknown")
    sentry_action, title = j("action", default="triggered"), j("data.issue.title", "message", default="")
    slack = {"channel": j("event.channel", default="unknown"), "user": j("event.user", default="unknown"), "text": j("event.text", default="")}
    pager = {"service": j("event.data.service.name", default="unknown"), "title": j("event.data.title", default=""), "event_type": j("event.event_type", default="incident.trigger")}
    out = lambda s, t, p: F.struct(s.alias("source"), t.alias("event_type"), p.alias("payload"))
    obj = lambda d: F.to_json(F.struct(*[c.alias(k) for k, c in d.items()]))
    raw = F.concat(F.lit('{"action":'), _quoted(action), F.lit(',"repository":'), _quoted(repo), F.lit(',"sender":'), _quoted(j("sender.login", default="unknown")), F.lit(',"raw":'), b, F.lit("}"))
    made = (
        F.when(v == "github", out(F.concat(F.lit("github/"), repo), kind, raw))
        .when(v == "sentry", out(F.concat(F.lit("sentry/"), project), F.concat(F.lit("issue."), sentry_action), obj({"project": project, "title": title, "level": j("data.issue.level", default="error"), "action": sentry_action})))
        .when(v == "slack", out(F.concat(F.lit("slack/"), slack["channel"]), j("event.type", default="message"), obj(slack)))
        .when(v == "pagerduty", out(F.concat(F.lit("pagerduty/"), pager["service"]), pager["event_type"], obj(pager)))
        .otherwise(out(v, j("event_type", "type", "action", default="webhook"), b))
    )
    return df.withColumn("__e", made).select(*[c for c in df.columns if c not in (vendor, body)], "__e.*")


def _quoted(c: Column) -> Column:
    a = F.to_json(F.array(c))
    return a.substr(F.lit(2), F.length(a) - 2)


def embedding_text(event_type: str | None, payload: str | None, tags: list[str] | None) -> str:
    """What of an event is worth embedding: its type as words, readable payload strings, short nested JSON, tags."""
    parts = [(event_type or "").replace(".", " ")]
    try:
        doc = json.loads(payload) if payload is not None else None
    except ValueError:
        doc = None
    if isinstance(doc, dict):
        for k, x in doc.items():
            if k.startswith("_"):
                continue
            if isinstance(x, str):
                if len(x.encode()) > 2 and not all(c in "0123456789abcdefABCDEF-" for c in x):
                    parts.append(f"{k}: {x}")
            elif isinstance(x, (dict, list)):
                nested = json.dumps(x, separators=(",", ":"), ensure_ascii=False)
                if len(nested.encode()) < 500:
                    parts.append(nested)
    else:
        parts.append(json.dumps(doc, separators=(",", ":"), ensure_ascii=False))
    if tags:
        parts.append(" ".join(t or "" for t in tags))
    return ". ".join(parts).encode()[:MAX_EMBED_BYTES].decode(errors="ignore")


def with_embedding_text(events: DataFrame, out: str = "text") -> DataFrame:
    """(id, text) for each event, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("event_type", "payload", "tags")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([embedding_text(*r) for r in rows], pa.string())], names=["id", out])

    return events.select("id", "event_type", "payload", F.col("tags").cast("array<string>").alias("tags")).mapInArrow(run, f"id string, {out} string")


def unembedded(events: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Events without a vector, oldest first: by the table of vectors if given, else by the flag (null is not embedded)."""
    out = events.join(semantic.select("id"), "id", "left_anti") if semantic is not None else events.filter("embedded is not true")
    return out.orderBy("ts", "id")


def chunks(df: DataFrame, id: str, text: str, size: int = 1000, least: int = 50) -> DataFrame:
    """(id, index, total, chunk): paragraphs packed to chunks of about ``size`` characters; chunks under ``least`` are dropped."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    zero = F.array().cast("array<string>")
    pack = F.aggregate(
        paragraphs,
        zero,
        lambda acc, p: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) + 2 <= size), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws("\n\n", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))),
    )
    kept = F.filter(pack, lambda c: F.length(c) >= least)
    return df.select(F.col(id).alias("id"), kept.alias("c")).select("id", F.size("c").alias("total"), F.posexplode("c").alias("index", "chunk")).select("id", "index", "total", "chunk")


def import_mem0(spark: SparkSession, path: str) -> DataFrame:
    """(text, user_id, created_at, updated_at) of a Mem0 export: an array, or an object with results, memories or data."""
    raw = spark.read.text(path, wholetext=True)
    fields = "memory string, text string, content string, user_id string, created_at string, updated_at string"
    shapes = [F.from_json("value", f"array<struct<{fields}>>")] + [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<struct<{fields}>>") for k in ("results", "memories", "data")]
    rows = raw.select(F.explode(F.coalesce(*[F.when(F.size(F.filter(s, lambda x: F.coalesce(x["memory"], x["text"], x["content"]).isNotNull())) > 0, s) for s in shapes])).alias("m"))
    return rows.select(F.coalesce("m.memory", "m.text", "m.content").alias("text"), "m.user_id", "m.created_at", "m.updated_at").filter("text is not null and trim(text) <> ''")


def import_zep(spark: SparkSession, path: str) -> DataFrame:
    """(kind, role, text) of a Zep export: facts (strings or objects) and messages; fails if it has neither."""
    raw = spark.read.text(path, wholetext=True)
    facts = F.from_json(F.get_json_object("value", "$.facts"), "array<string>")
    fact_text = F.transform(facts, lambda x: F.coalesce(F.get_json_object(x, "$.fact"), F.get_json_object(x, "$.content"), x))
    messages = F.from_json(F.get_json_object("value", "$.messages"), "array<struct<role:string,content:string>>")
    if not raw.filter(facts.isNotNull() | messages.isNotNull()).limit(1).count():
        raise ValueError("neither facts nor messages")
    a = raw.select(F.lit("fact").alias("kind"), F.lit(None).cast("string").alias("role"), F.explode(fact_text).alias("text"))
    b = raw.select(F.explode(messages).alias("m")).select(F.lit("message").alias("kind"), F.coalesce("m.role", F.lit("user")).alias("role"), F.col("m.content").alias("text"))
    return a.union(b).filter("text is not null and trim(text) <> ''")


def notes(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, title, front_matter, body, links) of Markdown notes: ``---`` front matter of ``k: v`` lines, distinct wiki links."""
    t = F.regexp_replace(F.col(text), "\r\n", "\n")
    front = F.regexp_extract(t, r"(?s)\A---\n(.*?)\n---\s*(?:\n|\z)", 1)
    body = F.when(front != "", F.regexp_replace(t, r"(?s)\A---\n.*?\n---\s*(?:\n|\z)", "")).otherwise(t)
    pairs = F.filter(F.transform(F.split(front, "\n"), lambda l: F.split(l, r":\s*", 2)), lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    fm = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))
    link = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]\[|#]+)[^\]\[]*\]\]"), 1), lambda x: F.trim(x)), lambda x: x != ""))
    stem = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.md)?$", 1)
    return files.select(F.col(path).alias("path"), F.coalesce(fm["title"], stem).alias("title"), fm.alias("front_matter"), F.trim(body).alias("body"), link.alias("links"))


def note_edges(parsed: DataFrame) -> DataFrame:
    """(src, relation, dst) for each link of a note."""
    return parsed.select(F.col("title").alias("src"), F.lit("links_to").alias("relation"), F.explode("links").alias("dst"))


def dialogues(df: DataFrame, body: str = "value") -> DataFrame:
    """(user, turns, qa) of evaluation sets in their own shape, in conversation-session shape or in question-haystack shape."""
    b = F.col(body)
    own_turns = F.from_json(F.get_json_object(b, "$.turns"), "array<string>")
    own_qa = F.from_json(F.get_json_object(b, "$.qa"), "array<struct<question:string,expected:string,answer:string,category:string>>")
    sessions = F.from_json(F.get_json_object(b, "$.conversation"), "map<string,string>")
    talk = F.flatten(
        F.transform(
            F.array_sort(F.filter(F.map_keys(sessions), lambda k: k.rlike(r"^session_\d+$")), lambda x, y: F.regexp_extract(x, r"\d+", 0).cast("int") - F.regexp_extract(y, r"\d+", 0).cast("int")),
            lambda k: F.transform(F.from_json(sessions[k], "array<struct<speaker:string,text:string>>"), lambda t: F.concat_ws(": ", t["speaker"], t["text"])),
        )
    )
    hay = F.flatten(F.from_json(F.get_json_object(b, "$.haystack_sessions"), "array<array<struct<role:string,content:string>>>"))
    hay_turns = F.transform(hay, lambda t: F.concat_ws(": ", t["role"], t["content"]))
    single = F.array(F.struct(F.get_json_object(b, "$.question").alias("question"), F.get_json_object(b, "$.answer").alias("expected"), F.get_json_object(b, "$.question_type").alias("category")))
    qa = F.transform(own_qa, lambda q: F.struct(q["question"].alias("question"), F.coalesce(q["expected"], q["answer"]).alias("expected"), q["category"].alias("category")))
    user = F.coalesce(F.get_json_object(b, "$.user"), F.get_json_object(b, "$.sample_id"), F.get_json_object(b, "$.question_id"), F.lit("user"))
    return df.select(user.alias("user"), F.coalesce(own_turns, talk, hay_turns).alias("turns"), F.coalesce(qa, F.when(F.get_json_object(b, "$.haystack_sessions").isNotNull(), single)).alias("qa"))


def note_rows(parsed: DataFrame, tenant: str, at: Column, user: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The statements (for ``operators.memory.additions``) and edges that notes stand for: a note's body on the subject of
    its title, its links as edges. Ids depend on path and link alone, so a note read again changes nothing but its text."""
    none, name = F.lit(None).cast("string"), F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    statements = parsed.filter("body <> ''").select(
        uuid5_text(name, F.concat_ws("|", F.lit(tenant), "path", "body")).alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(user).cast("string").alias("user_id"), none.alias("agent_id"), none.alias("session_id"), F.col("title").alias("subject"), F.col("body").alias("content"),
        F.lit(0.5).alias("importance"), F.array().cast("array<string>").alias("source_event_ids"), F.to_json("front_matter").alias("metadata"), F.lit("semantic").alias("mem_type"), F.lit(None).cast("array<float>").alias("embedding"), at.alias("at"), F.col("path").alias("seq"),
    )
    links = note_edges(parsed)
    made = links.select(uuid5_text(name, F.concat_ws("|", F.lit(tenant), "src", "relation", "dst")).alias("id"), F.lit(tenant).alias("tenant_id"), "src", "relation", "dst", F.lit(1.0).alias("weight"), at.alias("valid_from"), F.lit("active").alias("state")).distinct()
    return statements, made


def marked(events: DataFrame, semantic: DataFrame) -> DataFrame:
    """Events with the flag ``embedded`` true where their vector is there."""
    own = semantic.select("id").distinct().withColumn("__has", F.lit(True))
    return events.join(own, "id", "left").withColumn("embedded", F.coalesce("__has", "embedded")).select(*events.columns)


def embedded_and_indexed(events: DataFrame, provider, batch: int = 64) -> DataFrame:
    """(id, source, event_type, tenant_id, text, embedding) of the events that have no vector yet and get one."""
    from memlake.operators.memory import embedded_rows

    todo = events.filter("embedded is not true")
    text = with_embedding_text(todo)
    known = embedded_rows(text, "text", provider, batch=batch).filter("embedding is not null")
    return known.join(todo.select("id", "source", "event_type", "tenant_id").dropDuplicates(["id"]), "id").select("id", "source", "event_type", "tenant_id", "text", "embedding")
