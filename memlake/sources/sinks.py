"""Backup, restore, exports and change delivery."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _checksum(df: DataFrame) -> str:
    """An order-free checksum of a table: the sum of its row hashes, with its schema."""
    total = df.select(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("h")).first().h
    return hashlib.sha256(f"{df.schema.simpleString()}|{total}".encode()).hexdigest()


def backup(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes every table as Parquet and then a manifest with counts and checksums; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    out = {"format": FORMAT, "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        back = spark.read.parquet(f"{folder}/{name}")
        out["tables"][name] = {"rows": back.count(), "checksum": _checksum(back)}
    fs, p = _fs(spark, f"{folder}/manifest.json")
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(out, sort_keys=True).encode()))
    stream.close()
    return out


def manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first().value)


def restore(spark: SparkSession, folder: str, target: str) -> dict[str, DataFrame]:
    """Checks a backup and puts its tables under ``target``: staged first, swapped in only when all are whole."""
    m = manifest(spark, folder)
    if m["format"] > FORMAT:
        raise ValueError(f"backup format {m['format']} is newer than {FORMAT}")
    for name, x in m["tables"].items():
        df = spark.read.parquet(f"{folder}/{name}")
        if df.count() != x["rows"] or _checksum(df) != x["checksum"]:
            raise ValueError(f"table {name} of the backup is damaged")
    stage = f"{target.rstrip('/')}.staged"
    fs, p = _fs(spark, stage)
    fs.delete(p, True)
    for name in m["tables"]:
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{stage}/{name}")
    t, aside = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (target, f"{target.rstrip('/')}.before"))
    fs.delete(aside, True)
    if fs.exists(t) and not fs.rename(t, aside):  # what was there stays aside until the new tables are in place
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(p, t):
        fs.rename(aside, t)
        raise OSError(f"cannot move {stage} to {target}")
    fs.delete(aside, True)
    return {name: spark.read.parquet(f"{target}/{name}") for name in m["tables"]}


def prune_backups(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all but the ``keep`` newest folders that have a manifest (by name); returns what was deleted."""
    fs, p = _fs(spark, folder)
    done = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest.json")))
    old = done[: max(0, len(done) - keep)] if keep else done
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, name), True)
    return old


def entity_export(events: DataFrame, entity: str) -> DataFrame:
    """Events whose payload holds ``entity``, taken literally, in order of time."""
    return events.filter(F.col("payload").contains(entity)).orderBy("ts", "id")


def note_export(mem: DataFrame, edges: DataFrame) -> DataFrame:
    """(filename, note) for each active memory: front matter, content and links along its subject's edges.

    File names come from subject or content; equal ones get a number.
    """
    from pyspark.sql import Window

    links = edges.filter("state = 'active'").groupBy("tenant_id", F.lower("src").alias("k")).agg(F.array_sort(F.collect_set("dst")).alias("links"))
    m = mem.filter("state = 'active'").withColumn("k", F.lower("subject"))
    title = F.coalesce(F.nullif(F.trim("subject"), F.lit("")), F.substring("content", 1, 40))
    clean = F.nullif(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|\n\r\t]+', " ")), F.lit(""))
    m = m.join(links, ["tenant_id", "k"], "left").withColumn("base", F.coalesce(clean, F.lit("note")))
    n = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("id"))
    name = F.concat("base", F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.lit(".md"))
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\nimportance: "), F.col("importance").cast("string"), F.lit("\n---\n\n"))
    tail = F.when(F.size("links") > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform("links", lambda d: F.concat(F.lit("[["), d, F.lit("]]"))), " "))).otherwise("")
    return m.select("id", name.alias("filename"), F.concat(head, F.col("content"), F.coalesce(tail, F.lit(""))).alias("note"))


def tenant_export(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """A tenant's rows of every table; of memories the active ones."""
    out = {n: df.filter(F.col("tenant_id") == tenant) for n, df in tables.items()}
    return {n: df.filter("state = 'active'") if n == "memories" else df for n, df in out.items()}


def tenant_import(tables: dict[str, DataFrame], snapshot: dict[str, DataFrame], key: dict[str, str]) -> dict[str, DataFrame]:
    """The tables with a snapshot's rows taken over by key; rows of the same key are replaced."""
    return {n: df.join(snapshot[n].select(key[n]), key[n], "left_anti").unionByName(snapshot[n]) if n in snapshot else df for n, df in tables.items()}


def deliver(rows: DataFrame, url: str, stream: str, attempts: int = 3, send: Callable[[str, bytes], None] | None = None) -> None:
    """Posts every changed row of a micro-batch as {stream, event, row}, from the executors; after the attempts it is dropped."""

    def post(u: str, body: bytes) -> None:
        urllib.request.urlopen(urllib.request.Request(u, body, {"content-type": "application/json"}), timeout=10).close()

    def part(it) -> None:
        for r in it:
            body = json.dumps({"stream": stream, "event": r.event, "row": json.loads(r.row)}).encode()
            for n in range(1, attempts + 1):
                try:
                    (send or post)(url, body)
                    break
                except OSError:
                    time.sleep(0.2 * n)

    rows.select("event", F.to_json(F.struct("*")).alias("row")).foreachPartition(part)
