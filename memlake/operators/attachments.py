"""Attachments of memories: metadata rows, contents as files of a shared folder, and search by image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.vector import knn

COLUMNS = ["id", "tenant_id", "memory_id", "content_type", "filename", "size", "storage_key", "created_at"]


def put(attachments: DataFrame, new: DataFrame) -> DataFrame:
    """The metadata with new rows (all but size and storage_key given, with ``content``); size and key come from the
    content, an id that is there already stays as it is."""
    made = new.withColumn("size", F.length("content").cast("bigint")).withColumn("storage_key", F.concat_ws("/", F.lit("attachments"), "tenant_id", "id"))
    rest = [c for c in COLUMNS if c != "id"]
    once = made.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")
    return attachments.select(*COLUMNS).unionByName(once.join(attachments.select("id"), "id", "left_anti").select(*[F.col(c).cast(attachments.schema[c].dataType).alias(c) for c in COLUMNS]))


def get(attachments: DataFrame, tenant: str, id: str) -> DataFrame:
    """One attachment's metadata; no rows if it is another tenant's."""
    return attachments.filter((F.col("tenant_id") == tenant) & (F.col("id") == id))


def listed(attachments: DataFrame, tenant: str, memory_id: str | None = None) -> DataFrame:
    """A tenant's attachments, or those of one memory, oldest first."""
    out = attachments.filter(F.col("tenant_id") == tenant)
    out = out if memory_id is None else out.filter(F.col("memory_id") == memory_id)
    return out.orderBy("created_at", "id")


def removed(attachments: DataFrame, tenant: str, ids: DataFrame) -> DataFrame:
    """The metadata without a tenant's attachments of ``ids``; other tenants' stay."""
    gone = ids.select(F.col("id"), F.lit(tenant).alias("tenant_id")).distinct()
    return attachments.join(gone, ["id", "tenant_id"], "left_anti").select(*attachments.columns)


def search(entries: DataFrame, attachments: DataFrame, tenant: str, query: list[float], k: int) -> DataFrame:
    """The attachments of a tenant nearest to an image's vector, with their score: ``entries`` (id, modality, embedding)
    of modality ``image`` are ranked among the tenant's own, so k come out if there are as many."""
    own = attachments.filter(F.col("tenant_id") == tenant)
    near = entries.filter("modality = 'image'").join(own.select("id"), "id", "left_semi")
    return own.join(knn(near, query, k).select("id", "score"), "id").orderBy(F.desc("score"), "id")
