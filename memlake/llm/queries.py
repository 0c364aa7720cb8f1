"""The queries of the training-data problems on texts and vectors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.forest import similar_pairs
from memlake.llm.leaks import leaked
from memlake.llm.stuffing import labelled
from memlake.llm.tokens import encoded

#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("MEMLAKE_TOKENIZERS", "/opt/tokenizers")
#: The pattern that cuts texts to pieces for the byte-level vocabularies (fixed value).
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(spark.read.parquet(f"{d}/memories.parquet"), "id", "embedding", 64)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return encoded(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", spark.read.parquet(f"{d}/eval_items.parquet"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").where("stuffed").select(F.col("id").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p2_found, p7_ids, p8_found, p9_found)}
ORACLES: dict[str, str] = {}
