"""What all operators share: the shared folder, written intermediate tables, small column helpers.

Lineage is cut by writing a table to the folder named in ``spark.checkpoint.dir``, which every executor of a cluster
can reach, so that an executor can be lost at any time. Only where that setting is missing (tests, a laptop) a local
temporary folder stands in.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to the shared folder and read back: later plans start from these files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlake-{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class freed_shuffles:
    """While it lasts, Spark removes the shuffle files of each SQL execution as soon as that execution ends."""

    KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, spark.conf.get(self.KEY, None)

    def __enter__(self) -> None:
        self.spark.conf.set(self.KEY, "true")

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def width(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of partitions for ``rows``: the session's own, or more where a partition would pass ``rows_each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows / rows_each), 1)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone; a number passes as it is."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(quoted(name)))
    if kind in ("timestamp", "date"):
        return F.unix_micros(F.col(quoted(name)).cast("timestamp"))
    return F.col(quoted(name)).cast("bigint")


def quoted(name: str) -> str:
    """The column name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def row_hashes(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of all ``columns``; the pattern of nulls counts too."""
    parts = [F.col(quoted(c)) for c in columns]
    nulls = F.concat(*[F.when(p.isNull(), "0").otherwise("1") for p in parts])
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit(0x5E551015), *reversed(parts), nulls)


def blank_trimmed(c: Column) -> Column:
    """Without spaces and tabs at the ends."""
    return F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")


def collapsed(c: Column) -> Column:
    """Lower-cased, trimmed, every run of Unicode white space one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores. Only a small input, of fewer files or splits
    than cores, is shuffled for that; a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
