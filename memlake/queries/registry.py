"""How queries are registered: a function (spark, directory) and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

#: The instant that stands for "now" wherever a query needs one, and others in the tables' time.
NOW, MIDDLE = "2018-03-01 00:00:00", "2018-01-12 00:00:00"
NOW_US = 1_519_862_400_000_000


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A test table with its timestamps as UTC instants, read as such, so that filters still reach the files."""
    path = f"{d}/{table}.parquet"
    s = spark.read.parquet(path).schema
    kinds = [StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType) for f in s.fields]
    return spark.read.schema(StructType(kinds)).parquet(path)


def us(name: str, alias: str | None = None):
    """A timestamp column in microseconds."""
    return F.unix_micros(name).alias(alias or name.split(".")[-1])


def instant(text: str):
    return F.lit(text).cast("timestamp")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add
