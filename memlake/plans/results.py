"""Results as typed JSON, and what the catalog tells about schema versions and registered functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

_PLAIN = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, StringType)


def json_value(c: Column, kind: DataType) -> Column:
    """A column as it stands in a typed row: booleans, numbers and strings as they are, numbers that are not finite as
    null, timestamps as RFC 3339 text, decimals, dates and bytes as text, so that no value changes its precision."""
    if isinstance(kind, (FloatType, DoubleType)):
        return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
    if isinstance(kind, _PLAIN):
        return c
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return _rfc3339(c)
    if isinstance(kind, (DecimalType, DateType)):
        return c.cast("string")
    if isinstance(kind, BinaryType):
        return F.base64(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: json_value(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[json_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: json_value(x, kind.valueType))
    return c.cast("string")


def _rfc3339(c: Column) -> Column:
    t = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.when(t.endswith(".000000"), F.substring(t, 1, 19)).otherwise(t), F.lit("+00:00"))


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON object, columns in their order, nulls kept (sessions run in UTC)."""
    cols = [json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def json_answer(df: DataFrame, max_rows: int) -> dict:
    """What a caller of the query endpoint gets: column names and types, rows as JSON texts, and whether some are missing."""
    got = [r.row for r in json_rows(df.limit(max_rows + 1)).collect()]  # bounded by max_rows
    return {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "rows": got[:max_rows], "truncated": len(got) > max_rows}


def schema_version(migrations: DataFrame, version: str = "version") -> DataFrame:
    """(version): the latest applied migration, 0 where there is none."""
    return migrations.agg(F.coalesce(F.max(version), F.lit(0)).cast("bigint").alias("version"))


def pending(known: list[int], migrations: DataFrame) -> list[int]:
    """The migrations still to apply, in order."""
    at = schema_version(migrations).first().version
    return sorted(v for v in known if v > at)


def register_functions(spark: SparkSession, functions: dict[str, tuple[Callable, str]]) -> frozenset[str]:
    """Registers vectorised functions (name -> function over pandas Series, type) for statements; returns their names,
    which the SQL guard lets through where it is given them."""
    for name, (f, kind) in functions.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    return frozenset(n.lower() for n in functions)
