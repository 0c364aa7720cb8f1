"""Joins in time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, start: str, end: str | None, take: list[str], ties: dict[str, bool] | None = None) -> DataFrame:
    """Each left row with the columns ``take`` of the right row of its keys that held at its time: of all periods
    (half-open, null end open) around the time, the one with the latest start; of equal starts, the one with the largest
    (True) or smallest (False) of the columns ``ties`` in turn, then the largest of ``take``. One sort of both sides together, no range join: a key's rows never meet pairwise. A task
    carries the open periods of one key from row to row, less those that a later start outlasts. Left rows without
    match, and with a null time or key, keep nulls."""
    cols = left.columns
    ups = [*(ties or {}).items(), *[(c, True) for c in take]]
    tag = F.struct(*([F.col(end).alias("__e")] if end else []), *take)
    rank = F.struct(*[F.col(c).alias(f"t{i}") for i, (c, _) in enumerate(ups)])
    r = right.filter(F.col(start).isNotNull()).dropna(subset=keys)
    r = r.select(*keys, F.col(start).alias("__at"), F.lit(0).alias("__side"), tag.alias("__r"), rank.alias("__t"))
    kind, order = r.schema["__r"].dataType, r.schema["__t"].dataType
    both = left.select(*cols, F.col(time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__r"), F.lit(None).cast(order).alias("__t")).unionByName(r, allowMissingColumns=True)
    last = [F.col("__t")[f"t{i}"].asc_nulls_first() if up else F.col("__t")[f"t{i}"].desc_nulls_first() for i, (_, up) in enumerate(ups)]
    placed = both.repartition(*keys).sortWithinPartitions(*keys, "__at", "__side", *last).drop("__t")
    held = pa.struct([(f.name, to_arrow_type(f.dataType, timestamp_utc=True)) for f in kind.fields])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, []
        for b in batches:
            at, side, seen = b.column("__at").to_pylist(), b.column("__side").to_pylist(), b.column("__r").to_pylist()
            got = []
            for i, k in enumerate(zip(*[b.column(c).to_pylist() for c in keys], strict=True)):
                if k != key:
                    key, opened = k, []
                now, x = at[i], seen[i]
                if side[i]:
                    while opened and now is not None and opened[-1].get("__e") is not None and opened[-1]["__e"] <= now:
                        opened.pop()
                    got.append(opened[-1] if opened and now is not None else None)
                elif (e := x.get("__e")) is None:
                    opened = [x]
                elif e > now:
                    while opened and opened[-1]["__e"] is not None and opened[-1]["__e"] <= e:
                        opened.pop()
                    opened.append(x)
            own = b.filter(pc.equal(b.column("__side"), 1)).select(cols)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(got, held)], names=[*cols, "__h"])

    out = placed.mapInArrow(sweep, StructType([*[StructField(f.name, f.dataType) for f in left.schema.fields], StructField("__h", kind)]))
    return out.select(*cols, *[F.col("__h")[c].alias(c) for c in take])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, start: str, end: str, bucket_us: int) -> DataFrame:
    """All pairs of equal keys where the left time lies in the right period [start, end), null end open (all in
    microseconds). Periods are cut to buckets, so the join stays an equi-join; open ends reach to the last left time."""
    last = left.agg(F.max(time).alias("m")).first().m
    if last is None:
        last = 0
    r = right.filter(F.col(start).isNotNull()).withColumn("__e", F.least(F.coalesce(F.col(end), F.lit(last + 1)), F.lit(last + 1))).filter(F.col("__e") > F.col(start))
    spread = r.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket_us), F.floor((F.col("__e") - 1) / bucket_us)))).drop("__e")
    l = left.withColumn("__b", F.floor(F.col(time) / bucket_us))
    hit = l.join(spread, [*keys, "__b"]).filter((F.col(time) >= F.col(start)) & (F.col(end).isNull() | (F.col(time) < F.col(end))))
    return hit.drop("__b")


def wildcard_match(rows: DataFrame, patterns: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with every pattern row whose columns are ``*`` or equal; ``columns`` maps pattern to row columns.

    Each row is asked for once with every choice of wild columns that the patterns use, as one key of its own, so that
    one scan of the rows and one equi-join do for all. Nulls match ``*`` alone.
    """
    names = list(columns)
    keyed = patterns.withColumn("__wild", sum((F.when(F.col(n) == "*", 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0)))
    key = lambda mask, value: F.concat_ws("\u001f", mask.cast("string"), *[F.when(F.bit_get(mask, F.lit(i)) == 1, "").otherwise(value(n)) for i, n in enumerate(names)])
    null = lambda mask, value: sum((F.when((F.bit_get(mask, F.lit(i)) == 0) & value(n).isNull(), 1).otherwise(0) for i, n in enumerate(names)), F.lit(0)) > 0
    keyed = keyed.filter(~null(F.col("__wild"), F.col)).withColumn("__key", key(F.col("__wild"), F.col))
    masks = sorted(r[0] for r in keyed.select("__wild").distinct().collect())  # one for each choice of wild columns
    own = lambda n: F.col(columns[n]).cast("string")
    asked = rows.withColumn("__mask", F.explode(F.array(*[F.lit(x) for x in masks]) if masks else F.array().cast("array<int>")))
    asked = asked.filter(~null(F.col("__mask"), own)).withColumn("__key", key(F.col("__mask"), own)).drop("__mask")
    return asked.join(keyed.drop("__wild"), "__key").drop("__key")

