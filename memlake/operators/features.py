"""Per-entity feature tables from events.

Events are reduced before every exchange: repeated copies within a batch, then whole partitions to one partial cell for
each (entity, type). The cells are hash-bucketed by entity; a bucket encodes entity and type indices, scatters its cells
into dense entity x type blocks with ``bincount`` (counts, totals) and ``maximum.at`` (recency), and emits Arrow columns.
A hot entity costs no more than its number of types in any bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.shared import blank_trimmed, micros, quoted, spread, width

CELL_SCHEMA = pa.schema([("entity", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("last", pa.int64()), ("total", pa.int64())])
NEVER = np.iinfo(np.int64).min
#: Entities of one dense block, and rows of one scatter: 2^20 weights under 2^32 keep float64 sums exact.
BLOCK_ENTITIES, SCATTER_ROWS = 256, 1 << 20
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def json_units(payload: Column, field: str = "units") -> Column:
    """The top-level integer ``field`` of a JSON object, also from a string, as a bigint; 0 where it is absent, null, no
    integer or beyond 64 bits, and where the payload is not readable as a whole, names a field twice or is no object.
    All in the JVM; payloads that do not name the field are not parsed."""
    text = F.get_json_object(payload, f"$.{field}")
    # what follows the payload is only reached if the payload ends where its object does
    framed = F.try_parse_json(F.concat(F.lit('{"payload":'), payload, F.lit(',"framed":1}')))
    whole = F.try_variant_get(framed, "$.framed", "int").isNotNull() & F.btrim(payload, F.lit(" \t\r\n")).startswith("{")
    named = payload.contains(f'"{field}"') | payload.contains("\\u")
    return F.coalesce(F.when(named & text.rlike(_INTEGER) & whole, F.regexp_replace(text, r"\s+", "").try_cast("bigint")), F.lit(0).cast("bigint"))


def merge_copies(t: pa.Table, key: str = "id") -> pa.Table:
    """Rows of one non-null key as one, each column its greatest non-null value."""
    t = t.combine_chunks()
    enc = pc.dictionary_encode(t.column(key)).combine_chunks()
    codes = np.nan_to_num(enc.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    if len(enc.dictionary) == np.count_nonzero(codes >= 0):
        return t
    many = (np.bincount(codes[codes >= 0], minlength=len(enc.dictionary)) > 1)[codes] & (codes >= 0)
    rest = [c for c in t.column_names if c != key]
    df = t.filter(pa.array(many)).to_pandas(types_mapper=pd_type)
    merged = df.groupby(key, sort=False, dropna=True)[rest].max().reset_index()
    return pa.concat_tables([t.filter(pa.array(~many)), pa.Table.from_pandas(merged[t.column_names], schema=t.schema, preserve_index=False)])


def pd_type(kind: pa.DataType):
    """Pandas types that keep nulls apart from values."""
    import pandas as pd

    return pd.StringDtype("pyarrow") if pa.types.is_string(kind) else pd.Int64Dtype() if pa.types.is_int64(kind) else None


def first_of_key(t: pa.Table) -> pa.Table:
    """Of the rows with one idempotency key the earliest alone; of equals the one with the smallest id."""
    t = t.combine_chunks()
    if len(pc.unique(t.column("idem"))) == t.num_rows:
        return t
    t = t.take(pc.sort_indices(t, sort_keys=[("idem", "ascending"), ("at", "ascending"), ("id", "ascending")]))
    k = t.column("idem").combine_chunks()
    first = np.ones(t.num_rows, bool)
    first[1:] = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False)
    return t.filter(pa.array(first))


def scatter(cell: np.ndarray, cells: int, n: np.ndarray, last: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, latest times and exact 64-bit totals of ``cells`` dense cells."""
    count, latest, lo, hi = (np.zeros(cells, np.int64) for _ in range(4))
    latest[:] = NEVER
    for a in range(0, len(cell), SCATTER_ROWS):
        part = slice(a, a + SCATTER_ROWS)
        c = cell[part]
        count += np.bincount(c, weights=n[part], minlength=cells).astype(np.int64)
        lo += np.bincount(c, weights=total[part] & 0xFFFFFFFF, minlength=cells).astype(np.int64)
        hi += np.bincount(c, weights=total[part] >> 32, minlength=cells).astype(np.int64)
        np.maximum.at(latest, c, last[part])
    return count, latest, lo + (hi << 32)


def cells_of(t: pa.Table) -> Iterator[pa.Table]:
    """The non-empty cells of a table of events or cells, by dense blocks of entities."""
    t = t.filter(pc.and_(pc.is_valid(t.column("entity")), pc.is_valid(t.column("kind"))))
    if not t.num_rows:
        return
    e = pc.dictionary_encode(t.column("entity")).combine_chunks()
    k = pc.dictionary_encode(t.column("kind")).combine_chunks()
    ei, ki, width_ = e.indices.to_numpy(), k.indices.to_numpy(), len(k.dictionary)
    n, total = t.column("n").to_numpy(), pc.fill_null(t.column("total"), 0).to_numpy()
    last = pc.fill_null(t.column("last"), NEVER).to_numpy()
    order = np.argsort(ei // BLOCK_ENTITIES, kind="stable") if len(e.dictionary) > BLOCK_ENTITIES else np.arange(len(ei))
    bounds = np.searchsorted((ei // BLOCK_ENTITIES)[order], np.arange(len(e.dictionary) // BLOCK_ENTITIES + 2))
    for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if x == y:
            continue
        rows = order[x:y]
        base = b * BLOCK_ENTITIES
        size = min(BLOCK_ENTITIES, len(e.dictionary) - base)
        count, latest, sums = scatter((ei[rows] - base).astype(np.int64) * width_ + ki[rows], size * width_, n[rows], last[rows], total[rows])
        hit = np.flatnonzero(count)
        yield pa.table(
            {
                "entity": e.dictionary.take(pa.array(base + hit // width_)),
                "kind": k.dictionary.take(pa.array(hit % width_)),
                "n": count[hit],
                "last": pa.array(latest[hit], mask=latest[hit] == NEVER),
                "total": sums[hit],
            },
            schema=CELL_SCHEMA,
        )


def entity_features(df: DataFrame, entity: str, kind: str, time: str, payload: str, id: str, idem: str, field: str = "units") -> DataFrame:
    """(entity, kind, n, last_us, total): one row for each pair of entity and type that has events.

    The type is trimmed of spaces and tabs and lower-cased. Rows of one id are one event, each field its greatest
    non-null value over the copies; rows without id are events of their own. Of the events with one non-null
    idempotency key only the earliest counts (a null time is latest; of equals the smallest id). ``total`` sums the
    top-level integer ``field`` of the JSON payload (``json_units``). Events without entity or type are ignored after
    that; ``last_us`` is null where no event has a time. An empty table gives no rows; further columns play no part.
    """
    P = width(df.sparkSession, df.count(), 500_000)
    src = df.select(
        F.col(quoted(id)).cast("string").alias("id"),
        F.col(quoted(entity)).cast("string").alias("entity"),
        F.lower(blank_trimmed(F.col(quoted(kind)).cast("string"))).alias("kind"),
        micros(df, time).alias("at"),
        F.col(quoted(idem)).cast("string").alias("idem"),
        F.when(F.col(quoted(payload)).isNotNull(), json_units(F.col(quoted(payload)).cast("string"), field)).alias("total"),
    )
    event = "id string, entity string, kind string, at bigint, idem string, total bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from merge_copies(pa.Table.from_batches([b])).to_batches()

    def out(t: pa.Table, raw: bool) -> Iterator[pa.RecordBatch]:
        """Events or cells in the schema that both share on the second exchange."""
        if raw:
            t = t.append_column("n", pa.array(np.ones(t.num_rows, np.int64))).rename_columns({"at": "last"})
        else:
            none = pa.nulls(t.num_rows, pa.string())
            t = t.append_column("id", none).append_column("idem", none)
        yield from t.select(["idem", "id", "entity", "kind", "n", "last", "total"]).to_batches(max_chunksize=50_000)

    mixed = "idem string, id string, entity string, kind string, n bigint, last bigint, total bigint"

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = merge_copies(pa.Table.from_batches(held))
            keyed = pc.is_valid(t.column("idem"))
            yield from out(first_of_key(t.filter(keyed)), True)
            plain = t.filter(pc.invert(keyed)).rename_columns({"at": "last"})
            for c in cells_of(plain.append_column("n", pa.array(np.ones(plain.num_rows, np.int64)))):
                yield from out(c, False)

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            keyed = pc.is_valid(t.column("idem"))
            events = first_of_key(t.filter(keyed).rename_columns({"last": "at"})).rename_columns({"at": "last"})
            cols = CELL_SCHEMA.names
            for c in cells_of(pa.concat_tables([events.select(cols), t.filter(pc.invert(keyed)).select(cols)])):
                yield from c.to_batches(max_chunksize=50_000)

    def by_entity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for c in cells_of(pa.Table.from_batches(held)):
                yield from c.rename_columns({"last": "last_us"}).to_batches(max_chunksize=50_000)

    cell = "entity string, kind string, n bigint, last bigint, total bigint"
    events = spread(src).mapInArrow(read, event)
    spot = F.when(F.col("id").isNull(), F.xxhash64("entity", "kind", "at", "total")).otherwise(F.xxhash64("id"))
    once = events.repartition(P, spot).mapInArrow(by_id, mixed)
    kept = once.repartition(P, F.when(F.col("idem").isNotNull(), F.xxhash64("idem")).otherwise(F.xxhash64("entity", "kind"))).mapInArrow(by_key, cell)
    return kept.repartition(P, "entity").mapInArrow(by_entity, "entity string, kind string, n bigint, last_us bigint, total bigint")


def feature_columns(cells: DataFrame, types: list[str]) -> DataFrame:
    """One row for each entity with arrays n, last_us and total, each in the order of ``types`` (0, null, 0 without events).

    ``types`` is the vocabulary of columns, hundreds at most; cells of other types are left out.
    """
    if len(types) > 10_000:
        raise ValueError("a feature table takes at most 10000 types")
    place = {k: i for i, k in enumerate(types)}
    cols = ["n", "last_us", "total"]

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        e = pc.dictionary_encode(t.column("entity")).combine_chunks()
        ki = np.array([place.get(k, -1) for k in t.column("kind").to_pylist()])
        for base in range(0, len(e.dictionary), BLOCK_ENTITIES):
            ei = e.indices.to_numpy() - base
            rows = np.flatnonzero((ei >= 0) & (ei < BLOCK_ENTITIES) & (ki >= 0))
            size = min(BLOCK_ENTITIES, len(e.dictionary) - base)
            last = pc.fill_null(t.column("last_us"), NEVER).to_numpy()
            dense = scatter(ei[rows] * len(types) + ki[rows], size * len(types), t.column("n").to_numpy()[rows], last[rows], t.column("total").to_numpy()[rows])
            offsets = pa.array(np.arange(size + 1, dtype=np.int32) * len(types))
            yield pa.RecordBatch.from_pydict(
                {"entity": e.dictionary.slice(base, size)} | {c: pa.ListArray.from_arrays(offsets, pa.array(v, mask=(v == NEVER) if c == "last_us" else None)) for c, v in zip(cols, dense, strict=True)}
            )

    return cells.repartition("entity").mapInArrow(wide, "entity string, n array<bigint>, last_us array<bigint>, total array<bigint>")
