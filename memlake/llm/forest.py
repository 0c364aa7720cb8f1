"""Most similar vectors for every vector: a forest of hash prefixes.

Each tree gives a vector a long hash string: one cross-polytope symbol of a random projection to up to 64 dimensions,
then symbols of projections to 8 dimensions, then bytes of the row's key, so that even equal vectors differ at last. A
tree is its strings in sorted order, spread over range partitions whose bounds come from a bounded sample and snap to
short prefixes. A vector's longest prefix matches are its neighbours in the sorted array; it ascends from there to the
range of siblings around it, of at most ``leaf`` vectors, and on to the ranges before and behind that it shares a prefix
with, so that no vector ends at the edge of a range. All trees ascend to the same number of candidates. Ranges, and
neighbouring ranges, are compared as one matrix product each, which serves both. Trees run in waves; after each wave only
the k best of every vector are kept, and the wave's shuffle is freed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.shared import freed_shuffles, quoted, spread, width, written

SYMBOLS, KEY_BYTES, HEAD_DIMS, TAIL_DIMS = 10, 6, 64, 8
#: Least and most vectors of the sample that bounds come from, and for each bound; vectors of one range partition;
#: candidates of one range.
SAMPLE, SAMPLE_EACH, PART_ROWS, LEAF = (4_000, 200_000), 40, 40_000, 768
#: Pairs of one partition while the best of each vector are picked.
PAIR_ROWS = 2_000_000
#: Trees at TREES_AT vectors or fewer; their number grows as the vectors to the power GROWTH, which keeps recall level.
TREES, TREES_AT, GROWTH, WAVE = 11, 1 << 19, 0.2, 2


def usable(column: pa.Array, dim: int) -> np.ndarray:
    """Which lists have exactly ``dim`` numbers, all finite and not all zero."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    ok = sizes == dim
    if ok.any():
        x = pc.list_flatten(column.filter(pa.array(ok))).to_numpy(zero_copy_only=False).reshape(-1, dim)
        ok[ok] = np.isfinite(x).all(1) & (x != 0).any(1)
    return ok


def quantised(x: np.ndarray) -> np.ndarray:
    """Directions as 16-bit integers, each vector scaled to its largest component; cosines change by some 1e-5."""
    return np.rint(x / np.abs(x).max(1, keepdims=True) * 32767.0).astype(np.int16)


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def projections(dim: int, tree: int, seed: int) -> np.ndarray:
    """The random directions of one tree, orthogonal within each symbol."""
    rng = np.random.default_rng([seed, tree])
    blocks = [min(dim, HEAD_DIMS)] + [min(dim, TAIL_DIMS)] * (SYMBOLS - 1)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, d)))[0] for d in blocks]).astype(np.float32)


def hash_strings(x: np.ndarray, keys: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A string of SYMBOLS + KEY_BYTES bytes for each vector."""
    y, dim = x @ directions, x.shape[1]
    out, at = np.empty((len(x), SYMBOLS + KEY_BYTES), np.uint8), 0
    rows = np.arange(len(x))
    for s in range(SYMBOLS):
        d = min(dim, TAIL_DIMS if s else HEAD_DIMS)
        part = y[:, at : at + d]
        i = np.abs(part).argmax(1)
        out[:, s] = 2 * i + (part[rows, i] < 0)
        at += d
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out[:, SYMBOLS:] = mixed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return out


def as_words(strings: np.ndarray) -> np.ndarray:
    """Byte strings as fixed-width values that sort alike."""
    return np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel()


def lcp(sorted_: np.ndarray) -> np.ndarray:
    """Common prefix length of each sorted string with the one before it."""
    differ = sorted_[1:] != sorted_[:-1]
    return np.where(differ.any(1), differ.argmax(1), sorted_.shape[1])


def range_bounds(sample: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 bounds near the sample's quantiles, each moved to the shortest prefix close by."""
    s = sample[np.lexsort(sample.T[::-1])]
    common, out = lcp(s), []
    for q in range(1, parts):
        mid, reach = q * len(s) // parts, max(1, len(s) // (4 * parts))
        a, b = max(1, mid - reach), min(len(s) - 1, mid + reach)
        if a > b:
            continue
        i = a + int(np.lexsort((np.abs(np.arange(a, b + 1) - mid), common[a - 1 : b]))[0])
        bound = np.zeros(s.shape[1], np.uint8)
        bound[: common[i - 1] + 1] = s[i][: common[i - 1] + 1]
        out.append(bound)
    return np.array(out, np.uint8).reshape(-1, s.shape[1])


def ranges(common: np.ndarray, n: int, leaf: int) -> Iterator[tuple[int, int]]:
    """Runs of sibling prefixes with at most ``leaf`` of n sorted strings each, all as deep as that takes."""
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= leaf:
            yield a, b
            continue
        cuts = np.flatnonzero(common[a : b - 1] <= depth) + a + 1
        if not len(cuts):
            if depth < SYMBOLS + KEY_BYTES:
                stack.append((a, b, depth + 1))
            else:
                yield from ((x, min(b, x + leaf)) for x in range(a, b, leaf))
            continue
        goal = (b - a) / math.ceil((b - a) / leaf)
        edges, start = [a, *cuts.tolist(), b], a
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y - start > leaf and x > start or x - start >= goal * 0.95:
                if x > start:
                    stack.append((start, x, depth + 1))
                start = x
        stack.append((start, b, depth + 1))


def best_of(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best distinct partners of each a, by similarity, then by key."""
    order = np.lexsort((b, -sim, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    order, a = order[first], a[first]
    heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
    return order[rank < k]


def most_similar(x: np.ndarray, y: np.ndarray, k: int, least: float, same: bool) -> tuple[tuple, tuple]:
    """(row, column, similarity) of the pairs of at least ``least`` between two sets of vectors, among them the k best of
    each row; and, unless both are the ``same``, (column, row, similarity) with the k best of each column."""
    s = x @ y.T
    if same:
        np.fill_diagonal(s, -2)
    if least > -1:
        i, j = np.divmod(np.flatnonzero(s.ravel() >= least), len(y))
        return (i, j, s[i, j]), (j, i, s[i, j])

    def best(t: np.ndarray) -> tuple:
        m = min(k, t.shape[1] - same)
        j = np.argpartition(t, t.shape[1] - m, axis=1)[:, t.shape[1] - m :].ravel() if m > 0 else np.zeros(0, np.int64)
        i = np.repeat(np.arange(len(t)), max(m, 0))
        return i, j, t[i, j]

    return best(s), (None if same else best(np.ascontiguousarray(s.T)))


def neighbours(leaves: list[np.ndarray], vectors: list[np.ndarray], near: list[bool], k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, other key, similarity): for each range in turn the k best of every vector, among its own range and those
    next to it; ``near`` tells of each range but the last whether it shares a prefix with the next."""
    held: list[tuple] = []
    for n, (keys, x) in enumerate(zip(leaves, vectors, strict=True)):
        i, j, sim = most_similar(x, x, k, least, True)[0]
        mine, held = [*held, (keys[i], keys[j], sim)], []
        if n + 1 < len(leaves) and near[n]:
            (i, j, sim), (p, q, back) = most_similar(x, vectors[n + 1], k, least, False)
            mine.append((keys[i], leaves[n + 1][j], sim))
            held = [(leaves[n + 1][p], keys[q], back)]
        a, b, sim = (np.concatenate(c) for c in zip(*mine, strict=True))
        pick = best_of(a, b, sim, k) if len(a) else np.zeros(0, np.int64)
        yield a[pick], b[pick], sim[pick]


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float32())])


def nearest(df: DataFrame, id: str, embedding: str, dim: int, k: int = 10, least: float = -1.0, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """(id, other, similarity): for each id with a usable vector its k most similar others of cosine >= ``least``.

    Usable: exactly ``dim`` numbers, all finite, not all zero, no nulls. Rows with a null id or an unusable vector are
    ignored; rows of one id count once (the greatest vector, if copies differ). Equal similarities go by the smaller
    internal key, so among more than k equal ones k stand for all. The search is approximate; the number of ``trees``
    grows with the collection to keep recall level. An empty table gives no rows; further columns play no part.
    """
    spark = df.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("id").is_valid())
            ok = usable(b.column("v"), dim)
            if ok.any():
                b = b.filter(pa.array(ok))
                q = quantised(pc.list_flatten(b.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64))
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": pa.array(list(q.view(f"V{2 * dim}").ravel().tolist()), pa.binary())})

    src = df.select(F.col(quoted(id)).cast("string").alias("id"), F.col(quoted(embedding)).cast("array<double>").alias("v"))
    one = spread(src).mapInArrow(read, "id string, v binary").groupBy("id").agg(F.max("v").alias("v"))
    points = written(one.select(F.monotonically_increasing_id().alias("key"), "id", "v"), "forest-points")
    n = points.count()
    count = math.ceil(trees * max(1.0, n / TREES_AT) ** GROWTH) if n > leaf else 1
    parts = max(1, round(n / PART_ROWS))
    size = min(max(SAMPLE[0], SAMPLE_EACH * parts), SAMPLE[1])
    drawn = points.select("key", "v").sample(min(1.0, size / n), seed=seed).collect() if parts > 1 else []
    sq = unit(np.frombuffer(b"".join(r.v for r in drawn), np.int16).reshape(-1, dim)) if drawn else np.zeros((0, dim), np.float32)
    skeys = np.array([r.key for r in drawn], np.int64)
    best = None
    with freed_shuffles(spark):
        for start in range(0, count, WAVE):
            wave = range(start, min(count, start + WAVE))
            found = _wave(points, dim, k, least, leaf, seed, wave, parts, {t: range_bounds(hash_strings(sq, skeys, projections(dim, t, seed)), parts) if drawn else None for t in wave})
            best = written(_kept(found if best is None else best.union(found), k, width(spark, n * k * (WAVE + 1), PAIR_ROWS)), "forest-best")
    names = points.select("key", "id")
    named = best.join(names.select(F.col("key").alias("a"), F.col("id").alias("id")), "a").join(names.select(F.col("key").alias("b"), F.col("id").alias("other")), "b")
    return named.select("id", "other", F.col("sim").cast("double").alias("similarity"))


def _kept(pairs: DataFrame, k: int, parts: int) -> DataFrame:
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            pick = best_of(*(t.column(c).to_numpy() for c in ("a", "b", "sim")), k)
            yield from t.take(pa.array(pick)).to_batches(max_chunksize=100_000)

    return pairs.repartition(parts, "a").mapInArrow(top, "a bigint, b bigint, sim float")


def _wave(points: DataFrame, dim: int, k: int, least: float, leaf: int, seed: int, wave: range, parts: int, bounds: dict) -> DataFrame:
    row = np.dtype([("h", np.uint8, (SYMBOLS + KEY_BYTES,)), ("key", np.int64), ("v", np.int16, (dim,))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = {t: projections(dim, t, seed) for t in wave}
        limits = {t: as_words(bounds[t]) if bounds[t] is not None and len(bounds[t]) else None for t in wave}

        def flush(held: list) -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([b.column("key").to_numpy() for b in held])
            q = np.frombuffer(b"".join(v for b in held for v in b.column("v").to_pylist()), np.int16).reshape(-1, dim)
            x = unit(q)
            out = {"part": [], "rows": []}
            for t in wave:
                rec = np.empty(len(keys), row)
                rec["h"], rec["key"], rec["v"] = hash_strings(x, keys, directions[t]), keys, q
                part = np.searchsorted(limits[t], as_words(rec["h"]), side="right") if limits[t] is not None else np.zeros(len(keys), np.int64)
                order = np.argsort(part, kind="stable")
                for p, chunk in zip(*_grouped(part[order], rec[order]), strict=True):
                    out["part"].append((t - wave[0]) * parts + p)
                    out["rows"].append(chunk.tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("rows", pa.binary())]))

        held, m = [], 0
        for b in batches:
            held.append(b)
            m += b.num_rows
            if m >= 50_000:
                yield from flush(held)
                held, m = [], 0
        if m:
            yield from flush(held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for b in batches for x in b.column("rows").to_pylist()]
        if not held:
            return
        rec = np.frombuffer(b"".join(held), row)
        del held
        order = np.argsort(as_words(rec["h"]), kind="stable")
        common = lcp(rec["h"][order])
        cut = sorted(ranges(common, len(order), leaf))
        own = [rec[order[a:b]] for a, b in cut]
        near = [bool(common[b - 1] > 0) for _, b in cut[:-1]]
        for left, right, sim in neighbours([o["key"] for o in own], Units(own), near, k, least):
            if len(left):
                yield pa.RecordBatch.from_pydict({"a": left, "b": right, "sim": sim}, schema=PAIR)

    placed = points.select("key", "v").mapInArrow(spread, "part int, rows binary").repartitionById(len(wave) * parts, "part")
    return placed.select("rows").mapInArrow(search, "a bigint, b bigint, sim float")


class Units:
    """The unit vectors of ranges of records, made as they are asked for; the last two are remembered."""

    def __init__(self, own: list[np.ndarray]):
        self.own, self.made = own, {}

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, n: int) -> np.ndarray:
        if n not in self.made:
            self.made = {k: v for k, v in self.made.items() if k == n - 1} | {n: unit(self.own[n]["v"])}
        return self.made[n]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[n] for n in range(len(self)))


def _grouped(part: np.ndarray, rec: np.ndarray) -> tuple[list, list]:
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[heads].tolist(), np.split(rec, heads[1:])


def similar_pairs(df: DataFrame, id: str, embedding: str, dim: int, k: int = 10, least: float = 0.85, **settings) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of cosine >= ``least`` of which one is among the k nearest of the other."""
    n = nearest(df, id, embedding, dim, k, least, **settings)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
