"""Parent-child links to full hierarchies, by nested sets.

1. Rows are made one per id and placed by a locality key (a trace), hot keys split by id, into blocks of bounded size.
2. Each block works on the links inside it: subtree sizes go upward from the leaves, sibling preorder ranges are
   allocated downward by prefix sums, so that a node's descendants are the rows at [pre, pre + size). What stays
   unprocessed lies on a circle.
3. A block's tree whose root has its parent in another block becomes one vertex of a contracted graph, far smaller
   than the table. Pointer doubling gives each vertex its root, distance and the total size below it in as many rounds
   as the logarithm of the depth; vertices that stay unresolved reveal circles across blocks.
4. Every block adds what hangs from its nodes by prefix sums over the nested-set ranges and emits its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.runs import MAX_BLOCKS, pack, unpack
from memlake.plans.shared import freed_shuffles, quoted, width, written

ON_CIRCLE, BELOW_CIRCLE = -1, -2
#: What ids are trimmed of.
BLANKS = " \t\r\n\x0b\x0c\u00a0"
BLOCK_ROWS = 250_000
#: Above any number of nodes: sums around a circle, which count nodes again and again and are not used, stop here.
NO_COUNT = 1 << 42
_RAW = "00" * 17


def packed_id(c: Column) -> Column:
    """A canonical UUID as its 16 bytes, any other string as its own bytes behind 17 zero bytes."""
    uuid = c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(uuid, F.unhex(F.replace(c, F.lit("-"), F.lit("")))).otherwise(F.concat(F.unhex(F.lit(_RAW)), F.encode(c, "utf-8")))


def unpacked_id(c: Column) -> Column:
    h = F.lower(F.hex(c))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(c) == 16, F.concat_ws("-", *parts)).otherwise(F.decode(F.substring(c, 18, 1 << 30), "utf-8"))


def nested_sets(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pre, size, depth, top and circle flag of each node of a functional graph given by parent indices (-1: none).

    A circle is opened at its smallest node, which becomes the top of its component. ``top`` is a node index.
    """
    n = len(parent)
    par, size, circle = parent.copy(), np.ones(n, np.int64), np.zeros(n, bool)
    kids = np.bincount(par[par >= 0], minlength=n)
    levels: list[np.ndarray] = []

    def upward(front: np.ndarray) -> None:
        while len(front):
            levels.append(front)
            p = par[front]
            has = p >= 0
            front, p = front[has], p[has]
            np.add.at(size, p, size[front])
            np.subtract.at(kids, p, 1)
            p = np.unique(p)
            front = p[kids[p] == 0]

    upward(np.flatnonzero(kids == 0))
    circle[:] = True
    for f in levels:
        circle[f] = False
    left = np.flatnonzero(circle)
    if len(left):
        seen, tails = set(), []
        for v in left.tolist():
            if v not in seen:
                u = v
                while u not in seen:
                    seen.add(u)
                    u = int(par[u])
                tails.append(int(par[v]))
                par[v] = -1
        tails = np.unique(np.array(tails))
        kids[tails] -= 1
        upward(tails[kids[tails] == 0])
    by = np.argsort(par, kind="stable")
    before = np.cumsum(size[by]) - size[by]
    opens = np.ones(n, bool)
    opens[1:] = par[by][1:] != par[by][:-1]
    before -= np.repeat(before[opens], np.diff(np.append(np.flatnonzero(opens), n)))
    offset = np.empty(n, np.int64)
    offset[by] = before
    pre, depth, top = offset.copy(), np.zeros(n, np.int64), np.arange(n)
    for f in reversed(levels):
        f = f[par[f] >= 0]
        p = par[f]
        pre[f], depth[f], top[f] = pre[p] + 1 + offset[f], depth[p] + 1, top[p]
    return pre, size, depth, top, circle


def _blocks(nodes: DataFrame, place: list[Column], parts: int) -> DataFrame:
    """The written blocks: pid, nodes in preorder (id, depth, size, top, circle) and links to parents not in the block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, parents = t.column("id").combine_chunks(), t.column("parent").combine_chunks()
        at = pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy().astype(np.int64)
        pre, size, depth, top, circle = nested_sets(at)
        order = np.argsort(pre)
        rows = pa.table({"id": ids.take(pa.array(order)), "depth": depth[order].astype(np.int32), "size": size[order].astype(np.int32), "top": pre[top][order].astype(np.int32), "circle": circle[order]})
        out = np.flatnonzero((at < 0) & parents.is_valid().to_numpy(zero_copy_only=False))
        links = pa.table({"pre": pre[out].astype(np.int32), "size": size[out], "parent": parents.take(pa.array(out))})
        yield pa.RecordBatch.from_pydict({"pid": [TaskContext.get().partitionId()], "rows": [pack(rows)], "links": [pack(links)]}, schema=schema)

    schema = pa.schema([("pid", pa.int64()), ("rows", pa.binary()), ("links", pa.binary())])
    return written(nodes.repartition(parts, *place).select("id", "parent").mapInArrow(build, "pid bigint, rows binary, links binary"), "tree-blocks")


def _rows_of(blocks: DataFrame, tops: bool) -> DataFrame:
    """(id, loc, depth, top, circle) of all nodes, or of the tops alone; loc is pid * 2^32 + pre."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, blob in zip(b.column("pid").to_pylist(), b.column("rows"), strict=True):
                t = unpack(blob.as_buffer())
                top = t.column("top").to_numpy().astype(np.int64)
                pre = np.arange(len(top), dtype=np.int64)
                circle = t.column("circle").to_numpy()[top]
                t = pa.table({"id": t.column("id"), "loc": pre + (pid << 32), "depth": t.column("depth"), "top": top + (pid << 32), "circle": circle})
                yield from (t.filter(pa.array(pre == top)) if tops else t).to_batches(max_chunksize=50_000)

    return blocks.select("pid", "rows").mapInArrow(read, "id binary, loc bigint, depth int, top bigint, circle boolean")


def _links_of(blocks: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, blob in zip(b.column("pid").to_pylist(), b.column("links"), strict=True):
                t = unpack(blob.as_buffer())
                t = pa.table({"parent": t.column("parent"), "child": t.column("pre").to_numpy().astype(np.int64) + (pid << 32), "size": t.column("size")})
                yield from t.to_batches(max_chunksize=50_000)

    return blocks.select("pid", "links").mapInArrow(read, "parent binary, child bigint, size bigint")


def _resolved(edges: DataFrame) -> DataFrame:
    """(v, root, dist, acc, anc) for each contracted vertex by pointer doubling; anc is non-null where the way never ends."""
    inside = edges.select(F.col("child").alias("u"), F.lit(True).alias("in"))
    state = edges.join(inside, "u", "left").select(
        F.col("child").alias("v"),
        F.when(F.col("in"), F.col("u")).alias("anc"),
        F.when(F.col("in").isNull(), F.col("u")).alias("root"),
        F.col("w").alias("dist"),
        F.col("size").alias("acc"),
    )
    state, left, done, k = written(state, "tree-round"), None, None, 0
    while True:
        open_ = state.where("anc is not null").count()
        if open_ == left and done is None:
            # what is left leads to circles; trees that hang from those are at most that deep
            done, state = state.where("anc is null"), state.where("anc is not null")
        if not open_ or done is not None and 1 << k >= open_:
            return state if done is None else done.unionByName(state)
        left = open_
        gain = state.where("anc is not null").groupBy(F.col("anc").alias("v")).agg(F.sum("acc").alias("gain"))
        a = state.select(F.col("v").alias("anc"), F.col("anc").alias("anc2"), F.col("root").alias("root2"), F.col("dist").alias("dist2"))
        state = written(
            state.join(gain, "v", "left")
            .join(a, "anc", "left")
            .select("v", F.col("anc2").alias("anc"), F.coalesce("root", "root2").alias("root"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.least(F.col("acc") + F.coalesce("gain", F.lit(0)), F.lit(NO_COUNT)).alias("acc")),
            "tree-round",
        )
        k += 1


def _circles(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(v, on, total) for the unresolved vertices: whether v lies on a circle, and the size of the circle's component."""
    stuck = state.where("anc is not null").select("v")
    link = written(edges.join(stuck, edges.child == stuck.v, "left_semi").select(F.col("child").alias("v"), F.col("u").alias("anc"), F.col("u").alias("low"), "size"), "tree-circle")
    n = link.count()
    for _ in range(max(1, int(n).bit_length())):
        a = link.select(F.col("v").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        link = written(link.join(a, "anc").select("v", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), "size"), "tree-circle")
    rep = link.select(F.col("v").alias("anc"), F.col("low").alias("circle")).join(link, "anc").select("v", "anc", "circle", "size")
    total = rep.groupBy("circle").agg(F.sum("size").alias("total"))
    on = rep.select(F.col("anc").alias("v"), F.lit(True).alias("on")).distinct()
    return rep.join(total, "circle").join(on, "v", "left").select("v", F.coalesce("on", F.lit(False)).alias("on"), "total")


def _placed(df: DataFrame, id: str, parent: str, locality: str | None) -> tuple[DataFrame, DataFrame]:
    """The blocks, and the contracted edges between them: child and its size, parent's place p and steps w below its top u."""
    spark = df.sparkSession
    rows = df.count()
    parts = width(spark, rows, max(BLOCK_ROWS, rows // MAX_BLOCKS))
    norm = lambda c: F.lower(F.btrim(F.col(quoted(c)).cast("string"), F.lit(BLANKS)))
    src = df.select(
        packed_id(norm(id)).alias("id"),
        F.when(norm(parent) != "", packed_id(norm(parent))).alias("parent"),
        (F.xxhash64(quoted(locality)) if locality else F.lit(None).cast("bigint")).alias("near0"),
        (F.col(quoted(locality)).isNotNull() if locality else F.lit(False)).alias("has"),
        norm(id).alias("name"),
    ).where("name <> ''").select("id", "parent", F.when(F.col("has"), F.col("near0")).alias("near"))
    # no more than four for each block, of which there are MAX_BLOCKS at most or as many as the session's partitions
    hot = src.where("near is not null").groupBy("near").count().where(F.col("count") > max(1000, rows // (4 * parts))).select("near", F.lit(True).alias("hot"))
    nodes = src.groupBy("id").agg(F.max("parent").alias("parent"), F.max("near").alias("near")).join(F.broadcast(hot), "near", "left")
    split = F.when(F.col("near").isNull() | F.col("hot").isNotNull(), F.xxhash64("id")).otherwise(F.col("near"))
    blocks = _blocks(nodes, [split], parts)
    h = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(0x7EE), c))
    asked = _links_of(blocks)
    asked = asked.select(*[x.alias(f"h{i}") for i, x in enumerate(h("parent"))], "child", "size")
    there = _rows_of(blocks, tops=False)
    there = there.select(*[x.alias(f"h{i}") for i, x in enumerate(h("id"))], "loc", "depth", "top", "circle")
    edges = written(asked.join(there, ["h0", "h1"]).select("child", "size", F.col("loc").alias("p"), (F.col("depth") + 1).cast("bigint").alias("w"), F.col("top").alias("u"), F.col("circle").alias("below")), "tree-edges")
    return blocks, edges


def hierarchy(df: DataFrame, id: str, parent: str, locality: str | None = None) -> DataFrame:
    """(id, root_id, depth, n_descendants): one row for each distinct id.

    Ids and parent ids compare trimmed and lower-cased. If the rows of one id differ, a non-null parent wins (of
    several the greatest). A node without a parent, or whose parent is not in the table, is a root of depth 0 and its
    own root_id. A node on a circle (a node that is its own parent included) has root_id '' and depth -1, one that
    hangs below a circle '' and -2. ``n_descendants`` counts the distinct other nodes below; on a circle all others
    that lead to it. Rows with a null or blank id are ignored, a blank parent is none, repeated rows count once, an
    empty table gives no rows, further columns play no part. ``locality`` names a column that mostly agrees between
    child and parent; it only steers placement.
    """
    spark = df.sparkSession
    with freed_shuffles(spark):
        blocks, edges = _placed(df, id, parent, locality)
        state = _resolved(edges)
        stuck = state.where("anc is not null").limit(1).count() > 0
        none = spark.createDataFrame([], "v bigint, on boolean, total bigint")
        circles = written(_circles(edges, state), "tree-circles") if stuck else none
        ends = edges.where("below").select(F.col("u").alias("root"), F.lit(True).alias("below")).distinct()
        tops = _rows_of(blocks, tops=True).select(F.col("loc").alias("root"), F.col("id").alias("root_id"))
        known = state.join(circles, "v", "left").join(ends, "root", "left").join(tops, "root", "left")
        pid, pre = F.shiftrightunsigned("v", 32), F.col("v").bitwiseAND(0xFFFFFFFF)
        down = known.select(
            pid.alias("pid"),
            F.struct(
                F.lit(0).alias("what"),
                pre.alias("pre"),
                F.when(F.col("anc").isNotNull() | F.coalesce("below", F.lit(False)), BELOW_CIRCLE).otherwise(0).alias("state"),
                F.when(F.col("on"), F.col("total")).otherwise(F.col("dist")).alias("number"),
                F.col("root_id").alias("root"),
            ).alias("note"),
        )
        hung = edges.join(state.select(F.col("v").alias("child"), "acc"), "child").join(circles.select(F.col("v").alias("child"), "on"), "child", "left")
        # what hangs from one node comes as one note, however many children lie in other blocks
        sums = hung.groupBy("p").agg(F.min(F.when(F.col("on"), ON_CIRCLE).otherwise(0)).alias("state"), F.least(F.sum("acc"), F.lit(NO_COUNT)).alias("number"))
        up = sums.select(
            F.shiftrightunsigned("p", 32).alias("pid"),
            F.struct(F.lit(1).alias("what"), F.col("p").bitwiseAND(0xFFFFFFFF).alias("pre"), "state", "number", F.lit(None).cast("binary").alias("root")).alias("note"),
        )
        notes = written(down.union(up).groupBy("pid").agg(F.collect_list("note").alias("notes")), "tree-notes")
    final = blocks.select("pid", "rows").join(notes, "pid", "left").mapInArrow(_emit, "id binary, root binary, depth bigint, n_descendants bigint")
    return final.select(unpacked_id(F.col("id")).alias("id"), F.coalesce(unpacked_id(F.col("root")), F.lit("")).alias("root_id"), "depth", "n_descendants")


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            t = unpack(b.column("rows")[i].as_buffer())
            ids, n = t.column("id").combine_chunks(), t.num_rows
            depth, size, top = (t.column(c).to_numpy().astype(np.int64) for c in ("depth", "size", "top"))
            circle = t.column("circle").to_numpy().copy()
            hangs, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            root, add = top.copy(), np.zeros(n, np.int64)
            state, names, rings = np.where(circle[top], BELOW_CIRCLE, 0), pa.array([], pa.binary()), []
            if b.column("notes")[i].is_valid:
                notes = b.column("notes")[i].values
                what, pre, said, number = (notes.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("what", "pre", "state", "number"))
                hung, told = what == 1, what == 0
                np.add.at(hangs, pre[hung], number[hung])
                rings = pre[hung & (said == ON_CIRCLE)].tolist()
                state[pre[told]], add[pre[told]] = said[told], number[told]
                far = told & (said == 0) & notes.field("root").is_valid().to_numpy(zero_copy_only=False)
                coded = notes.field("root").filter(pa.array(far)).dictionary_encode()
                names = coded.dictionary
                root[pre[far]] = n + coded.indices.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(hangs)])
            here = np.arange(n)
            below = size - 1 + sums[here + size] - sums[here]
            total = below + 1
            below = np.where(circle, total[top] - 1, below)
            status, shift = state[top], add[top]
            where = root[top]
            for p in rings:
                up = _chain(size, top, p)
                circle[up] = True
                below[up] = add[top[p]] - 1
            depth = np.where(circle, ON_CIRCLE, np.where(status != 0, status, depth + shift))
            pool = pa.concat_arrays([ids, names])
            roots = pool.take(pa.array(where, mask=depth < 0))
            yield from pa.table({"id": ids, "root": roots, "depth": depth, "n_descendants": below}).to_batches(max_chunksize=50_000)


def paths(df: DataFrame, id: str, parent: str, locality: str | None = None) -> DataFrame:
    """(id, path): the ids from the root down to each id, itself last; null on and below circles.

    Ids, roots and repeats count as in ``hierarchy``. ``explode`` of all but the last element gives every pair of an
    ancestor and a descendant. A block knows the ways inside it from its nested sets; only the ways of trees that hang
    from another block are put together across blocks, by pointer doubling. The output grows with the depths' sum.
    """
    spark = df.sparkSession
    with freed_shuffles(spark):
        blocks, edges = _placed(df, id, parent, locality)
        asked = edges.select("p").distinct().groupBy(F.shiftrightunsigned("p", 32).alias("pid")).agg(F.collect_list(F.col("p").bitwiseAND(0xFFFFFFFF)).alias("asked"))
        ways = blocks.select("pid", "rows").join(asked, "pid").mapInArrow(_ways, "p bigint, way array<binary>")
        inside = edges.select(F.col("child").alias("u"), F.lit(True).alias("in"))
        own = edges.select(F.col("child").alias("v"), "u", "p", "below").join(inside, "u", "left")
        state = own.join(ways, "p").select("v", F.when(F.col("in"), F.col("u")).alias("anc"), "way", F.coalesce("below", F.lit(False)).alias("lost"))
        state, left = written(state, "tree-ways"), None
        while (open_ := state.where("anc is not null").count()) and open_ != left:
            left = open_
            a = state.select(F.col("v").alias("anc"), F.col("anc").alias("anc2"), F.col("way").alias("way2"), F.col("lost").alias("lost2"))
            state = written(
                state.join(a, "anc", "left").select("v", F.col("anc2").alias("anc"), F.when(F.col("way2").isNull(), F.col("way")).otherwise(F.concat("way2", "way")).alias("way"), (F.col("lost") | F.coalesce("lost2", F.lit(False))).alias("lost")),
                "tree-ways",
            )
        heads = state.select(F.shiftrightunsigned("v", 32).alias("pid"), F.struct(F.col("v").bitwiseAND(0xFFFFFFFF).alias("pre"), F.when(F.col("anc").isNull() & ~F.col("lost"), F.col("way")).alias("way")).alias("head"))
        heads = written(heads.groupBy("pid").agg(F.collect_list("head").alias("heads")), "tree-heads")
    out = blocks.select("pid", "rows").join(heads, "pid", "left").mapInArrow(_emit_paths, "id binary, path array<binary>")
    return out.select(unpacked_id(F.col("id")).alias("id"), F.transform("path", unpacked_id).alias("path"))


def _chain(size: np.ndarray, top: np.ndarray, p: int) -> np.ndarray:
    """Preorder places from the top of p's tree down to p: the rows whose nested-set range holds p."""
    up = np.arange(top[p], p + 1)
    return up[up + size[up] > p]


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for pid, blob, asked in zip(b.column("pid").to_pylist(), b.column("rows"), b.column("asked"), strict=True):
            t = unpack(blob.as_buffer())
            ids, size, top = t.column("id").combine_chunks(), t.column("size").to_numpy().astype(np.int64), t.column("top").to_numpy().astype(np.int64)
            pre = asked.values.to_numpy()
            for a in range(0, len(pre), 5_000):
                chains = [_chain(size, top, p) for p in pre[a : a + 5_000].tolist()]
                ends = np.cumsum([0, *map(len, chains)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"p": pre[a : a + 5_000] + (pid << 32), "way": pa.ListArray.from_arrays(ends, ids.take(pa.array(np.concatenate(chains))))})


def _emit_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            t = unpack(b.column("rows")[i].as_buffer())
            ids, top, circle = t.column("id").to_pylist(), t.column("top").to_numpy(), t.column("circle").to_numpy()
            depth = t.column("depth").to_numpy()
            heads = {x["pre"]: x["way"] for x in b.column("heads")[i].as_py() or []}
            names, out, way = [], [], []
            for k, node in enumerate(ids):  # preorder: the way to a node is the last way cut to its depth
                way = [*way[: depth[k]], node]
                head = heads.get(int(top[k]), [])
                names.append(node)
                out.append(None if circle[top[k]] or head is None else [*head, *way])
                if len(names) == 5_000:
                    yield pa.RecordBatch.from_pydict({"id": pa.array(names, pa.binary()), "path": pa.array(out, pa.list_(pa.binary()))})
                    names, out = [], []
            if names:
                yield pa.RecordBatch.from_pydict({"id": pa.array(names, pa.binary()), "path": pa.array(out, pa.list_(pa.binary()))})


def descendants(df: DataFrame, id: str, parent: str, locality: str | None = None) -> DataFrame:
    """(id, descendant, steps): every pair of a node and a distinct other one below it, with the steps between them.

    Read off the paths, so nodes on and below circles have no rows; ids and repeats count as in ``hierarchy``. One row
    for each pair is the result itself: its size is the sum of all depths.
    """
    way = paths(df, id, parent, locality).where(F.size("path") > 1)
    above = way.select(F.col("id").alias("descendant"), F.posexplode(F.slice(F.reverse("path"), 2, 1 << 30)).alias("step", "id"))
    return above.select("id", "descendant", (F.col("step") + 1).cast("bigint").alias("steps"))
