"""Temporal knowledge graph: edges in time, neighbourhoods, centrality, components, paths, triples.

Iterative operators write each round's small state to the shared folder instead of keeping an ever longer plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalars import uuid5_text
from memlake.plans.runs import numbered
from memlake.plans.shared import freed_shuffles, shared_dir, written

#: Verbs that make a relation by themselves, and those that need a following preposition (fixed values).
VERBS = "likes is are has have uses knows owns prefers loves hates wants plays teaches visited met speaks joined manages leads drives founded created wrote enjoys dislikes needs avoids".split()
COMPOUND_VERBS, PREPOSITIONS = "works lives moved born based studied studies traveled".split(), "at in to from".split()


def held_at(at: Column) -> Column:
    """Edges that hold at an instant: a null start is since ever, a null end open, half-open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def once(edges: DataFrame) -> DataFrame:
    """Edges of one id once: the greatest by all columns."""
    rest = [c for c in edges.columns if c != "id"]
    return edges.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*").select(*edges.columns)


def functional_links(edges: DataFrame) -> DataFrame:
    """Links of which one (tenant, src, relation) has one at a time: each is closed by the next, which invalidates it."""
    w = Window.partitionBy("tenant_id", "src", "relation").orderBy("valid_from", "id")
    nxt = F.lead("valid_from").over(w)
    return edges.withColumn("invalidated_by", F.lead("id").over(w)).withColumn("valid_to", nxt).withColumn("state", F.when(nxt.isNull(), "active").otherwise("superseded"))


def neighbours(edges: DataFrame, tenant: str, entity: str, limit: int, at: Column | None = None, active_only: bool = False) -> DataFrame:
    """Edges that touch an entity by weight, superseded ones included unless ``active_only`` or an instant is given."""
    out = edges.filter((F.col("tenant_id") == tenant) & ((F.col("src") == entity) | (F.col("dst") == entity)))
    out = out.filter(held_at(at)) if at is not None else out
    out = out.filter("state = 'active'") if active_only else out
    return out.orderBy(F.desc("weight"), "id").limit(limit)


def snapshot(edges: DataFrame, at: Column | None = None) -> DataFrame:
    """(tenant_id, src, dst, weight) of the active graph or of the graph at an instant."""
    live = edges.filter("state = 'active'") if at is None else edges.filter(held_at(at))
    return live.select("tenant_id", "src", "dst", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree), parallel edges counted, from one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 40) -> DataFrame:
    """(node, pagerank): weight-biased, weights <= 0 count 1, dangling rank spread over all nodes; the ranks sum to 1.

    A hub's incoming shares are pre-aggregated on the map side; each round moves one row for each edge.
    """
    with freed_shuffles(edges.sparkSession):
        e = edges.groupBy("src", "dst").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).alias("w"))
        out = e.groupBy("src").agg(F.sum("w").alias("total"))
        e = written(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "rank-edges")
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        nodes = written(nodes.join(e.select(F.col("src").alias("node"), F.lit(True).alias("leads")).distinct(), "node", "left"), "rank-nodes")
        n = nodes.count()
        if not n:
            return nodes.select("node", F.lit(0.0).alias("pagerank"))
        rank = nodes.select("node", "leads", F.lit(1.0 / n).alias("r"))
        for i in range(rounds):
            stuck = rank.filter("leads is null").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("d")).first().d
            got = e.join(rank.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("r")).alias("g"))
            new = nodes.join(got, "node", "left").select("node", "leads", (F.lit((1 - damping) / n + damping * stuck / n) + damping * F.coalesce("g", F.lit(0.0))).alias("r"))
            rank = written(new, "rank-round")
        return rank.select("node", F.col("r").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the undirected graph, named by their smallest node.

    Alternating large and small stars: every round links each node's neighbours to the smallest one it knows, so long
    chains shrink in logarithmically many rounds.
    """
    with freed_shuffles(edges.sparkSession):
        own = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a is not null and b is not null")
        nodes = own.select(F.col("a").alias("node")).union(own.select("b")).distinct()
        links = written(own.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
        before = None
        while True:
            both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
            large = written(large, "star")
            low = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            m = low.groupBy("u").agg(F.min("v").alias("m"))
            small = low.join(m, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
            links = written(small, "star")
            state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if state == before:
                break
            before = state
        label = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
        return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def communities(edges: DataFrame) -> DataFrame:
    """(component, size, place, node): the members of each component in order; places from 0 by size, then first node.

    One row for each member, so that no row grows with its component."""
    own = written(components(edges), "components")
    size = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = numbered(size, [], [F.desc("size"), F.col("component")], "place").withColumn("place", F.col("place") - 1)
    return own.join(placed, "component").select("component", "size", "place", "node")


def shortest_path(edges: DataFrame, src: str, dst: str) -> list[str] | None:
    """The nodes of a shortest directed path, the smallest predecessor on ties; [src] for src = dst, even if it is not in
    the graph; None without one. A round for each step, whatever their number; each round keeps its new nodes alone."""
    if src == dst:
        return [src]
    spark = edges.sparkSession
    with freed_shuffles(spark):
        e = written(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "path-edges")
        base = f"{shared_dir(spark)}/memlake-reached-{uuid.uuid4().hex}"
        kinds = "node string, before string"
        at = lambda hop: f"{base}/hop={hop}"
        spark.createDataFrame([(src, None)], kinds).coalesce(1).write.parquet(at(0))
        hop = 0
        while True:
            seen = spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(base)
            front = spark.read.schema(kinds).parquet(at(hop)).select(F.col("node").alias("src"))
            step = e.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("before")).join(seen.select("node"), "node", "left_anti")
            hop += 1
            step.write.parquet(at(hop))
            found = spark.read.schema(kinds).parquet(at(hop)).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == dst).alias("there")).first()
            if not found.n:
                return None
            if found.there:
                break
        path = [dst]
        for h in range(hop, 0, -1):
            path.append(spark.read.schema(kinds).parquet(at(h)).filter(F.col("node") == path[-1]).first().before)
        return path[::-1]


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges with new ones added; an id that is there already, or comes again, changes nothing."""
    rest = [c for c in new.columns if c != "id"]
    once_ = new.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*").select(*new.columns)
    return edges.unionByName(once_.join(edges.select("id"), "id", "left_anti"))


def listed_edges(edges: DataFrame, tenant: str, limit: int | None = None, all_states: bool = False) -> DataFrame:
    """A tenant's active edges by weight, or all of them by start."""
    own = edges.filter(F.col("tenant_id") == tenant)
    own = own.orderBy("valid_from", "id") if all_states else own.filter("state = 'active'").orderBy(F.desc("weight"), "id")
    return own if limit is None else own.limit(limit)


def linked(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edges after functional links (id, tenant_id, src, relation, dst, weight, valid_from): each closes the active
    edges of its (tenant, src, relation), or the link of the batch before it, and names itself as the cause."""
    key = ["tenant_id", "src", "relation"]
    w = Window.partitionBy(*key).orderBy("valid_from", "id")
    made = new.withColumn("__next", F.lead("id").over(w)).withColumn("__until", F.lead("valid_from").over(w))
    first = made.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min_by(F.struct("id", "valid_from"), F.struct("valid_from", "id")).alias("__f"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    hit = (F.col("state") == "active") & F.col("__f").isNotNull()
    old = edges.join(first, on, "left").withColumns({"valid_to": F.when(hit, F.col("__f.valid_from")).otherwise(F.col("valid_to")), "invalidated_by": F.when(hit, F.col("__f.id")).otherwise(F.col("invalidated_by")), "state": F.when(hit, "superseded").otherwise(F.col("state"))})
    add = made.withColumns({"valid_to": F.col("__until"), "invalidated_by": F.col("__next"), "state": F.when(F.col("__next").isNull(), "active").otherwise("superseded"), "created_at": F.col("valid_from")})
    cols = edges.columns
    return old.select(*cols).unionByName(add.select(*[(F.col(c) if c in add.columns else F.lit(None)).cast(edges.schema[c].dataType).alias(c) for c in cols]))


def subgraph(edges: DataFrame, tenant: str, entity: str, depth: int, max_edges: int) -> DataFrame:
    """Edges within ``depth`` undirected hops of an entity, each once, nearest first, then by weight, up to ``max_edges``."""
    own = edges.filter(F.col("tenant_id") == tenant)
    front = edges.sparkSession.createDataFrame([(entity,)], "node string")
    seen, found = front, None
    with freed_shuffles(edges.sparkSession):
        for hop in range(1, max(1, depth) + 1):
            a = own.join(front, own.src == front.node, "left_semi")
            b = own.join(front, own.dst == front.node, "left_semi")
            new = a.union(b).dropDuplicates(["id"])
            if found is not None:
                new = new.join(found.select("id"), "id", "left_anti").select(*edges.columns)
            new = written(new.withColumn("hop", F.lit(hop)), "subgraph")
            found = new if found is None else found.unionByName(new)
            nodes = new.select(F.col("src").alias("node")).union(new.select("dst")).distinct()
            front = written(nodes.join(seen, "node", "left_anti"), "subgraph-front")
            seen = seen.union(front)
    return found.orderBy("hop", F.desc("weight"), "id").limit(max_edges)


def triples(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, subject, relation, object) of simple statements: sentences cut at . newline ; ! ?, one triple for each verb
    with words before and behind it; some verbs take their preposition along."""
    sentence = df.select(F.col(id).alias("id"), F.explode(F.split(F.col(text), r"[.\n;!?]")).alias("s"))
    w = sentence.select("id", F.filter(F.split(F.col("s"), r"(?U)\s+"), lambda x: x != "").alias("w")).filter(F.size("w") >= 3)
    p = w.select("id", "w", F.posexplode("w").alias("i", "x")).filter((F.col("i") > 0) & (F.col("i") + 1 < F.size("w")))
    verb, nxt = F.lower("x"), F.lower(F.element_at("w", F.col("i") + 2))
    compound = (verb.isin(COMPOUND_VERBS) & nxt.isin(PREPOSITIONS)) | ((verb == "married") & (nxt == "to"))
    rel = F.when(verb.isin(VERBS), verb).when(compound, F.concat_ws("_", verb, nxt))
    start = F.when(verb.isin(VERBS), F.col("i") + 2).otherwise(F.col("i") + 3)
    out = p.withColumn("relation", rel).filter("relation is not null").select(
        "id", F.array_join(F.slice("w", F.lit(1), F.col("i")), " ").alias("subject"), "relation", F.array_join(F.slice("w", start, F.size("w")), " ").alias("object")
    )
    return out.filter("object <> ''")


def triple_lines(text: Column) -> Column:
    """array<struct(subject, relation, object)> of lines ``a | r | b``; other lines are left out."""
    parts = F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(line, r"\|"), lambda x: F.trim(x)))
    good = F.filter(parts, lambda p: (F.size(p) == 3) & F.forall(p, lambda x: x != ""))
    return F.transform(good, lambda p: F.struct(p[0].alias("subject"), p[1].alias("relation"), p[2].alias("object")))


def auto_graph(mem: DataFrame) -> DataFrame:
    """Edges from the contents of active memories, with ids that depend on memory and triple alone."""
    act = mem.filter("state = 'active'")
    t = triples(act, "id", "content").distinct()
    name = F.concat_ws("|", "subject", "relation", "object")
    return t.select(uuid5_text(F.col("id"), name).alias("id"), F.col("subject").alias("src"), "relation", F.col("object").alias("dst"), F.col("id").alias("source_memory_id"))
