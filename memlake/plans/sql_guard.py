"""The SQL front door: read-only guard, tenant sessions, virtual tables, dialect shim, row cap and time limit.

A statement is parsed by Spark itself and its plan walked before anything is analysed; whatever is not a plain query over
the allowed names is refused. A tenant's statement then runs in a session of its own that only knows that tenant's views.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.plans.results import register_functions

#: Functions that no user statement may call, in table or scalar position (fixed values first, then Spark's own).
FORBIDDEN = frozenset(
    "read_text read_blob read_csv read_csv_auto read_json read_json_auto read_json_objects read_ndjson read_ndjson_auto read_ndjson_objects "
    "read_parquet read_xlsx parquet_scan parquet_metadata parquet_schema parquet_file_metadata parquet_kv_metadata csv_sniff sniff_csv glob "
    "reflect java_method try_reflect read_files python_worker_logs input_file_name read_kafka".split()
)
#: Groups of built-in functions that statements may call; of the rest only PLAIN. What no registry knows is refused.
FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs "
    "map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split()
)
PLAIN = frozenset("typeof uuid equal_null".split())
#: Table functions that statements may call.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Plan nodes of plain queries; anything else fails closed.
ALLOWED_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedRelation UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedHaving UnresolvedInlineTable OneRowRelation Union Intersect Except Window WithWindowDefinition Generate LateralJoin "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases Pivot UnresolvedPivot Unpivot UnresolvedHint Sample Repartition RepartitionByExpression "
    "GroupingSets Expand LocalRelation Range UnresolvedOrderedSet UnionLoop CTERelationDef CTERelationRef ResolvedInlineTable AliasedRelation UnresolvedTable Hint "
    "UnresolvedTableSpec LogicalRelation SortByOrdinal Tail".split()
) - {"UnresolvedTable", "UnresolvedTableSpec", "LogicalRelation", "SortByOrdinal"}


class Refused(ValueError):
    """A statement that the guard doesn't let through."""


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _plans(plan):
    """All nodes of a parsed plan, those of common table expressions and subqueries included."""
    yield plan
    for child in _seq(plan.children()) + _seq(plan.innerChildren()):
        if hasattr(child, "children") and "LogicalPlan" in _kinds(child):
            yield from _plans(child)
    for e in _seq(plan.expressions()):
        yield from _inner(e)


def _kinds(x) -> str:
    c, out = x.getClass(), []
    while c is not None:
        out.append(c.getSimpleName())
        c = c.getSuperclass()
    return " ".join(out)


def _inner(e):
    if "SubqueryExpression" in _kinds(e):
        yield from _plans(e.plan())
    for c in _seq(e.children()):
        yield from _inner(c)


def _functions(e):
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        yield _seq(e.nameParts())
    for c in _seq(e.children()):
        yield from _functions(c)


def allowed(spark: SparkSession, name: str, own: frozenset[str] = frozenset()) -> bool:
    """Whether a statement may call a function: one of ``own``, or a built-in of an allowed group."""
    n = name.lower()
    if n in own or n in PLAIN:
        return n not in FORBIDDEN
    jvm = spark._jvm
    known = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(n))
    return n not in FORBIDDEN and known.isDefined() and known.get().getGroup() in FUNCTION_GROUPS


def parse(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as x:
        raise Refused(f"not a statement: {str(x).splitlines()[0]}") from None


def inspect(spark: SparkSession, sql: str, own: frozenset[str] = frozenset()) -> tuple[set[str], set[str]]:
    """The relations (lower-cased) and table functions of a plain query; refuses everything else. ``own`` names
    registered functions that may be called beside the built-in ones."""
    if not sql.strip().rstrip(";").strip():
        raise Refused("empty statement")
    tables, tvfs, ctes = set(), set(), set()
    for p in _plans(parse(spark, sql)):
        kind = p.getClass().getSimpleName()
        if kind not in ALLOWED_NODES:
            raise Refused(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            ctes |= {r._1().lower() for r in _seq(p.cteRelations())}
        if kind == "UnresolvedRelation":
            parts = _seq(p.multipartIdentifier())
            if len(parts) != 1:
                raise Refused(f"qualified name {'.'.join(parts)}")
            tables.add(parts[0].lower())
        if kind == "UnresolvedTableValuedFunction":
            tvfs.add(".".join(_seq(p.name())).lower())
        for e in _seq(p.expressions()):
            for name in _functions(e):
                if len(name) != 1 or not allowed(spark, name[0], own):
                    raise Refused(f"function {'.'.join(name)} is not allowed")
    if bad := tvfs - TABLE_FUNCTIONS:
        raise Refused(f"function {sorted(bad)[0]} is not allowed")
    return tables - ctes, tvfs


def dialect(sql: str) -> str:
    """The few spellings of the other dialect that documents and dashboards use: ``->>``, VARCHAR and TIMESTAMPTZ casts,
    EXTRACT(EPOCH FROM x). Quoted text is left alone."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.S)
    for i in range(0, len(parts), 2):
        s = re.sub(r"::\s*(VARCHAR|TEXT)\b", "::STRING", parts[i], flags=re.I)
        s = re.sub(r"::\s*TIMESTAMPTZ\b", "::TIMESTAMP", s, flags=re.I)
        s = re.sub(r"\bAS\s+VARCHAR\b(?!\s*\()", "AS STRING", s, flags=re.I)
        parts[i] = re.sub(r"\bEXTRACT\s*\(\s*EPOCH\s+FROM\s+([^()]+|\([^()]*\)|[^()]*\([^()]*\)[^()]*)\)", r"(unix_micros(cast(\1 as timestamp)) / 1e6)", s, flags=re.I)
    out = ""
    for i, p in enumerate(parts):
        if i % 2 and p.startswith("'") and (m := re.search(r"([\w.`]+(?:\([^()]*\))?)\s*->>\s*$", out)):
            path = p[1:-1]
            out = out[: m.start()] + f"get_json_object({m.group(1)}, '{path if path.startswith('$') else '$.' + path}')"
        else:
            out += p
    return out


_STRING = r"'((?:[^']|'')*)'"
SEARCH = re.compile(rf"\bmemory_hits\s*\(\s*{_STRING}\s*(?:,\s*(?:k\s*=>?\s*)?(\d+)\s*)?\)", re.I)
STATE = re.compile(rf"\bagent_state\s*\(\s*{_STRING}\s*,\s*{_STRING}\s*\)", re.I)


def classify(spark: SparkSession, sql: str) -> str:
    """``search``, ``state``, ``query``, ``dml`` or, for what doesn't parse, ``query`` (the guard will refuse it)."""
    if SEARCH.search(sql):
        return "search"
    if STATE.search(sql):
        return "state"
    try:
        inspect(spark, sql)
    except Refused as x:
        return "dml" if "only queries" in str(x) else "query"
    return "query"


class TenantSql:
    """Read-only SQL for tenants over ``tables`` (each with a tenant_id column).

    ``memory_hits('text', k)`` and ``agent_state('agent', 'key')`` stand in FROM as tables, any number of times, and
    only see the tenant's rows. ``search(text, k, tenant)`` gives the hits as a DataFrame. ``functions`` (name -> function
    over pandas Series, type) may be called beside the built-in ones.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], search: Callable[[str, int, str], DataFrame] | None = None, state: DataFrame | None = None, max_rows: int = 10_000, functions: dict[str, tuple[Callable, str]] | None = None):
        self.spark, self.tables, self.search, self.state, self.max_rows, self.functions = spark, tables, search, state, max_rows, functions or {}

    def query(self, sql: str, tenant: str, max_rows: int | None = None) -> DataFrame:
        """The statement's rows, at most ``max_rows``, as this tenant sees them."""
        own = self.spark.newSession()
        known = register_functions(own, self.functions)
        views: set[str] = set()

        def adopted(df: DataFrame) -> DataFrame:
            """The plan of ``df`` in the statement's session: nothing is computed or collected for that."""
            return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical()), own)

        def view(df: DataFrame, name: str) -> str:
            adopted(df).createOrReplaceTempView(name)
            views.add(name)
            return name

        def hits(m: re.Match) -> str:
            if self.search is None:
                raise Refused("no search is configured")
            return view(self.search(m[1].replace("''", "'"), int(m[2] or 5), tenant), f"hits_{uuid.uuid4().hex}")

        def state(m: re.Match) -> str:
            if self.state is None:
                raise Refused("no state is configured")
            agent, key = m[1].replace("''", "'"), m[2].replace("''", "'")
            found = self.state.filter((F.col("tenant_id") == tenant) & (F.col("agent_id") == agent) & (F.col("key") == key)).select("agent_id", "key", "value", "version")
            return view(found, f"state_{uuid.uuid4().hex}")

        text = dialect(STATE.sub(state, SEARCH.sub(hits, sql)))
        names, _ = inspect(self.spark, text, known)
        if unknown := names - set(self.tables) - views:
            raise Refused(f"unknown table {sorted(unknown)[0]}")
        for name in names & set(self.tables):
            adopted(self.tables[name].filter(F.col("tenant_id") == tenant)).createOrReplaceTempView(name)
        return own.sql(text).limit(self.max_rows if max_rows is None else max_rows)


def within(df: DataFrame, seconds: float, action: Callable[[DataFrame], object] = DataFrame.collect) -> object:
    """``action`` on ``df``, cancelled on the cluster when the time is over."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
    sc.setJobGroup(group, "query with a time limit", True)
    timer.start()
    try:
        return action(df)
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


class MaterializedViews:
    """Named results of plain queries, fully recomputed at each refresh, as Parquet under one folder, where their
    statements are kept too: another session finds them there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def create(self, name: str, sql: str) -> DataFrame:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise Refused(f"bad view name {name}")
        inspect(self.spark, sql)
        self.spark.createDataFrame([(sql.replace("\n", " "),)], "sql string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/mv_{name}/statement")
        return self.refresh(name)

    def statement(self, name: str) -> str:
        if name not in self.list():
            raise Refused(f"no view {name}")
        return self.spark.read.text(f"{self.folder}/mv_{name}/statement").first().value

    def refresh(self, name: str) -> DataFrame:
        path = f"{self.folder}/mv_{name}/{uuid.uuid4().hex}"
        self.spark.sql(self.statement(name)).write.parquet(path)
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(f"mv_{name}")
        return df

    def drop(self, name: str) -> None:
        self.statement(name)
        self.fs.delete(self._path(f"mv_{name}"), True)
        self.spark.catalog.dropTempView(f"mv_{name}")

    def list(self) -> list[str]:
        if not self.fs.exists(self._path()):
            return []
        return sorted(n[3:] for x in self.fs.listStatus(self._path()) if (n := x.getPath().getName()).startswith("mv_"))
