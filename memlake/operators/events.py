"""Reading events: filters by time, source and tenant, a builder for them, introspection, audit rows and shards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.scalars import HashRing

ORDERS = ("ts", "source", "event_type", "id")


def in_time_range(events: DataFrame, since: Column, until: Column) -> DataFrame:
    """Events from ``since`` to ``until``, both included, oldest first."""
    return events.filter(F.col("ts").between(since, until)).orderBy("ts", "id")


def of_source(events: DataFrame, source: str, limit: int) -> DataFrame:
    """A source's newest events."""
    return events.filter(F.col("source") == source).orderBy(F.desc("ts"), "id").limit(limit)


def of_tenant(events: DataFrame, tenant: str, limit: int) -> DataFrame:
    """A tenant's oldest events; the limit lies between 1 and ten million."""
    return events.filter(F.col("tenant_id") == tenant).orderBy("ts", "id").limit(max(1, min(limit, 10_000_000)))


def of_ids(events: DataFrame, ids: DataFrame, tenant: str | None = None) -> DataFrame:
    """The events of the given ids (and tenant); no ids, no events."""
    own = events if tenant is None else events.filter(F.col("tenant_id") == tenant)
    return own.join(ids.select("id").distinct(), "id", "left_semi")


def sources(events: DataFrame) -> DataFrame:
    """The distinct sources in order."""
    return events.select("source").distinct().orderBy("source")


def agents(state: DataFrame, prefix: str = "") -> DataFrame:
    """The distinct agents of a state table in order, their prefix taken off."""
    name = F.when(F.col("agent_id").startswith(prefix), F.substring("agent_id", len(prefix) + 1, 1 << 30)).otherwise(F.col("agent_id"))
    return state.select(name.alias("agent_id")).distinct().orderBy("agent_id")


def scopes(memories: DataFrame, limit: int = 10_000) -> DataFrame:
    """(user_id, agent_id, session_id, n) of the active memories' scopes, the fullest first."""
    keys = ["user_id", "agent_id", "session_id"]
    return memories.filter("state = 'active'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(limit)


@dataclass(frozen=True)
class EventQuery:
    """A query on events put together step by step; ``over`` runs it on a table."""

    filters: tuple[Column, ...] = ()
    order: tuple[str, bool] = ("ts", True)
    most: int | None = None

    def source(self, name: str) -> "EventQuery":
        return replace(self, filters=(*self.filters, F.col("source") == name))

    def event_type(self, name: str) -> "EventQuery":
        """One type, or with a ``*`` at the end all that begin so."""
        c = F.col("event_type").startswith(name[:-1]) if name.endswith("*") else F.col("event_type") == name
        return replace(self, filters=(*self.filters, c))

    def since(self, at: Column) -> "EventQuery":
        return replace(self, filters=(*self.filters, F.col("ts") >= at))

    def order_by(self, column: str, descending: bool = True) -> "EventQuery":
        if column not in ORDERS:
            raise ValueError(f"events are not ordered by {column}")
        return replace(self, order=(column, descending))

    def limit(self, n: int) -> "EventQuery":
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("a limit is a number of rows")
        return replace(self, most=n)

    def over(self, events: DataFrame) -> DataFrame:
        for c in self.filters:
            events = events.filter(c)
        column, falling = self.order
        out = events.orderBy(F.desc(column) if falling else F.asc(column), "id")
        return out if self.most is None else out.limit(self.most)


def audit_rows(requests: DataFrame, at: Column) -> DataFrame:
    """The audit entries of authenticated requests (identity, method, path, status, duration_ms, tenant, ip); those
    without an identity leave none."""
    cols = ["identity", "method", "path", "status", "duration_ms", "tenant", "ip"]
    return requests.filter("identity is not null and identity <> ''").select(at.alias("timestamp"), *cols)


def sharded(df: DataFrame, ring: HashRing, key: str = "tenant_id") -> DataFrame:
    """``df`` with the shard of each row. The ring meets the distinct keys, not the rows."""
    def place(batches):
        for pdf in batches:
            yield pdf.assign(shard=[ring.shard(k or "") for k in pdf["k"]])

    keys = df.select(F.col(key).alias("k")).distinct().mapInPandas(place, "k string, shard int")
    return df.join(keys, F.col(key).eqNullSafe(F.col("k"))).drop("k")


def moved(df: DataFrame, old: HashRing, new: HashRing, key: str = "tenant_id") -> DataFrame:
    """The rows that change their shard from one ring to another, with both (from_shard, to_shard)."""
    a = sharded(df, old, key).withColumnRenamed("shard", "from_shard")
    return sharded(a, new, key).withColumnRenamed("shard", "to_shard").filter("from_shard <> to_shard")


Authz = Callable[[str, str], DataFrame]


def authorised(memories: DataFrame, authz: Authz, tenant: str, user: str) -> DataFrame:
    """The memories that a user may see: own ones, and those of the grantors that an authorisation backend
    (tenant, user -> grantor_user_id) names."""
    users = authz(tenant, user).select(F.col("grantor_user_id").alias("__u")).distinct()
    own = memories.filter(F.col("tenant_id") == tenant)
    return own.filter(F.col("user_id") == user).unionByName(own.filter(F.col("user_id") != user).join(users, F.col("user_id") == F.col("__u"), "left_semi"))
