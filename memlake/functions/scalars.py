"""Other scalar functions, as columns or, where only a few values meet them, in Python."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def parse_ts(c: Column) -> Column:
    """A timestamp from RFC 3339 or ``date time[.fraction][zone]`` text; null for anything else."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]X", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def scope_key(tenant: Column, user: Column, agent: Column, session: Column) -> Column:
    """One string for an exact scope; an empty or null tenant is ``default``, nulls elsewhere are empty."""
    t = F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default"))
    return F.concat_ws("\u001f", t, *[F.coalesce(x, F.lit("")) for x in (user, agent, session)])


def recency(updated: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """0.5 to the age in half-lives; both times in microseconds; never above 1."""
    age = F.greatest(F.floor((now - updated) / 1_000_000), F.lit(0)) / 86_400.0
    return F.pow(F.lit(0.5), age / half_life_days)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where lengths differ or a vector is all zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def json_text(c: Column, path: str) -> Column:
    """The text at ``$.path``; null for paths with other characters than letters, digits, ``_`` and ``.``."""
    return F.get_json_object(c, f"$.{path}") if re.fullmatch(r"[A-Za-z0-9_.]+", path) else F.lit(None).cast("string")


def uuid5_text(namespace: Column, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in the namespace UUID given as text."""
    h = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "utf-8")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def fnv1a(text: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in text.encode("utf-8"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def tenant_view_name(table: str, tenant: str) -> str:
    """A view name that no two tenants share, even where their cleaned names agree."""
    clean = "".join(c.lower() if c.isascii() and c.isalnum() else "_" for c in tenant)[:40]
    return f"{table}__t_{clean}_{fnv1a(tenant):016x}"


class HashRing:
    """Consistent hashing of keys to shards, with virtual nodes."""

    def __init__(self, shards: int, vnodes: int = 128):
        self.shards = max(1, shards)
        points = {fnv1a(f"shard-{s}-vnode-{v}"): s for s in range(self.shards) for v in range(max(1, vnodes))}
        self.points = sorted(points)
        self.owner = [points[p] for p in self.points]

    def shard(self, key: str) -> int:
        if self.shards == 1:
            return 0
        return self.owner[bisect_left(self.points, fnv1a(key)) % len(self.points)]

    def moves(self, other: "HashRing", keys: list[str]) -> list[tuple[str, int, int]]:
        """(key, from, to) for each key whose shard differs in ``other``."""
        return [(k, a, b) for k in keys if (a := self.shard(k)) != (b := other.shard(k))]


def scale_plan(desired: int, actual: int, tenants: list[str]) -> dict:
    """What a change of the shard count takes: scaling up adds shards, then moves; scaling down moves, then removes."""
    desired, actual = max(1, desired), max(1, actual)
    way = "up" if desired > actual else "down" if desired < actual else "none"
    return {
        "direction": way,
        "scale_to": desired,
        "add": list(range(actual, desired)),
        "remove": list(range(desired, actual)),
        "moves": HashRing(actual).moves(HashRing(desired), tenants),
    }
