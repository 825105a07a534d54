"""Access decisions as expressions: ordered conditions over a row, first hit decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import networks as nw

#: fixed values: rank of each role
ROLES = {"owner": 40, "admin": 30, "editor": 20, "viewer": 10}


def level(role: Column) -> Column:
    """A role's rank, 0 for unknown ones and NULL."""
    ranks = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, role), F.lit(0))


def route_decision(*, known: Column, platform_only: Column, needs_full: Column, wanted: Column, is_platform: Column, full_access: Column, held: Column) -> Column:
    """An API key against a route's policy. No policy: denied. Then platform keys, full access, any capability, open routes."""
    none_wanted = F.size(wanted) == 0
    return (
        F.when(~known, "denied:route").when(platform_only & ~is_platform, "denied:platform_only").when(platform_only & none_wanted, "denied:no_capabilities")
        .when(full_access, "allowed").when(F.arrays_overlap(wanted, held), "allowed").when(~needs_full & none_wanted, "allowed").otherwise("denied:scope")
    )


def owner_or_role(*, is_key: Column, role: Column, least: str, is_admin: Column, found: Column, creator: Column, actor: Column) -> Column:
    """API keys are judged elsewhere; then role, administrators, a missing resource (its handler answers), the owner."""
    return (
        F.when(is_key, "key").when(level(role) >= ROLES[least], "role").when(is_admin, "admin").when(~found, "missing")
        .when((F.coalesce(creator, F.lit("")) != "") & (creator == actor), "owner").otherwise("denied")
    )


def best_grants(grants: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Rows (keys) that any grant holds, each with the first grant that does."""
    every = None
    for rank, (name, rows) in enumerate(grants):
        one = rows.select(*keys, F.lit(rank).alias("rank"), F.lit(name).alias("granted_by"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(F.min_by("granted_by", "rank").alias("granted_by"))


def ip_number(host: Column) -> Column:
    """A dotted address as a number, NULL for everything else (leading zeros too)."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    return F.when(host.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def ip_like(host: Column) -> Column:
    """Whether a host is a number in disguise: one decimal, or four parts that are decimal, octal or hexadecimal."""
    decimal = host.rlike(r"^\d{1,10}$") & (host.try_cast("bigint") <= 0xFFFFFFFF)
    value = lambda p: (
        F.when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(p, 3, 20), 16, 10).try_cast("bigint"))
        .when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10).try_cast("bigint")).when(p.rlike(r"^[0-9]+$") & ~p.rlike("^0[0-9]"), p.try_cast("bigint"))
    )
    values = F.transform(F.split(host, r"\."), value)
    four = (F.size(values) == 4) & F.forall(values, lambda v: F.coalesce(v.between(0, 255), F.lit(False)))
    return F.coalesce(decimal, F.lit(False)) | four


def url_decision(url: Column, *, allowed: list[str], restricted: set[str], suffixes: tuple[str, ...], longest: int = 2048) -> Column:
    """Whether a URL may be fetched, before its name is resolved. ``allowed`` holds hosts, ``*.suffix`` and networks of both IP
    versions; invalid networks are skipped. A list of networks that is a table goes through ``networks.longest_prefix``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))  # odd hosts too
    host = F.regexp_replace(host, r"^\[(.*)\]$", "$1")
    ip = nw.address(host)
    listed = F.lit(False)
    nets = []
    for entry in filter(None, (e.strip().lower() for e in allowed)):
        if entry.startswith("*."):
            listed = listed | host.endswith(entry[1:]) | (host == entry[2:])
        elif "/" in entry:
            nets.append(nw.network(F.lit(entry)))
        else:
            listed = listed | (host == entry)
    if nets:
        listed = listed | F.coalesce(F.exists(F.array(*nets), lambda net: nw.masked(ip, net["prefix"]) == net["net"]), F.lit(False))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | host.endswith(s)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "empty").when(F.length(url) > longest, "too_long").when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme")
        .when(F.coalesce(host, F.lit("")) == "", "no_host").when(listed, "allowed").when(host.isin(*restricted), "restricted").when(ends, "restricted_suffix")
        .when(ip.isNotNull(), "address").when(ip_like(host), "disguised_address").otherwise("to_resolve")
    )
