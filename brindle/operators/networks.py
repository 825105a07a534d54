"""IP addresses and networks as columns: both versions, longest-prefix match by equi-joins.

An address is (version, hi, lo): 128 bits in two longs, an IPv4 address in the lowest 32. The versions never match each other,
an IPv4 address written in IPv6 form among them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DOTTED = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4(host: Column) -> Column:
    parts = F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint"))
    return F.when(host.rlike(_DOTTED), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))


def _undotted(host: Column) -> Column:
    """An IPv6 text whose last 32 bits are two groups, also where they were dotted."""
    tail = F.regexp_extract(host, r":([0-9]+\.[0-9.]+)$", 1)
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
    return F.when(tail != "", F.concat(F.regexp_extract(host, r"^(.*:)[0-9.]+$", 1), _let(_v4(tail), pair))).otherwise(host)


def _full(left: Column, right: Column, gap: Column) -> Column:
    """The digits of the groups before and behind ``::``."""
    count = F.size(left) + F.size(right)
    right_count = F.when(gap, count <= 7).otherwise(count == 8)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - count, F.lit(0)).cast("int")), right)
    digits = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(right_count, _let(filled, digits))


def _v6_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, NULL for anything else."""
    text = F.lower(_undotted(F.regexp_replace(host, "%[^%/]+$", "")))  # without a zone
    sides = lambda t: F.split(t, "::", 2)
    whole = lambda x: _full(_groups(F.get(x, F.lit(0))), _groups(F.coalesce(F.get(x, F.lit(1)), F.lit(""))), F.size(x) == 2)
    return F.when(host.contains(":"), _let(text, lambda t: _let(sides(t), whole)))


def _half(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")


def _told(version: int, hi: Column, lo: Column) -> Column:
    return F.struct(F.lit(version).alias("version"), hi.alias("hi"), lo.alias("lo"))


def address(host: Column) -> Column:
    """(version, hi, lo) of a literal address, with or without brackets, NULL for a name."""
    four = _let(_v4(host), lambda n: F.when(n.isNotNull(), _told(4, F.lit(0).cast("bigint"), n)))
    six = _let(_v6_digits(F.regexp_replace(host, r"^\[(.*)\]$", "$1")), lambda d: F.when(d.isNotNull(), _told(6, _half(d, 1), _half(d, 17))))
    return F.coalesce(four, six)


def _mask(bits: Column) -> Column:
    """A long with this many leading ones, 0 to 64."""
    return F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, F.lit(-1).cast("bigint")).otherwise(_shifted(bits))


def _shifted(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - bits).cast("int"))


def masked(ip: Column, prefix: Column) -> Column:
    """An address's first ``prefix`` bits, of 32 or 128."""

    def cut(x: Column) -> Column:
        bits = F.when(x["version"] == 4, prefix + 96).otherwise(prefix)
        return F.when(x.isNotNull(), F.struct(x["version"].alias("version"), x["hi"].bitwiseAND(_mask(bits)).alias("hi"), x["lo"].bitwiseAND(_mask(bits - 64)).alias("lo")))

    return _let(ip, cut)


def network(text: Column) -> Column:
    """(prefix, net) of ``address/prefix``, bits behind the prefix dropped; a bare address is a network of one; NULL for anything
    that isn't one."""

    def read(parts: Column) -> Column:
        given = F.get(parts, F.lit(1))

        def net(ip: Column) -> Column:
            whole = F.when(ip["version"] == 4, 32).otherwise(128)
            prefix = F.when(given.isNull(), whole).when(given.rlike(r"^\d{1,3}$"), given.try_cast("int"))
            return F.when(ip.isNotNull() & (prefix <= whole), F.struct(prefix.alias("prefix"), masked(ip, prefix).alias("net")))

        return _let(address(F.get(parts, F.lit(0))), net)

    return _let(F.split(F.trim(text), "/", 2), read)


def longest_prefix(addresses: DataFrame, column: str, networks: DataFrame, text: str, payload: list[str]) -> DataFrame:
    """``addresses`` with the columns ``payload`` of the longest network that holds the address in ``column`` (text), NULL where
    none does. Each of the prefix lengths that occur, 162 at most, is one masked key; a network is found by equality of version,
    length and masked address, so the number of networks doesn't matter."""
    nets = networks.select(network(F.col(text)).alias("_n"), *payload).where("_n is not null").select(F.col("_n.prefix").alias("_p"), F.col("_n.net").alias("_net"), *[F.col(c).alias(f"_{c}_net") for c in payload])
    nets = nets.groupBy("_p", "_net").agg(*[F.min(f"_{c}_net").alias(f"_{c}_net") for c in payload])  # the same network twice
    lengths = nets.select(F.col("_net.version").alias("_v"), "_p").distinct()  # 33 + 129 rows at most
    keyed = addresses.select(F.col(column).alias("_key")).distinct().withColumn("_ip", address(F.col("_key"))).where("_ip is not null")
    tried = keyed.join(F.broadcast(lengths), F.col("_ip.version") == F.col("_v")).select("_key", "_p", masked(F.col("_ip"), F.col("_p")).alias("_net"))
    best = tried.join(nets, ["_p", "_net"]).groupBy("_key").agg(F.max_by(F.struct(*[f"_{c}_net" for c in payload], "_p"), "_p").alias("_b"))
    out = addresses.join(best, addresses[column] == best["_key"], "left")
    return out.select(*addresses.columns, *[F.col(f"_b._{c}_net").alias(c) for c in payload], F.col("_b._p").alias("prefix"))
