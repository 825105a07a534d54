"""String and JSON expressions that differ from Spark's defaults; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Unicode white space off both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def holds(c: Column, term: str, fold: bool = False) -> Column:
    """Literal substring search (no wildcards), if asked for without regard to case."""
    return F.lower(c).contains(term.strip().lower()) if fold else c.contains(term)


def masked(m: Column, secret: list[str], mask: str = "***") -> Column:
    """Map values under secret names replaced, empty ones left empty."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(secret) & (v != ""), F.lit(mask)).otherwise(v))


def ordered_distinct(parts: Column, lower: bool = False) -> Column:
    """Stripped, non-blank, first of each kept in first-seen order."""
    one = (lambda x: F.lower(strip(x))) if lower else strip
    return F.array_distinct(F.filter(F.transform(parts, one), lambda x: x != ""))


def default_tag(c: Column, tag: str = "latest") -> Column:
    return F.when(c.contains(":"), c).otherwise(F.concat(c, F.lit(f":{tag}")))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def glob_or_regex(rule: str) -> str | None:
    """A blacklist rule as a pattern: ``/re/`` as it is, else a glob of the whole text; None if it isn't a pattern."""
    import re

    pattern = rule[1:-1] if len(rule) > 1 and rule[0] == rule[-1] == "/" else "^" + ".*".join(map(re.escape, rule.split("*"))) + "$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern
