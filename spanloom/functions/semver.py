"""Semantic version requirements as Columns: the requirement is parsed on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_VERSION = re.compile(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")
_PART = re.compile(r"^(=|>=|<=|>|<|\^|~)?\s*(\d+|[*xX])(?:\.(\d+|[*xX]))?(?:\.(\d+|[*xX]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")
SQL_VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"


class InvalidRequirement(ValueError):
    pass


def parse_requirement(text: str | None) -> list[tuple[str, tuple[int, ...], str | None]]:
    """[(operator, numbers given, pre-release)]; empty or None: nothing asked."""
    if text is None or not text.strip():
        return []
    out = []
    for part in text.split(","):
        m = _PART.match(part.strip())
        if not m:
            raise InvalidRequirement(text)
        numbers = []
        for g in m.groups()[1:4]:
            if g is None or g in "*xX":
                break
            numbers.append(int(g))
        if not numbers:
            if m[1] or m[2] not in ("*", "x", "X"):
                raise InvalidRequirement(text)
            continue
        wild = any(g in ("*", "x", "X") for g in m.groups()[1:4] if g)
        out.append((m[1] or ("=" if wild else "^"), tuple(numbers), m[5]))
    return out


def parsed(version: Column) -> Column:
    """struct(major, minor, patch, pre); null where the version is invalid."""

    def n(k: int) -> Column:
        return F.regexp_extract(version, SQL_VERSION, k).cast("long")

    pre = F.regexp_replace(F.regexp_extract(version, SQL_VERSION, 4), "^-", "")
    return F.when(version.rlike(SQL_VERSION), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch"), pre.alias("pre")))


def _rank(pre: Column) -> Column:
    """Pre-release identifiers in an order of arrays: numbers below names, shorter first; a release is above all."""
    ids = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.when(pre == "", F.array(F.lit("2"))).otherwise(ids)


def _key(v: Column) -> Column:
    return F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"), _rank(v["pre"]).alias("d"))


def _const(numbers: tuple[int, ...], pre: str | None) -> Column:
    a, b, c = (*numbers, 0, 0)[:3]
    return F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c"), _rank(F.lit(pre or "")).alias("d"))


def _bounds(op: str, n: tuple[int, ...], pre: str | None) -> tuple[tuple | None, tuple | None]:
    """[low, high) of a comparator, the ends as (numbers, pre); high ends are below all pre-releases."""
    full = (*n, 0, 0)[:3]

    def bump(k: int) -> tuple:
        return (*full[:k], full[k] + 1, 0, 0)[:3]

    last = len(n) - 1
    if op == "=":
        return (full, pre), (bump(last), "0") if last < 2 else None
    if op == "~":
        return (full, pre), (bump(min(1, last)), "0")
    if op == "^":
        k = next((i for i in range(len(n)) if n[i] > 0), last)
        return (full, pre), (bump(k), "0")
    raise AssertionError(op)


def _one(key: Column, op: str, n: tuple[int, ...], pre: str | None) -> Column:
    part = len(n) < 3
    if op == ">":
        return key >= _const((*n[:-1], n[-1] + 1), None) if part else key > _const(n, pre)
    if op == ">=":
        return key >= _const(n, pre)
    if op == "<":
        return key < _const(n, pre)
    if op == "<=":
        return key < _const((*n[:-1], n[-1] + 1), None) if part else key <= _const(n, pre)
    low, high = _bounds(op, n, pre)
    if op == "=" and high is None:
        return key == _const(*low)
    # an upper end excludes its own pre-releases: compare by numbers
    return (key >= _const(*low)) & (F.struct(key["a"].alias("a"), key["b"].alias("b"), key["c"].alias("c")) < F.struct(*[F.lit(x).cast("long").alias(s) for x, s in zip(high[0], "abc", strict=True)]))


def satisfies(version: Column, requirement: str | None) -> Column:
    """Whether a version (string column) meets a requirement (driver string); null for an invalid version.

    All comparators hold, and a pre-release only matches if one of them has a pre-release of the same numbers.
    Else a pre-release is tried once more as a release, if each lower comparator's numbers are below its own and no
    upper comparator with a pre-release has numbers below them. No requirement: true, whatever the version.
    """
    parts = parse_requirement(requirement)
    if requirement is None or not requirement.strip():
        return F.lit(True)
    v = parsed(version)
    key, is_pre = _key(v), v["pre"] != ""
    holds = F.lit(True)
    for p in parts:
        holds = holds & _one(key, *p)
    same = F.lit(False)
    for _, n, pre in parts:
        if pre is not None:
            same = same | ((v["major"] == n[0]) & (v["minor"] == (*n, 0, 0)[1]) & (v["patch"] == (*n, 0, 0)[2]))
    strict = holds & (~is_pre | same)
    numbers = F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"))
    again = is_pre
    bare = F.struct(v["major"].alias("a"), v["minor"].alias("b"), v["patch"].alias("c"), _rank(F.lit("")).alias("d"))
    for op, n, pre in parts:
        base = F.struct(*[F.lit(x).cast("long").alias(s) for x, s in zip((*n, 0, 0)[:3], "abc", strict=True)])
        if op not in ("<", "<="):
            again = again & (base < numbers)
        elif pre is not None:
            again = again & ~(base < numbers)
        again = again & _one(bare, op, n, pre)
    return F.when(v.isNull(), F.lit(None).cast("boolean")).otherwise(strict | again)


def gate(version: Column, requirement: str | None) -> Column:
    """'ok', 'skipped', 'invalid version' or 'invalid requirement'; a bad version wins over a bad requirement."""
    if requirement is None or not requirement.strip():
        return F.lit("ok")
    bad = F.lit("invalid version")
    try:
        parse_requirement(requirement)
    except InvalidRequirement:
        return F.when(parsed(version).isNull(), bad).otherwise(F.lit("invalid requirement"))
    ok = satisfies(version, requirement)
    return F.when(ok.isNull(), bad).when(ok, F.lit("ok")).otherwise(F.lit("skipped"))
