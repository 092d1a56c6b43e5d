"""Version requirements against the rule, over a grid of versions."""

import itertools

import pytest
from pyspark.sql import functions as F

from spanloom.functions import semver

PRE = [None, "alpha.2", "alpha.10", "beta"]
GRID = [(*n, p) for n in itertools.product(range(3), repeat=3) for p in PRE]
#: Comparators as operator, numbers given, pre-release.
CASES = [
    [("=", (1, 2, 1), None)], [(">", (0, 1, 2), None)], [("<=", (1, 0), None)], [("^", (1, 1), None)], [("^", (0, 1), None)], [("^", (0, 0, 2), None)], [("~", (1, 1), None)], [("~", (2,), None)],
    [(">=", (1, 0, 0), "alpha.2")], [(">=", (0, 2, 0), "alpha.10"), ("<", (1, 1, 0), "alpha.10")], [(">=", (0, 1, 0), None), ("<", (2, 0, 0), None)], [("<", (1, 2, 0), None)],
]


def written(parts):
    return ", ".join(op + ".".join(map(str, n)) + (f"-{pre}" if pre else "") for op, n, pre in parts)


def key(v):
    """Releases are above their pre-releases, which go by their fields, numbers as numbers."""
    return (*v[:3], 1, ()) if v[3] is None else (*v[:3], 0, tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in v[3].split(".")))


def within(v, op, n, pre):
    """One comparator. Numbers left out stand for all of them."""
    low = (*n, 0, 0)[:3]
    full = len(n) == 3
    up = {"~": min(len(n), 2) - 1, "^": next((k for k, x in enumerate(n) if x), len(n) - 1)}.get(op, len(n) - 1)
    above = tuple(low[k] + (k == up) if k <= up else 0 for k in range(3))
    if op in ("=", "~", "^"):
        return key(v) == key((*low, pre)) if op == "=" and full else key(v) >= key((*low, pre)) and v[:3] < above
    if op == ">":
        return key(v) > key((*low, pre)) if full else key(v) >= key((*above, None))
    if op == ">=":
        return key(v) >= key((*low, pre))
    return key(v) < key((*low, pre)) if op == "<" else key(v) <= key((*low, pre)) if full else key(v) < key((*above, None))


def meets(v, parts):
    """All comparators hold, and a pre-release is named by one of the same numbers; or it passes as its release, if every
    lower end is below its numbers and no upper end with a pre-release is."""
    named = any(pre and (*n, 0, 0)[:3] == v[:3] for _, n, pre in parts)
    if all(within(v, *p) for p in parts) and (v[3] is None or named):
        return True
    release = (*v[:3], None)
    ends = all((*n, 0, 0)[:3] < v[:3] if op not in ("<", "<=") else not pre or (*n, 0, 0)[:3] >= v[:3] for op, n, pre in parts)
    return v[3] is not None and ends and all(within(release, *p) for p in parts)


def test_grid_against_the_rule(spark):
    text = lambda v: ".".join(map(str, v[:3])) + (f"-{v[3]}" if v[3] else "")
    d = spark.createDataFrame([(k, text(v)) for k, v in enumerate(GRID)], "k int, v string")
    got = d.select("k", *[semver.satisfies(F.col("v"), written(c)).alias(f"c{j}") for j, c in enumerate(CASES)]).collect()
    wrong = [(text(GRID[r.k]), written(c)) for r in got for j, c in enumerate(CASES) if r[f"c{j}"] != meets(GRID[r.k], c)]
    assert wrong == []


def test_no_requirement(spark):
    r = spark.range(1).select(semver.satisfies(F.lit("1.0.0"), None).alias("a"), semver.satisfies(F.lit("3.1.4"), "").alias("b")).first()
    assert tuple(r) == (True, True)


def test_gate(spark):
    r = spark.range(1).select(semver.gate(F.lit("not-a-version"), ">=1").alias("a"), semver.gate(F.lit("1.0.0"), ">=bad-version").alias("b"), semver.gate(F.lit("x"), None).alias("c"), semver.gate(F.lit("1.0.0"), ">2").alias("d")).first()
    assert tuple(r) == ("invalid version", "invalid requirement", "ok", "skipped")
    with pytest.raises(semver.InvalidRequirement):
        semver.parse_requirement(">=bad-version")
