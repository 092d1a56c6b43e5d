"""Struct types from short forms, with no session at hand (a module that defines UDFs is imported before there is one)."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "map": T.MapType(T.StringType(), T.StringType())}


def struct(fields: str) -> T.StructType:
    """"name kind, name kind" with the kinds above; map is of strings."""
    return T.StructType([T.StructField(*f.split()[:1], _KINDS[f.split()[1]]) for f in fields.split(", ")])
