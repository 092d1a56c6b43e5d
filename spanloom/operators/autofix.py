"""Compiler diagnostics -> edits, by rule."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import default_value, safe_path
from ..functions.types import struct
from .edits import current

#: Places that are never edited (fixed values).
OUTSIDE = ["target/", ".cargo/registry", ".rustup"]


def suggestions(diags: DataFrame) -> DataFrame:
    """diag_id, code, seq, file, byte_start, byte_end, new_text, applicability: those of children first, deepest first, then the
    diagnostic's own; without one the applicability is Unspecified."""
    deep = F.flatten(F.transform(F.coalesce("message.children", F.array()), lambda c: F.flatten(F.transform(F.coalesce(c["children"], F.array()), lambda g: F.concat(F.flatten(F.transform(F.coalesce(g["children"], F.array()), lambda x: F.coalesce(x["spans"], F.array()))), F.coalesce(g["spans"], F.array()))))))
    child = F.flatten(F.transform(F.coalesce("message.children", F.array()), lambda c: F.coalesce(c["spans"], F.array())))
    own = F.coalesce("message.spans", F.array())
    d = diags.select("diag_id", F.col("message.code.code").alias("code"), F.posexplode(F.concat(deep, child, own)).alias("seq", "s")).where("s.suggested_replacement is not null")
    return d.select("diag_id", "code", "seq", F.col("s.file_name").alias("file"), "s.byte_start", "s.byte_end", F.col("s.suggested_replacement").alias("new_text"), F.coalesce("s.suggestion_applicability", F.lit("Unspecified")).alias("applicability"))


def first_spans(diags: DataFrame) -> DataFrame:
    """The first span of each diagnostic that has any."""
    d = diags.select("diag_id", F.col("message.code.code").alias("code"), F.col("message.message").alias("text"), F.get("message.spans", F.lit(0)).alias("s")).where("s is not null")
    return d.select("diag_id", "code", "text", F.col("s.file_name").alias("file"), "s.byte_start", "s.byte_end", F.col("s.expansion").isNotNull().alias("macro"))


def in_workspace(spans: DataFrame, root: str) -> DataFrame:
    """Spans of files under the root and not in build or registry folders; relative names are under it."""
    ok = ~F.startswith("file", F.lit("/")) | F.startswith("file", F.lit(root.rstrip("/") + "/"))
    for part in OUTSIDE:
        ok = ok & ~F.contains("file", F.lit(part))
    return spans.where(ok)


#: A string, or a brace.
_BRACES = re.compile(rb'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)


def _insert(raw: bytes, start: int, end: int) -> tuple | None:
    """(at, indent, indent of the closing brace, empty, comma) for a new field: at the closing brace where the braces from
    50 bytes before the span to 500 after it first balance. Fields are indented like the first line that has one."""
    low = max(0, start - 50)
    opened, depth = None, 0
    for m in _BRACES.finditer(raw, low, min(len(raw), end + 500)):
        if m[0] == b"{":
            opened = m.start() if opened is None else opened
            depth += 1
        elif m[0] == b"}":
            depth -= 1
            if not depth:
                break
    else:
        return None
    close = m.start()
    if opened is None or opened > close:
        return None
    body = raw[opened + 1 : close].decode(errors="replace")
    line = raw[raw.rfind(b"\n", 0, close) + 1 :].decode(errors="replace")
    brace = line[: len(line) - len(line.lstrip(" \t"))]
    indents = [x[: len(x) - len(x.lstrip())] for x in body.splitlines() if ":" in x]
    indent = next((x for x in indents if x), brace + "    ")
    empty = not body.strip()
    return close, indent, brace, empty, not empty and not body.rstrip().endswith(",")


@F.pandas_udf(struct("at bigint, indent string, brace_indent string, empty boolean, comma boolean"))
def insert_point(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Where a field goes in a struct initializer, and how; nulls where its braces don't balance."""
    rows = [_insert(text.encode(), int(s), int(e)) or (None,) * 5 for text, s, e in zip(content, start, end, strict=True)]
    return pd.DataFrame(rows, columns=["at", "indent", "brace_indent", "empty", "comma"]).astype({"at": "Int64"})


def fixes(diags: DataFrame, files: DataFrame, root: str = "") -> dict[str, DataFrame]:
    """edits (diag_id, rule, path, byte_start, byte_end, new_text, expected) and unfixed (diag_id, reason).

    A diagnostic takes its machine-applicable edits if any is left; else a missing field gets a default (E0063); else a single safe path
    suggestion counts (E0433). Equal edits count once.
    """
    sized = files.select("path", "content", F.octet_length("content").alias("size"))

    def grounded(d: DataFrame) -> DataFrame:
        j = in_workspace(d, root).withColumnRenamed("file", "path").join(sized, "path").where("byte_start >= 0 and byte_start <= byte_end and byte_end <= size")
        return j.withColumn("expected", current(F.col("content"), F.col("byte_start"), F.col("byte_end")))

    s = suggestions(diags)
    machine = grounded(s.where("applicability = 'MachineApplicable'")).select("diag_id", F.lit(1).alias("rank"), F.lit("machine").alias("rule"), "path", "byte_start", "byte_end", "new_text", "expected")
    named = F.regexp_extract("text", r"missing field `([^`]*)`(?s:.*)in initializer of `[^`]*`", 1)
    p = grounded(first_spans(diags).where("code = 'E0063' and not macro")).withColumn("field", named).where("field <> ''")
    p = p.withColumn("i", insert_point("content", "byte_start", "byte_end")).where("i.at is not null")
    pair = F.concat(F.col("field"), F.lit(": "), default_value(F.col("field")))
    new = (
        F.when(F.col("i.empty"), F.concat(F.lit("\n"), F.col("i.indent"), pair, F.lit(",\n"), F.col("i.brace_indent")))
        .when(F.col("i.comma"), F.concat(F.lit(",\n"), F.col("i.indent"), pair))
        .otherwise(F.concat(F.lit("\n"), F.col("i.indent"), pair, F.lit(",")))
    )
    field = p.select("diag_id", F.lit(2).alias("rank"), F.lit("E0063").alias("rule"), "path", F.col("i.at").alias("byte_start"), F.col("i.at").alias("byte_end"), new.alias("new_text"), F.lit("").alias("expected"))
    allowed = F.col("applicability").isin("MachineApplicable", "MaybeIncorrect")
    u = grounded(s.where("code = 'E0433'").where(allowed & safe_path(F.col("new_text"))))
    u = u.withColumn("_m", (F.col("applicability") == "MachineApplicable").cast("int"))
    u = u.withColumn("_best", F.max("_m").over(Window.partitionBy("diag_id"))).where("_m = _best").dropDuplicates(["diag_id", "path", "byte_start", "byte_end", "new_text"])
    u = u.withColumn("_n", F.count("*").over(Window.partitionBy("diag_id"))).where("_n = 1")
    path = u.select("diag_id", F.lit(3).alias("rank"), F.lit("E0433").alias("rule"), "path", "byte_start", "byte_end", "new_text", "expected")
    every = machine.unionByName(field).unionByName(path)
    every = every.withColumn("_top", F.min("rank").over(Window.partitionBy("diag_id"))).where("rank = _top").drop("rank", "_top")
    fixed = every.select("diag_id").distinct()
    # of diagnostics with one edit the first by id has it; all of them are fixed by it
    every = every.groupBy("path", "byte_start", "byte_end", "new_text").agg(F.min(F.struct("diag_id", "rule", "expected")).alias("m")).select("m.diag_id", "m.rule", "path", "byte_start", "byte_end", "new_text", "m.expected")
    reason = F.when(F.col("message.code.code").isin("E0063", "E0433"), F.lit("no safe edit")).otherwise(F.lit("no rule for this diagnostic"))
    return {"edits": every, "unfixed": diags.join(fixed, "diag_id", "left_anti").select("diag_id", reason.alias("reason"))}
