"""Sections and keys of TOML texts by line, and edit plans for them.

The section scan is native. Keys and plans need a quote-aware scan and a whole parse of the result, so they run
as Arrow-batched functions of one text.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import byte_offsets, per_row
from ..functions.types import struct


class TomlError(ValueError):
    pass


def parse_path(text: str) -> list[str]:
    """Dotted path with quoted segments; a trailing dot is tolerated."""
    out, k, text = [], 0, text.strip()
    if not text:
        raise TomlError("empty path")
    while k < len(text):
        if text[k] in "'\"":
            quote, k, part = text[k], k + 1, ""
            while k < len(text) and text[k] != quote:
                if text[k] == "\\" and quote == '"' and k + 1 < len(text):
                    k += 1
                part, k = part + text[k], k + 1
            if k >= len(text):
                raise TomlError(f"open quote in {text}")
            k += 1
        else:
            m = re.compile(r"[^.\s'\"]*").match(text, k)
            part, k = m[0], m.end()
            if not part:
                raise TomlError(f"empty segment or blank in {text}")
        out.append(part)
        if k < len(text):
            if text[k] != ".":
                raise TomlError(f"unexpected {text[k]!r} in {text}")
            k += 1
    return out


def sections(files: DataFrame) -> DataFrame:
    """path, section (header text between brackets), header_start, header_end, body_start, body_end: the body runs to the
    next header. A line whose first character is [ is a header; [[x]] has the path of [x]."""
    d = files.select("path", "content", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("path").orderBy("line_no")
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    d = d.withColumn("header_start", start).where(F.col("line").rlike(r"^\s*\["))
    size = F.octet_length("content").cast("bigint")
    end = F.least(F.col("header_start") + F.octet_length("line") + 1, size)
    name = F.regexp_extract("line", r"^\s*\[\[?([^\]]*)\]\]?", 1)
    return d.select("path", name.alias("section"), "header_start", (F.col("header_start") + F.octet_length("line")).alias("header_end"), end.alias("body_start"), F.coalesce(F.lead("header_start").over(w), size).alias("body_end"))


@dataclass
class Section:
    path: list[str]
    start: int
    body: int
    end: int


def scan(text: str) -> list[Section]:
    """Sections in characters."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare.startswith("["):
            m = re.match(r"\[\[?(.*?)\]\]?\s*(?:#.*)?$", bare)
            if not m:
                raise TomlError(f"invalid header {bare}")
            if out:
                out[-1].end = at
            out.append(Section(parse_path(m[1]), at, at + len(line), len(text)))
        at += len(line)
    return out


def _unquoted(line: str, what: str) -> int:
    quote, k = "", 0
    while k < len(line):
        c = line[k]
        if quote:
            if c == "\\" and quote == '"':
                k += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == what:
            return k
        k += 1
    return -1


def keys(text: str, s: Section) -> list[tuple[list[str], tuple[int, int], tuple[int, int]]]:
    """(path, key span, value span) of the single-line pairs of a body."""
    out, at = [], s.body
    for line in text[s.body : s.end].splitlines(keepends=True):
        bare = line.strip()
        if bare and bare[0] not in "#[":
            eq = _unquoted(line, "=")
            if eq > 0:
                left = line[:eq]
                k0 = at + len(left) - len(left.lstrip(" \t"))
                k1 = at + len(left.rstrip(" \t"))
                right = line[eq + 1 :].rstrip("\r\n")
                hash_at = _unquoted(right, "#")
                right = right if hash_at < 0 else right[:hash_at]
                v0 = at + eq + 1 + len(right) - len(right.lstrip(" \t"))
                out.append((parse_path(text[k0:k1]), (k0, k1), (v0, max(v0, at + eq + 1 + len(right.rstrip(" \t"))))))
        at += len(line)
    return out


def _one(text: str, path: list[str]) -> Section:
    hit = [s for s in scan(text) if s.path == path]
    if len(hit) != 1:
        raise TomlError("section not found" if not hit else f"ambiguous section: {len(hit)}")
    return hit[0]


def _check(text: str) -> None:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise TomlError(str(e)) from e


def section_exists(text: str, section: str) -> bool:
    return any(s.path == parse_path(section) for s in scan(text))


def get_value(text: str, section: str | None, key: str) -> str | None:
    if section is None:
        return None
    hit = [v for k, _, v in keys(text, _one(text, parse_path(section))) if k == parse_path(key)]
    return text[hit[0][0] : hit[0][1]] if len(hit) == 1 else None


def plan(text: str, query: dict, op: dict, constraint: dict | None = None) -> tuple[int, int, str, str | None]:
    """(start, end, new text, reason for doing nothing or None) in characters.

    A plan that does nothing stands at the end of the text, where it meets no other edit.
    """
    c = constraint or {}
    none = lambda why: (len(text), len(text), "", why)
    kind, section = op["type"], query.get("section")
    if query.get("ensure_absent") or query.get("ensure_present"):
        raise TomlError("ensure_absent and ensure_present belong in the constraint")
    if kind in ("insert-section", "append-section"):
        snippet = op["text"]
        _check(snippet)
        try:
            _one(text, parse_path(section))
            there = True
        except TomlError:
            there = False
        if there and (kind == "append-section" or c.get("ensure_absent")):
            return none("section exists")
        at, anchor = len(text), ""
        if kind == "insert-section":
            all_s = scan(text)
            if op.get("after_section"):
                s = _one(text, parse_path(op["after_section"]))
                at = s.end
            elif op.get("before_section"):
                at = _one(text, parse_path(op["before_section"])).start
            elif op.get("at_beginning"):
                at = all_s[0].start if all_s else 0
            nxt = next((s for s in all_s if s.start == at), None)
            if nxt:
                anchor = text[nxt.start : nxt.body]
        new = snippet if snippet.endswith("\n") else snippet + "\n"
        before = text[:at]
        if before and new.lstrip().startswith("["):
            new = "\n" * (0 if before.endswith("\n\n") else 1 if before.endswith("\n") else 2) + new
        if anchor:
            new += ("" if new.endswith("\n\n") else "\n") + anchor
        out = (at, at + len(anchor), new, None)
    else:
        must = bool(c.get("ensure_present"))
        try:
            s = _one(text, parse_path(section))
            if kind == "delete-section":
                out = (s.start, s.end, "", None)
            else:
                hit = [(k, v) for p, k, v in keys(text, s) if p == parse_path(query["key"])]
                if len(hit) != 1:
                    raise TomlError("key not found" if not hit else f"ambiguous key: {len(hit)}")
                if kind == "replace-value":
                    (a, b), new = hit[0][1], op["value"]
                    _check(f"v = {new}")
                elif kind == "replace-key":
                    (a, b), new = hit[0][0], op["new_key"]
                    parse_path(new)
                else:
                    raise TomlError(f"unsupported operation {kind}")
                if text[a:b].strip() == new.strip():
                    return none("already so")
                out = (a, b, new, None)
        except TomlError as e:
            if must or kind not in ("replace-value", "replace-key", "delete-section") or "unsupported" in str(e):
                raise
            return none(str(e))
    _check(text[: out[0]] + out[2] + text[out[1] :])
    return out


PLAN = "byte_start bigint, byte_end bigint, new_text string, noop string, error string"


def plan_edits(content: Column, query: Column, operation: Column, constraint: Column) -> Column:
    """struct of PLAN for a patch and its file, in bytes."""

    @F.pandas_udf(struct(PLAN))
    def run(text: pd.Series, q: pd.DataFrame, o: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(len(text)):
            t = text.iloc[k]
            clean = lambda r: {n: (None if v is None or v != v else v) for n, v in r.items()}
            try:
                a, b, new, why = plan(t, clean(q.iloc[k].to_dict()), clean(o.iloc[k].to_dict()), clean(c.iloc[k].to_dict()))
                out.append((len(t[:a].encode()), len(t[:b].encode()), new, why, None))
            except TomlError as e:
                out.append((None, None, None, None, str(e)))
        return pd.DataFrame(out, columns=["byte_start", "byte_end", "new_text", "noop", "error"]).astype({"byte_start": "Int64", "byte_end": "Int64"})

    return run(content, query, operation, constraint)


def _file_keys(path: str, content: str):
    if content is None:
        return
    at = byte_offsets(content)
    try:
        for s in scan(content):
            for name, k, v in keys(content, s):
                yield ".".join(s.path), ".".join(name), at[k[0]], at[k[1]], at[v[0]], at[v[1]], content[v[0] : v[1]]
    except TomlError:
        return


def key_table(files: DataFrame) -> DataFrame:
    """path + a row per key and value; what is no TOML has none."""
    return per_row(files.select("path", "content"), ["path"], "section string, key string, key_start bigint, key_end bigint, value_start bigint, value_end bigint, value string", _file_keys)
