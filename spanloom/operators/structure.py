"""Rust source as a table of nodes; targets and patterns over it.

A lexer (comments, strings, raw strings, characters and lifetimes) and balanced brackets stand in for a grammar. Known
items: function, struct, enum, const, static, impl, use and match arm. What the lexer can't tell is an error, never a guess:
S-expressions other than one node with a name field are refused as unsupported.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import byte_offsets, per_row
from .edits import applied, expand_captures

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*)|(?P<raw>b?r(?P<h>#*)")|(?P<string>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^'\\])')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<meta>\$\$\$\w*|\$\w+)|(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*?(?=\.\.|[^\w.]|$))|(?P<punct>::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=|\.\.\.|\.\.|.)""",
    re.S,
)
PAIRS = {"(": ")", "[": "]", "{": "}"}
KINDS = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "const": "const_item", "static": "static_item", "impl": "impl_item", "use": "use_declaration"}


class Unsupported(ValueError):
    pass


def lex(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) without blanks and comments; an open string or comment ends the text as an ERROR token."""
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        end = m.end()
        if m["comment"] == "/*":
            depth, k = 1, end
            while depth and k < len(text):
                if text.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                elif text.startswith("*/", k):
                    depth, k = depth - 1, k + 2
                else:
                    k += 1
            if depth:
                out.append(("\0ERROR", at, len(text)))
            at = k
            continue
        if m["raw"]:
            stop = text.find('"' + m["h"], end)
            end = len(text) if stop < 0 else stop + 1 + len(m["h"])
            out.append(("\0ERROR" if stop < 0 else text[at:end], at, end))
        elif not m["space"] and not m["comment"]:
            out.append(("\0ERROR" if text[at] == '"' and end == at + 1 else text[at:end], at, end))
        at = end
    return out


def brackets(tokens: list) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Partner of each opening bracket, and the spans of those without one."""
    stack, pair, bad = [], {}, []
    for k, (t, a, b) in enumerate(tokens):
        if t in PAIRS:
            stack.append(k)
        elif t in PAIRS.values():
            if stack and PAIRS[tokens[stack[-1]][0]] == t:
                pair[stack.pop()] = k
            else:
                bad.append((a, b))
        elif t == "\0ERROR":
            bad.append((a, b))
    return pair, bad + [(tokens[k][1], tokens[k][2]) for k in stack]


def nodes(text: str) -> list[dict]:
    """Items with kind, name, type and trait (of impls), parent, span and body span in characters, errors included."""
    toks = lex(text)
    pair, bad = brackets(toks)
    out = [{"kind": "ERROR", "name": "", "trait": None, "start": a, "end": b, "body_start": None, "body_end": None} for a, b in bad]
    vis = re.compile(r"pub|crate|async|unsafe|extern|default")
    for k, (t, a, _) in enumerate(toks):
        if t == "=>":
            # an arm's pattern runs back to the last comma, brace or arm at the same depth
            j, depth = k - 1, 0
            while j >= 0:
                u = toks[j][0]
                if u in PAIRS.values():
                    depth += 1
                elif u in PAIRS:
                    if depth == 0:
                        break
                    depth -= 1
                    if u == "{" and depth == 0 and j + 1 < k and toks[pair.get(j, j)][0] == "}" and pair.get(j, j) < k - 1 and j - 1 >= 0 and toks[j - 1][0] == "=>":
                        j = pair[j]
                        break
                elif u == "," and depth == 0:
                    break
                j -= 1
            e, depth = k + 1, 0
            if e < len(toks) and toks[e][0] == "{" and e in pair:
                stop = pair[e]
            else:
                while e < len(toks) and not (depth == 0 and toks[e][0] in (",", "}")):
                    depth += (toks[e][0] in PAIRS) - (toks[e][0] in PAIRS.values())
                    e += 1
                stop = e - 1
            if j + 1 < k and stop > k:
                out.append({"kind": "match_arm", "name": text[toks[j + 1][1] : toks[k - 1][2]], "trait": None, "start": toks[j + 1][1], "end": toks[stop][2], "body_start": toks[k + 1][1], "body_end": toks[stop][2]})
            continue
        if t not in KINDS or k + 1 >= len(toks):
            continue
        if t in ("const", "static") and k + 1 < len(toks) and toks[k + 1][0] in ("fn", "unsafe", "extern"):
            continue
        prev = toks[k - 1][0] if k else ""
        if t in ("impl", "fn", "const") and prev in ("->", ":", "(", ",", "<", "&", "=", "*", "+", "|"):
            continue  # a type or an argument
        e, angle = k + 1, 0
        while e < len(toks) and not (toks[e][0] == ";" or (toks[e][0] == "{" and t not in ("use", "const", "static"))):
            e = pair.get(e, e) + 1 if toks[e][0] in PAIRS else e + 1
        if e >= len(toks):
            continue
        stop = pair.get(e, e) if toks[e][0] == "{" else e
        if t in ("use", "const", "static"):
            pass
        elif toks[e][0] == "{" and e not in pair:
            continue
        name, trait = toks[k + 1][0], None
        if t in ("const", "static") and name in ("mut",) and k + 2 < len(toks):
            name = toks[k + 2][0]
        if t == "use":
            name = text[toks[k + 1][1] : toks[e - 1][2]]
        if t == "impl":
            j = k + 1
            if toks[j][0] == "<":
                while j < e:
                    angle += {"<": 1, ">": -1}.get(toks[j][0], 0)
                    j += 1
                    if not angle:
                        break
            head = [toks[i] for i in range(j, e)]
            words = [x[0] for x in head]
            if "where" in words:
                head, words = head[: words.index("where")], words[: words.index("where")]
            if "for" in words:
                f = words.index("for")
                trait = text[head[0][1] : head[f - 1][2]]
                head = head[f + 1 :]
            name = text[head[0][1] : head[-1][2]] if head else ""
        first = k
        while first > 0 and (vis.fullmatch(toks[first - 1][0]) or toks[first - 1][0] == ")" and any(pair.get(q) == first - 1 and q > 0 and toks[q - 1][0] == "pub" for q in range(max(0, first - 6), first))):
            first -= 1
            if toks[first][0] == ")":
                first = next(q for q in range(max(0, first - 6), first) if pair.get(q) == first)
        body = (toks[e][1], toks[stop][2]) if toks[e][0] == "{" else (None, None)
        out.append({"kind": KINDS[t], "name": name, "trait": trait, "start": toks[first][1], "end": toks[stop][2], "body_start": body[0], "body_end": body[1]})
    out.sort(key=lambda n: (n["start"], -n["end"], n["kind"]))
    stack: list[int] = []
    for k, n in enumerate(out):
        while stack and out[stack[-1]]["end"] < n["end"]:
            stack.pop()
        n["node_id"], n["parent_id"] = k, stack[-1] if stack else None
        if n["kind"] != "ERROR":
            stack.append(k)
    return out


NODES = "node_id int, parent_id int, kind string, name string, trait string, byte_start bigint, byte_end bigint, body_start bigint, body_end bigint"


def _file_nodes(path: str, content: str):
    if content is None:
        return
    at = byte_offsets(content)
    b = lambda i: None if i is None else at[i]
    for n in nodes(content):
        yield n["node_id"], n["parent_id"], n["kind"], n["name"], n["trait"], b(n["start"]), b(n["end"]), b(n["body_start"]), b(n["body_end"])


def node_table(files: DataFrame) -> DataFrame:
    """path + a row per node."""
    return per_row(files.select("path", "content"), ["path"], NODES, _file_nodes)


def target(dsl: str) -> dict:
    """A target: kind, and name, name_re, trait, impl_re (for methods). Raises Unsupported."""
    text = dsl.strip()
    if text.startswith("("):
        m = re.fullmatch(r"\(\((\w+)\s+(?:name|type|argument):\s*\(\w+\)\s*@(\w+)\)\s*@\w+\s*\(#(eq|match)\?\s*@\2\s*\"((?:[^\"\\]|\\.)*)\"\)\)|\((\w+)\)\s*@\w+", text, re.S)
        if not m:
            raise Unsupported(f"query {text}")
        if m[5]:
            return {"kind": m[5]}
        return {"kind": m[1], "name" if m[3] == "eq" else "name_re": m[4]}
    m = re.fullmatch(r"(fn|struct|enum|const|static|impl|use)\s+(.+)", text, re.S)
    if not m:
        raise Unsupported(f"target {text}")
    word, rest = m[1], m[2].strip()
    if word == "fn" and "::" in rest:
        kind, name = rest.rsplit("::", 1)
        return {"kind": "function_item", "name": name, "impl_re": kind}
    if word == "const" and len(rest) > 1 and rest[0] == rest[-1] == "/":
        return {"kind": "const_item", "name_re": rest[1:-1]}
    if word == "impl" and " for " in rest:
        trait, name = rest.split(" for ", 1)
        return {"kind": "impl_item", "name": name.strip(), "trait": trait.strip()}
    if word == "use":
        return {"kind": "use_declaration", "name_re": rest}
    return {"kind": KINDS[word], "name": rest}


_TARGET = ("kind", "name", "name_re", "trait", "impl_re")


def locate_all(node_rows: DataFrame, dsls: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """target + the nodes of each of many targets, anywhere in the file, by one join whatever their number. wanted: path, target rows, if not
    every target is looked for in every file."""
    spark = node_rows.sparkSession
    rows = [(d, *(target(d).get(c) for c in _TARGET)) for d in dict.fromkeys(dsls)]
    asked = spark.createDataFrame(rows, "target string, kind string, " + ", ".join(f"_{c} string" for c in _TARGET[1:]))
    owners = node_rows.where("kind = 'impl_item'").select("path", F.col("node_id").alias("parent_id"), F.col("name").alias("_owner"))
    found = node_rows.join(owners, ["path", "parent_id"], "left") if any(r[5] for r in rows) else node_rows.withColumn("_owner", F.lit(None).cast("string"))
    found = found.join(F.broadcast(asked), "kind") if wanted is None else wanted.join(F.broadcast(asked), "target").join(found, ["path", "kind"])
    ok = (F.col("_name").isNull() | (F.col("name") == F.col("_name"))) & (F.col("_trait").isNull() | (F.col("trait") == F.col("_trait")))
    for pattern, column in (("_name_re", "name"), ("_impl_re", "_owner")):
        ok = ok & (F.col(pattern).isNull() | F.coalesce(F.rlike(F.col(column), F.col(pattern)), F.lit(False)))
    return found.where(ok).select("target", *node_rows.columns)


def locate(node_rows: DataFrame, dsl: str) -> DataFrame:
    """Nodes of a target, anywhere in the file."""
    return locate_all(node_rows, [dsl]).drop("target")


def with_field(node_rows: DataFrame, kind: str, field: str) -> DataFrame:
    """Nodes of a kind that have a field: name, trait or body, what the reader knows."""
    columns = {"name": "name", "trait": "trait", "body": "body_start"}
    if field not in columns:
        raise Unsupported(f"field {field}")
    return node_rows.where((F.col("kind") == kind) & F.col(columns[field]).isNotNull())


def errors(node_rows: DataFrame) -> DataFrame:
    return node_rows.where("kind = 'ERROR'").select("path", "byte_start", "byte_end")


def catalogue(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("kind").agg(F.count("*").alias("n"))


@lru_cache(256)
def compiled(pattern: str) -> tuple:
    toks = [t for t, _, _ in lex(pattern)]
    if not toks:
        raise Unsupported("empty pattern")
    return tuple(toks)


def find_pattern(text: str, pattern: str) -> list[tuple[int, int, dict[str, str]]]:
    """(start, end, captures): $X is one token or bracketed group, $$$X any number of them, $_ is not captured; equal names must agree."""
    want = compiled(pattern)
    toks = lex(text)
    pair, _ = brackets(toks)

    def same(a: str, b: str) -> bool:
        return [t for t, _, _ in lex(a)] == [t for t, _, _ in lex(b)]

    def go(p: int, k: int, caps: dict[str, str]):
        if p == len(want):
            return k, caps
        w = want[p]
        if w.startswith("$$$"):
            j = k
            while True:
                got = go(p + 1, j, {**caps, w[3:]: text[toks[k][1] : toks[j - 1][2]] if j > k else ""} if w[3:] else caps)
                if got:
                    return got
                if j >= len(toks) or toks[j][0] in PAIRS.values() and j not in pair:
                    return None
                j = pair.get(j, j) + 1
        if k >= len(toks):
            return None
        if w.startswith("$"):
            if toks[k][0] in PAIRS.values() or toks[k][0] in (",", ";"):
                return None
            # a name goes on over paths, calls and fields, longest first
            ends = [pair.get(k, k)]
            while (j := ends[-1] + 1) < len(toks) and toks[j][0] in ("::", ".", "(", "[", "?", "!"):
                if toks[j][0] in ("(", "["):
                    ends.append(pair.get(j, j))
                elif toks[j][0] in ("?", "!") or j + 1 >= len(toks):
                    ends.append(j)
                else:
                    ends.append(pair.get(j + 1, j + 1))
            for e in reversed(ends):
                value = text[toks[k][1] : toks[e][2]]
                name = w[1:]
                if name == "_":
                    got = go(p + 1, e + 1, caps)
                elif name in caps and not same(caps[name], value):
                    continue
                else:
                    got = go(p + 1, e + 1, {**caps, name: value})
                if got:
                    return got
            return None
        return go(p + 1, k + 1, caps) if toks[k][0] == w else None

    out, k = [], 0
    while k < len(toks):
        got = go(0, k, {})
        if got and got[0] > k:
            out.append((toks[k][1], toks[got[0] - 1][2], got[1]))
        k += 1
    return out


def _file_matches(path: str, content: str, pattern: str):
    if content is None or not pattern:
        return
    at = byte_offsets(content)
    for x, y, caps in find_pattern(content, pattern):
        yield at[x], at[y], content[x:y], list(caps.items())


def matches(files: DataFrame, patterns: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """path, pattern + a row per match. With patterns: path, pattern rows, joined to their files by path."""
    d = files.select("path", "content")
    d = d.withColumn("pattern", F.lit(pattern)) if patterns is None else d.join(patterns.select("path", "pattern").distinct(), "path")
    return per_row(d.select("path", "content", "pattern"), ["path", "pattern"], "byte_start bigint, byte_end bigint, text string, captures map", _file_matches)


def has_match(files: DataFrame, pattern: str) -> DataFrame:
    """path, has_match of every file."""
    hit = matches(files, pattern=pattern).select("path").distinct().withColumn("_hit", F.lit(True))
    return files.select("path").join(hit, "path", "left").select("path", F.coalesce("_hit", F.lit(False)).alias("has_match"))


def find_in_function(files: DataFrame, pattern: str, function: str) -> DataFrame:
    """Matches within the functions of a name, + function."""
    return inside(matches(files, pattern=pattern), locate(node_table(files), f"fn {function}"))


def outermost(found: DataFrame) -> DataFrame:
    """Matches that don't begin within an earlier one of the file."""
    w = Window.partitionBy("path").orderBy("byte_start", F.desc("byte_end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_to", F.max("byte_end").over(w)).where("_to is null or byte_start >= _to").drop("_to")


def _as_edits(d: DataFrame, new_text: Column, expected: Column) -> DataFrame:
    return d.select("path", F.col("byte_start").alias("ord"), "byte_start", "byte_end", new_text.alias("new_text"), F.lit("exact").alias("verify_kind"), expected.alias("verify_text"), F.lit(None).cast("decimal(20,0)").alias("verify_hash"))


def replace_matches(found: DataFrame, template: str) -> DataFrame:
    """An edit per outermost match: the template with its captures, checked against the matched text."""
    d = outermost(found)
    return _as_edits(d, expand_captures(F.lit(template), F.col("captures")), F.col("text"))


def replace_capture(found: DataFrame, name: str, new_text: str) -> DataFrame:
    """An edit per match that has the capture: its first occurrence in the match is replaced."""
    d = outermost(found).withColumn("_c", F.col("captures")[name]).where("_c is not null")
    start, end = capture_span(F.col("byte_start"), F.col("text"), F.col("_c"))
    return _as_edits(d.withColumn("_s", start).withColumn("_e", end).select("path", F.col("_s").alias("byte_start"), F.col("_e").alias("byte_end"), "_c"), F.lit(new_text), F.col("_c"))


def find_and_replace(files: DataFrame, pattern: str, template: str) -> DataFrame:
    """path, content, changed: every outermost match of every file replaced."""
    return applied(files, replace_matches(matches(files, pattern=pattern), template))


def validated(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, changed, rejected: files with their edits applied where that brings no syntax error (by brackets and
    open strings) that wasn't there; else the file stays as it is."""
    after = applied(files, edits).where("changed")

    def count(d: DataFrame, name: str) -> DataFrame:
        return errors(node_table(d)).groupBy("path").agg(F.count("*").alias(name))

    both = after.withColumnRenamed("content", "new").select("path", "new").join(count(after, "n_after"), "path", "left").join(count(files.join(after.select("path"), "path", "left_semi"), "n_before"), "path", "left")
    both = both.withColumn("worse", F.coalesce("n_after", F.lit(0)) > F.coalesce("n_before", F.lit(0)))
    out = files.select("path", "content").join(both.select("path", "new", "worse"), "path", "left")
    worse = F.coalesce("worse", F.lit(False))
    fine = F.col("new").isNotNull() & ~worse
    return out.select("path", F.when(fine, F.col("new")).otherwise(F.col("content")).alias("content"), fine.alias("changed"), worse.alias("rejected"))


def inside(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Matches within a function's span: a containment join, keyed by path."""
    f = functions.select("path", F.col("byte_start").alias("fs"), F.col("byte_end").alias("fe"), F.col("name").alias("function"))
    return found.join(f, "path").where("byte_start >= fs and byte_end <= fe").drop("fs", "fe")


def in_range(found: DataFrame, start: int, end: int) -> DataFrame:
    return found.where((F.col("byte_start") >= start) & (F.col("byte_end") <= end))


def capture_span(start: Column, text: Column, capture: Column) -> tuple[Column, Column]:
    """The capture's first occurrence in its match, in bytes."""
    at = start + F.octet_length(F.substring(text, F.lit(1), F.instr(text, capture) - 1))
    return at, at + F.octet_length(capture)


def match_arms(files: DataFrame, node_rows: DataFrame, pattern: str) -> DataFrame:
    """Match arms whose pattern holds a match."""
    arms = node_rows.where("kind = 'match_arm'")
    found = matches(files, pattern=pattern).select("path", F.col("byte_start").alias("ms"), F.col("byte_end").alias("me"))
    hit = arms.join(found, "path").where("ms >= byte_start and me <= byte_start + octet_length(name)")
    return hit.select(arms.columns).distinct()


def snippet_errors(text: str) -> list[tuple[int, int]]:
    """Unbalanced brackets and open strings of a snippet (weaker than a parser)."""
    return brackets(lex(text))[1]
