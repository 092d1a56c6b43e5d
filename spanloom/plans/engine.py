"""Apply, check, status and verify: one plan over all patches and files.

gate -> join files -> locate (a branch per query type) -> uniqueness -> verify -> overlap -> fold -> status. Nothing is written:
a run returns results and patched files, and the input stays as it is. The joins and the file verdict share the key path.
"""

from __future__ import annotations

import difflib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..functions.arrow import per_row
from ..functions.text import align_newline, byte_start, hex_to_decimal, occurrences
from ..operators import edits as E
from ..operators import structure, toml_spans
from ..operators.guards import FORBIDDEN, guard, resolve
from ..operators.locate import DEFAULT_THRESHOLD, fuzzy_best
from ..operators.structure import Unsupported
from ..session import cut

RESULT = ["ord", "patch_id", "status", "file", "reason", "error_kind", "match_count"]
EDIT = ["ord", "path", "byte_start", "byte_end", "new_text", "verify_kind", "verify_text", "verify_hash", "sentinel"]


def gated(patches: DataFrame, version: str) -> DataFrame:
    """+ gate and gate_reason. Requirements are few distinct strings, parsed on the driver; a config's gate comes before a patch's."""
    reqs = [r[0] for r in patches.select("version_range").union(patches.select("version")).distinct().collect() if r[0] is not None]
    v = F.lit(version)

    def one(c: Column) -> Column:
        out = F.when(c.isNull(), F.lit("ok"))
        for r in reqs:
            out = out.when(c == r, semver.gate(v, r))
        return out.otherwise(F.lit("ok"))

    d = patches.withColumn("_a", one(F.col("version_range"))).withColumn("_b", one(F.col("version")))
    gate = F.when(F.col("_a") != "ok", F.col("_a")).otherwise(F.col("_b"))
    reason = F.when(F.col("_a") == "skipped", F.format_string("version range %s not satisfied by workspace %s", "version_range", F.lit(version))).when(
        F.col("_b") == "skipped", F.format_string("patch version %s not satisfied by workspace %s", "version", F.lit(version))
    )
    return d.withColumn("gate", gate).withColumn("gate_reason", reason).drop("_a", "_b")


def _found(d: DataFrame, start, end, new_text, expected, sentinel=False, kind=None, text=None, hashed=None) -> DataFrame:
    k, t = E.verification(expected)
    return d.select(
        "ord", "path", start.alias("byte_start"), end.alias("byte_end"), new_text.alias("new_text"), (kind if kind is not None else k).alias("verify_kind"), (text if text is not None else t).alias("verify_text"),
        (hashed if hashed is not None else F.lit(None).cast("decimal(20,0)")).alias("verify_hash"), expected.alias("expected"), F.lit(sentinel).alias("sentinel"),
    )


def _located(d: DataFrame, kind: str, count=None, reason=None) -> DataFrame:
    return d.select("ord", F.lit(kind).alias("error_kind"), (count if count is not None else F.lit(None)).cast("bigint").alias("match_count"), (reason if reason is not None else F.lit(None)).cast("string").alias("reason"))


def _text(d: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Text search and replace. The dear fuzzy branch gets only rows that have no exact match."""
    search, new = F.col("query.search"), F.col("operation.text")
    d = d.where("query.type = 'text'").withColumn("_has", F.contains("content", search))
    wrong = d.where("operation.type <> 'replace'")
    d = d.where("operation.type = 'replace'")
    there, gone = d.where("_has").withColumn("_n", occurrences(F.col("content"), search)), d.where("not _has")
    done = gone.where(F.contains("content", new))
    open_ = gone.where(~F.contains("content", new))
    asks = F.col("query.fuzzy_threshold").isNotNull() | F.col("query.fuzzy_expansion").isNotNull()
    fuzzy = open_.where(asks)
    best = fuzzy_best(
        fuzzy.select("ord", search.alias("search"), "content", F.coalesce("query.fuzzy_threshold", F.lit(DEFAULT_THRESHOLD)).alias("threshold"), F.coalesce("query.fuzzy_expansion", F.lit(0)).alias("expansion")), ["ord"]
    ).select("ord", "byte_start", "byte_end", "matched_text")
    fz = fuzzy.join(best, "ord", "left")
    zero = F.lit(0).cast("bigint")
    given = F.col("verify.method")
    hexed = hex_to_decimal(F.col("verify.expected"))

    def hit(x: DataFrame, start: Column, end: Column, expected: Column) -> list[DataFrame]:
        auto_k, auto_t = E.verification(expected)
        kind = F.when(given == "exact_match", "exact").when(given == "hash", "hash").otherwise(auto_k)
        text = F.when(given == "exact_match", F.col("verify.expected_text")).when(given == "hash", F.lit(None)).otherwise(auto_t)
        ok = x.where(~((given == "hash") & hexed.isNull()) | given.isNull())
        return [_found(ok, start, end, new, expected, kind=kind, text=text, hashed=F.when(given == "hash", hexed))]

    start = byte_start(F.col("content"), search)
    badhash = (given == "hash") & hexed.isNull()
    one = there.where("_n = 1")
    found = hit(one, start, start + F.octet_length(search), search) + hit(fz.where("byte_start is not null"), F.col("byte_start"), F.col("byte_end"), F.col("matched_text"))
    found.append(_found(done, zero, zero, F.lit(""), F.lit(""), True))
    errors = [
        _located(wrong, "Unsupported"), _located(there.where("_n > 1"), "AmbiguousMatch", F.col("_n")), _located(open_.where(~asks), "NoMatch"), _located(fz.where("byte_start is null"), "NoMatch"),
        _located(one.where(badhash), "BadHash"), _located(fz.where(F.col("byte_start").isNotNull() & badhash), "BadHash"),
    ]
    return found, errors


def _structural(d: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """ast-grep patterns and tree-sitter targets -> spans -> uniqueness -> edit."""
    d = d.where("query.type in ('ast-grep', 'tree-sitter')")
    tree = d.where("query.type = 'tree-sitter'")
    bad, good = [], []
    for (p,) in tree.select("query.pattern").distinct().collect():
        try:
            structure.target(p)
            good.append(p)
        except Unsupported as e:
            bad.append((p, str(e)))
    grep = d.where("query.type = 'ast-grep'").select("path", "content", "query.pattern").distinct()
    every = structure.matches(grep.select("path", "content").distinct(), grep.select("path", "pattern")).select("path", "pattern", "byte_start", "byte_end")
    if good:
        # one pass of the reader over the files that have such patches, one join to their targets
        nodes = structure.node_table(tree.select("path", "content").dropDuplicates(["path"]))
        found = structure.locate_all(nodes, good, tree.select("path", F.col("query.pattern").alias("target")).distinct())
        every = every.unionByName(found.select("path", F.col("target").alias("pattern"), "byte_start", "byte_end"))
    per = every.groupBy("path", "pattern").agg(F.count("*").alias("_n"), F.min("byte_start").alias("byte_start"), F.min("byte_end").alias("byte_end"))
    unsupported = F.col("query.pattern").isin(*[p for p, _ in bad]) & (F.col("query.type") == "tree-sitter") if bad else F.lit(False)
    j = d.where(~unsupported).withColumn("pattern", F.col("query.pattern")).join(per, ["path", "pattern"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    text, kind = F.col("operation.text"), F.col("operation.type")
    there = F.contains("content", text) | F.contains("content", F.regexp_replace(text, r"\n+\z", ""))
    none = j.where("_n = 0")
    done = none.where((kind == "delete") | F.coalesce(there, F.lit(False)))
    one = j.where("_n = 1").withColumn("_now", E.current(F.col("content"), F.col("byte_start"), F.col("byte_end")))
    new = F.when(kind == "replace", align_newline(text, F.col("_now"))).otherwise(F.coalesce("operation.insert_comment", F.lit("")))
    given = F.col("verify.method")
    k = F.when(given == "hash", "hash").otherwise("exact")
    t = F.when(given == "exact_match", F.col("verify.expected_text")).when(given == "hash", F.lit(None)).otherwise(F.col("_now"))
    hexed = hex_to_decimal(F.col("verify.expected"))
    badhash = (given == "hash") & hexed.isNull()
    zero = F.lit(0).cast("bigint")
    found = [_found(one.where(~F.coalesce(badhash, F.lit(False))), F.col("byte_start"), F.col("byte_end"), new, F.col("_now"), kind=k, text=t, hashed=F.when(given == "hash", hexed)), _found(done, zero, zero, F.lit(""), F.lit(""), True)]
    errors = [_located(none.where(~((kind == "delete") | F.coalesce(there, F.lit(False)))), "NoMatch"), _located(j.where("_n > 1"), "AmbiguousMatch", F.col("_n")), _located(one.where(badhash), "BadHash")]
    if bad:
        errors.append(_located(d.where(unsupported), "Unsupported", reason=F.col("query.pattern")))
    return found, errors


def _toml(d: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    d = d.where("query.type = 'toml'")
    flat = F.struct(*[F.col(f"operation.{c}").alias(c) for c in ("type", "text", "value", "new_key", "after_section", "before_section", "at_end", "at_beginning")])
    q = F.struct(*[F.col(f"query.{c}").alias(c) for c in ("section", "key", "ensure_absent", "ensure_present")])
    c = F.struct(F.col("constraint.ensure_absent").alias("ensure_absent"), F.col("constraint.ensure_present").alias("ensure_present"))
    p = d.withColumn("p", toml_spans.plan_edits(F.col("content"), q, flat, c))
    ok = p.where("p.error is null")
    now = E.current(F.col("content"), F.col("p.byte_start"), F.col("p.byte_end"))
    found = [_found(ok.where("p.noop is null"), F.col("p.byte_start"), F.col("p.byte_end"), F.col("p.new_text"), now), _found(ok.where("p.noop is not null"), F.col("p.byte_start"), F.col("p.byte_end"), F.lit(""), F.lit(""), True)]
    return found, [_located(p.where("p.error is not null"), "TomlOperation", reason=F.col("p.error"))]


def plan(patches: DataFrame, files: DataFrame, version: str, root: str = "", mode: str = "apply") -> dict[str, DataFrame]:
    """results (RESULT), edits (with outcome), files (path, content, changed).

    mode "apply": a version skip comes before a missing file; "check": a missing file comes first.
    """
    d = gated(patches, version).withColumn("path", resolve(F.col("file"), root, F.col("workspace_relative")) if root else F.col("file"))
    j = d.join(files.select("path", "content"), "path", "left")
    missing = F.col("content").isNull()
    skip = F.col("gate") != "ok"
    first = (skip & ~missing) if mode == "check" else skip
    gone = j.where(missing & (F.lit(mode == "check") | ~skip))
    gate_rows = j.where(first)
    live = j.where(~missing & ~skip)
    found, errors = [], []
    # the query types are at hand on the driver, and a branch without patches would only lengthen the plan
    types = {r[0] for r in patches.select("query.type").distinct().collect()}
    for branch, own in ((_text, {"text"}), (_structural, {"ast-grep", "tree-sitter"}), (_toml, {"toml"})):
        if not types & own:
            continue
        f, e = branch(live)
        found += f
        errors += e
    if not found:
        raise ValueError("no patch has a known query type")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # what does nothing takes no part in overlap or atomicity
    real = E.with_hashes(every.where("not sentinel")).drop("expected")
    ran = E.run_edits(files, real).select("ord", "path", "byte_start", "byte_end", "new_text", "status", "bytes_changed", "error_kind")
    failed = errors[0]
    for e in errors[1:]:
        failed = failed.unionByName(e)
    failed = failed.unionByName(_located(gone, "NoMatch"))
    none = F.lit(None).cast("string")
    n = F.lit(None).cast("bigint")
    status = (
        ran.select("ord", "status", none.alias("reason"), "error_kind", n.alias("match_count"))
        .unionByName(every.where("sentinel").select("ord", F.lit("AlreadyApplied").alias("status"), none.alias("reason"), none.alias("error_kind"), n.alias("match_count")))
        .unionByName(failed.select("ord", F.lit("Failed").alias("status"), "reason", "error_kind", "match_count"))
        .unionByName(gate_rows.select("ord", F.when(F.col("gate") == "skipped", "SkippedVersion").otherwise("Failed").alias("status"), F.col("gate_reason").alias("reason"), F.when(F.col("gate") != "skipped", "Version").alias("error_kind"), n.alias("match_count")))
    )
    results = patches.select("ord", F.col("id").alias("patch_id"), "file").join(status, "ord").select(*RESULT)
    return {"results": results.orderBy("ord"), "edits": ran, "files": E.applied(files, real)}


def cli_status(results: DataFrame) -> DataFrame:
    """As the status command words it."""
    s = F.col("status")
    return results.withColumn("shown", F.when(s == "AlreadyApplied", "APPLIED").when(s == "SkippedVersion", "SKIPPED").otherwise("NOT APPLIED"))


def verify_status(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.withColumn("shown", F.when(s == "AlreadyApplied", "verified").when(s == "SkippedVersion", "skipped").otherwise("mismatch"))


def counts(results: DataFrame, column: str = "status") -> DataFrame:
    return results.groupBy(column).agg(F.count("*").alias("n"))


def exit_code(results: DataFrame, command: str = "apply") -> int:
    """1 if a patch failed (apply) or differs (verify)."""
    bad = results.where("status = 'Failed'") if command == "apply" else verify_status(results).where("shown = 'mismatch'")
    return int(not bad.isEmpty())


def run_configs(configs: list[DataFrame], files: DataFrame, version: str, root: str = "") -> tuple[DataFrame, DataFrame]:
    """Configs one after the other, each on the files the ones before left; (results, files).

    A plan reads its files several times, so the lineage is cut after each config: plans would nest else.
    """
    out = None
    for c in configs:
        p = plan(c, files, version, root)
        results, files = cut(p["results"]), cut(p["files"].select("path", "content"))
        out = results if out is None else out.unionByName(results)
    return out, files


def write_files(files: DataFrame, folder: str, root: str | None = None, forbidden: list[str] | None = None) -> None:
    """Changed files as a table under a folder, by the writer's commit protocol.

    With a root the guard is asked before anything is written: a path outside of it, or in a forbidden folder (those of
    guards.FORBIDDEN unless others are given, the home folder and relative ones resolved), raises and nothing is written.
    """
    changed = files.where("changed").select("path", "content")
    if root is not None:
        folders = [os.path.join(root, os.path.expanduser(f)) for f in (FORBIDDEN if forbidden is None else forbidden)]
        bad = changed.select("path", guard(F.col("path"), root, folders).alias("verdict")).where("verdict <> 'ok'").first()
        if bad is not None:
            raise PermissionError(f"{bad.path}: {bad.verdict}")
    changed.write.mode("overwrite").parquet(folder)


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, line_no, tag (' ', '-', '+'), line of changed files: a longest common subsequence per file."""

    def diff(path: str, a: str, b: str):
        for n, x in enumerate(difflib.ndiff((a or "").splitlines(), (b or "").splitlines())):
            if x[0] in " -+":
                yield n, x[0], x[2:]

    d = before.select("path", F.col("content").alias("a")).join(after.select("path", F.col("content").alias("b")), "path").where("a <> b")
    return per_row(d, ["path"], "line_no int, tag string, line string", diff)
