"""Edits: verify, find overlaps, fold bottom-up, report. All spans are bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import xxh3_64, xxh3_64_each

HASH_FROM = 1024  # bytes; a longer text is verified by its hash


def current(content: Column, start: Column, end: Column) -> Column:
    """The bytes of a span, as text."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def verification(text: Column) -> tuple[Column, Column]:
    """(kind, text to compare): what a text longer than 1024 bytes is checked by is its hash."""
    long = F.octet_length(text) > HASH_FROM
    return F.when(long, "hash").otherwise("exact"), F.when(~long, text)


def with_hashes(edits: DataFrame) -> DataFrame:
    """Fill verify_hash from expected where the kind is hash and none is given; only such rows run the UDF."""
    return edits.withColumn("verify_hash", F.when((F.col("verify_kind") == "hash") & F.col("verify_hash").isNull(), xxh3_64(F.col("expected"))).otherwise(F.col("verify_hash")))


def overlaps(judged: DataFrame) -> DataFrame:
    """+ overlap: whether any two edits of the file overlap. From the end up: the lower one must end where the higher starts."""
    down = Window.partitionBy("path").orderBy(F.desc("byte_start"), "ord")
    d = judged.withColumn("_over", F.coalesce(F.lead("byte_end").over(down) > F.col("byte_start"), F.lit(False)))
    return d.withColumn("overlap", F.max("_over").over(Window.partitionBy("path"))).drop("_over")


def verdicts(files: DataFrame, edits: DataFrame, how: str = "inner") -> DataFrame:
    """path, content, edits (array, from the end up, each with its state: apply, already, bad-range, mismatch), overlap, failed: a row per file.

    Edits are gathered by path before the files are joined, so that a file's text goes through the one shuffle once, whatever its edits,
    and no window carries it. A span that already reads as wanted passes whatever it should have read. An error in
    one edit of a file, or two that overlap, fails all its edits. how "left": files without edits too.
    """
    own = [c for c in edits.columns if c not in ("path", "ord")]
    per = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("byte_start")).alias("k"), "ord", *own))).alias("es"))
    d = files.select("path", "content").join(per, "path", how)
    size = F.octet_length("content")

    def looked(raw: Column) -> Column:
        def one(x: Column) -> Column:
            bad = (x["byte_start"] > x["byte_end"]) | (x["byte_end"] > size) | (x["byte_start"] < 0)
            return F.struct(x.alias("e"), bad.alias("bad"), F.when(~bad, F.decode(F.substring(raw, (x["byte_start"] + 1).cast("int"), (x["byte_end"] - x["byte_start"]).cast("int")), "UTF-8")).alias("before"))

        return F.transform("es", one)

    # the text's bytes are made once, not for each edit
    d = d.withColumn("seen", F.transform(F.array(F.encode("content", "UTF-8")), looked)[0])
    hashed = lambda x: (x["e"]["verify_kind"] == "hash") & ~x["bad"] & (x["before"] != x["e"]["new_text"])
    d = d.withColumn("hashes", xxh3_64_each(F.when(F.exists("seen", hashed), F.transform("seen", lambda x: F.when(hashed(x), x["before"])))))

    def judged(x: Column, h: Column) -> Column:
        e = x["e"]
        ok = F.when(e["verify_kind"] == "exact", x["before"] == e["verify_text"]).when(e["verify_kind"] == "hash", h == e["verify_hash"]).otherwise(F.lit(True))
        state = F.when(x["bad"], "bad-range").when(x["before"] == e["new_text"], "already").when(~F.coalesce(ok, F.lit(False)), "mismatch").otherwise("apply")
        return F.struct(e["ord"].alias("ord"), *[e[c].alias(c) for c in own], state.alias("state"))

    # hashes go along as an argument: a Python function can't stand inside of a lambda
    d = d.select("path", "content", F.zip_with("seen", F.coalesce("hashes", F.array().cast("array<decimal(20,0)>")), judged).alias("edits"))
    pair = F.zip_with(F.slice("edits", F.lit(1), F.size("edits") - 1), F.slice("edits", F.lit(2), F.size("edits") - 1), lambda x, y: y["byte_end"] > x["byte_start"])
    d = d.withColumn("overlap", F.when(F.size("edits") > 1, F.exists(pair, lambda x: x)).otherwise(F.lit(False)))
    return d.withColumn("failed", F.col("overlap") | F.exists("edits", lambda x: x["state"].isin("bad-range", "mismatch")))


def outcomes(verdict: DataFrame) -> DataFrame:
    """A row per edit: its columns, status (Applied, AlreadyApplied, Failed), bytes_changed (the new text's length, as reported), error_kind."""
    d = verdict.select("path", "overlap", "failed", F.explode("edits").alias("e")).select("path", "e.*", "overlap", "failed")
    status = F.when(F.col("failed"), "Failed").when(F.col("state") == "already", "AlreadyApplied").otherwise("Applied")
    kind = F.when(~F.col("failed"), F.lit(None).cast("string")).when(F.col("state") == "mismatch", "BeforeTextMismatch").when(F.col("state") == "bad-range", "InvalidByteRange").when(F.col("overlap"), "Overlap").otherwise("FileFailed")
    return d.withColumn("status", status).withColumn("bytes_changed", F.when(status == "Applied", F.octet_length("new_text")).otherwise(0).cast("bigint")).withColumn("error_kind", kind)


def spliced(content: Column, edits: Column) -> Column:
    """content with edits (array of struct: s, e, text, sorted from the end up) spliced in, in bytes."""
    raw = F.encode(content, "UTF-8")

    def step(acc: Column, x: Column) -> Column:
        tail = F.substring(acc, (x["e"] + 1).cast("int"), F.octet_length(acc))
        return F.concat(F.substring(acc, F.lit(1), x["s"].cast("int")), F.encode(x["text"], "UTF-8"), tail)

    return F.decode(F.aggregate(edits, raw, step), "UTF-8")


def patched(files: DataFrame, done: DataFrame) -> DataFrame:
    """path, content, changed: files with their applied edits. Of equal starts the config order holds, so the later text comes first."""
    parts = done.where("status = 'Applied'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("byte_start")).alias("k"), "ord", F.col("byte_start").alias("s"), F.col("byte_end").alias("e"), F.col("new_text").alias("text")))).alias("edits"))
    d = files.join(parts, "path", "left")
    new = F.when(F.col("edits").isNull(), F.col("content")).otherwise(spliced(F.col("content"), F.col("edits")))
    return d.select("path", new.alias("content"), F.col("edits").isNotNull().alias("changed"))


def run_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """edits -> outcomes; the one shuffle of texts is on path."""
    return outcomes(verdicts(files, edits))


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, changed: the files with their edits verified and applied, in one join. Of equal starts the config order holds, so
    the later text comes first."""
    v = verdicts(files, edits, "left")
    todo = F.when(~F.col("failed"), F.filter("edits", lambda x: x["state"] == "apply"))
    v = v.select("path", "content", F.transform(todo, lambda x: F.struct(x["byte_start"].alias("s"), x["byte_end"].alias("e"), x["new_text"].alias("text"))).alias("todo"))
    changed = F.coalesce(F.size("todo") > 0, F.lit(False)) & F.col("todo").isNotNull()
    return v.select("path", F.when(changed, spliced(F.col("content"), F.col("todo"))).otherwise(F.col("content")).alias("content"), changed.alias("changed"))


def new_errors(after: DataFrame, before: DataFrame) -> DataFrame:
    """Syntax errors an edit brought: spans of after that before doesn't have."""
    return after.join(before, ["path", "byte_start", "byte_end"], "left_anti")


def expand_captures(template: Column, captures: Column) -> Column:
    """A template with $NAME and $$$NAME replaced from a map; variadic names first, longer names first, so that no
    placeholder is cut short by another (a deliberate order: names taken as they come could cut one another short)."""
    entries = F.reverse(F.array_sort(F.transform(F.map_entries(captures), lambda x: F.struct(F.length(x["key"]).alias("n"), x["key"].alias("key"), x["value"].alias("value")))))
    many = F.aggregate(entries, template, lambda acc, x: F.replace(acc, F.concat(F.lit("$$$"), x["key"]), x["value"]))
    return F.aggregate(entries, many, lambda acc, x: F.replace(acc, F.concat(F.lit("$"), x["key"]), x["value"]))
