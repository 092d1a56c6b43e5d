"""Commit patches -> star schema -> views and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPLITLINES, byte_count, line_count, prefixed

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
FILE = r"^diff --git a/(.*) b/(.*)$"
#: Tables of the warehouse, with their keys.
KEYS = {
    "metadata": ["key"], "tags": ["tag_name"], "ranges": ["range_id"], "commits": ["commit_sha"], "range_commits": ["range_id", "ordinal"],
    "patch_files": ["file_patch_id"], "hunks": ["hunk_id"], "code_blocks": ["block_hash"], "block_events": ["event_id"], "commit_stats": ["commit_sha"],
}


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("bigint"))


def diff_lines(patches: DataFrame) -> DataFrame:
    """commit_sha, patch_text -> a row per line with its file, hunk and kind.

    Windows are per commit: a patch is one text already. Lines before the first file header go.
    """
    per_commit = Window.partitionBy("commit_sha").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = patches.select("commit_sha", F.posexplode(F.split("patch_text", SPLITLINES)).alias("line_no", "line"))
    d = d.withColumn("is_file", F.startswith("line", F.lit("diff --git "))).withColumn("is_at", F.startswith("line", F.lit("@@ ")) & ~F.col("is_file"))
    d = d.withColumn("file_index", F.count_if("is_file").over(per_commit)).where("file_index > 0")
    per_file = Window.partitionBy("commit_sha", "file_index").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("is_hunk", F.col("is_at") & F.col("line").rlike(HUNK)).withColumn("hunk_index", F.count_if("is_hunk").over(per_file)).withColumn("at_no", F.count_if("is_at").over(per_file))
    # a malformed @@ line ends a body without starting one
    return d.withColumn("in_hunk", F.coalesce(F.last(F.when(F.col("is_at"), F.col("is_hunk")), ignorenulls=True).over(per_file), F.lit(False)))


def _path(line: Column, sign: str, side: str) -> Column:
    raw = F.substring(line, F.lit(5), F.length(line))
    return F.when(F.startswith(line, F.lit(f"{sign} ")) & (raw != "/dev/null"), F.regexp_replace(raw, f"^{side}/", ""))


def patch_files(lines: DataFrame) -> DataFrame:
    """One row per file header: paths, change type, binary flag, similarity, added and deleted lines."""
    head = F.col("at_no") == 0
    line = F.col("line")

    def first(prefix: str, value: Column | None = None) -> Column:
        got = value if value is not None else F.substring(line, F.lit(len(prefix) + 1), F.length(line))
        return F.max_by(F.when(head & F.startswith(line, F.lit(prefix)), got), F.when(head & F.startswith(line, F.lit(prefix)), F.col("line_no")))

    def seen(prefix: str) -> Column:
        return F.max(F.when(head & F.startswith(line, F.lit(prefix)), F.col("line_no")))

    body = F.col("in_hunk") & ~F.col("is_at")
    g = lines.groupBy("commit_sha", "file_index").agg(
        F.max(F.when(F.col("is_file"), F.regexp_extract("line", FILE, 1))).alias("git_old"),
        F.max(F.when(F.col("is_file"), F.regexp_extract("line", FILE, 2))).alias("git_new"),
        seen("new file mode ").alias("add_at"), seen("deleted file mode ").alias("delete_at"),
        F.greatest(seen("rename from "), seen("rename to ")).alias("rename_at"), F.greatest(seen("copy from "), seen("copy to ")).alias("copy_at"),
        first("rename from ").alias("rename_from"), first("rename to ").alias("rename_to"), first("copy from ").alias("copy_from"), first("copy to ").alias("copy_to"),
        first("similarity index ", F.try_to_number(F.regexp_extract(line, r"^similarity index ([0-9]+)%$", 1), F.lit("999"))).cast("int").alias("similarity"),
        F.max((head & (F.startswith(line, F.lit("Binary files ")) | F.startswith(line, F.lit("GIT binary patch")))).cast("int")).alias("is_binary"),
        first("--- ", _path(line, "---", "a")).alias("minus"), first("+++ ", _path(line, "+++", "b")).alias("plus"),
        F.count_if(body & F.startswith(line, F.lit("+"))).alias("additions"), F.count_if(body & F.startswith(line, F.lit("-"))).alias("deletions"),
    )
    last = F.greatest("add_at", "delete_at", "rename_at", "copy_at")
    kind = F.when(last.isNull(), "modify").when(last == F.col("add_at"), "add").when(last == F.col("delete_at"), "delete").when(last == F.col("rename_at"), "rename").otherwise("copy")
    old = F.coalesce("minus", "rename_from", "copy_from", "git_old", F.lit(""))
    new = F.coalesce("plus", "rename_to", "copy_to", "git_new", F.lit(""))
    return g.select(
        F.xxhash64("commit_sha", "file_index").alias("file_patch_id"), "commit_sha", F.col("file_index").cast("bigint").alias("file_index"), old.alias("old_path"), new.alias("new_path"),
        kind.alias("change_type"), "is_binary", "similarity", F.col("additions").cast("bigint").alias("additions"), F.col("deletions").cast("bigint").alias("deletions"),
    )


def hunks(lines: DataFrame) -> DataFrame:
    """One row per hunk; missing counts are 1; the text is the header and the body."""
    body = lines.where("in_hunk")
    g = body.groupBy("commit_sha", "file_index", "hunk_index").agg(
        F.max(F.when(F.col("is_hunk"), F.col("line"))).alias("header_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("hunk_text"),
    )

    def n(k: int) -> Column:
        return F.coalesce(_int(F.regexp_extract("header_text", HUNK, k)), F.lit(1).cast("bigint"))

    return g.select(
        F.xxhash64("commit_sha", "file_index", "hunk_index").alias("hunk_id"), F.xxhash64("commit_sha", "file_index").alias("file_patch_id"), "commit_sha",
        F.col("file_index").cast("bigint").alias("file_index"), F.col("hunk_index").cast("bigint").alias("hunk_index"),
        n(1).alias("old_start"), n(2).alias("old_lines"), n(3).alias("new_start"), n(4).alias("new_lines"), "header_text", "hunk_text",
    )


def blocks(lines: DataFrame) -> DataFrame:
    """Maximal runs of added or deleted lines of a hunk: gaps and islands with running counters."""
    in_hunk = Window.partitionBy("commit_sha", "file_index", "hunk_index").orderBy("line_no")
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    d = lines.where("in_hunk")
    start = {k: F.max(F.when(F.col("is_hunk"), _int(F.regexp_extract("line", HUNK, k)))).over(Window.partitionBy("commit_sha", "file_index", "hunk_index")) for k in (1, 3)}
    d = d.withColumn("old_start", start[1]).withColumn("new_start", start[3]).where("not is_hunk")
    sign = F.substring("line", 1, 1)
    d = d.withColumn("op", F.when(sign == "+", "add").when(sign == "-", "del"))
    d = d.withColumn("old_step", (sign.isin("-", " ")).cast("int")).withColumn("new_step", (sign.isin("+", " ")).cast("int"))
    d = d.withColumn("at_old", F.col("old_start") + F.coalesce(F.sum("old_step").over(before), F.lit(0))).withColumn("at_new", F.col("new_start") + F.coalesce(F.sum("new_step").over(before), F.lit(0)))
    d = d.withColumn("starts", F.col("op").isNotNull() & ~F.col("op").eqNullSafe(F.lag("op").over(in_hunk)))
    d = d.withColumn("block_index", F.count_if("starts").over(in_hunk.rowsBetween(Window.unboundedPreceding, 0))).where("op is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", F.lit(2), F.length("line")).alias("text")))), lambda x: x["text"]), "\n")
    g = d.groupBy("commit_sha", "file_index", "hunk_index", "block_index").agg(
        F.first("op").alias("op"), F.min("at_old").alias("start_old"), F.min("at_new").alias("start_new"), F.count("*").alias("line_count"), text.alias("content")
    )
    diff = F.when(F.col("op") == "add", prefixed(F.col("content"), "+")).otherwise(prefixed(F.col("content"), "-"))
    return g.select(
        "commit_sha", *[F.col(c).cast("bigint").alias(c) for c in ("file_index", "hunk_index", "block_index")], "op", "start_old", "start_new", "line_count", "content",
        F.sha2("content", 256).alias("block_hash"), diff.alias("block_diff"),
    )


def code_blocks(found: DataFrame) -> DataFrame:
    """Each content once, by its digest."""
    one = found.groupBy("block_hash").agg(F.min("content").alias("content"))
    return one.select("block_hash", "content", line_count(F.col("content")).alias("line_count"), byte_count(F.col("content")).alias("byte_count"))


def commit_stats(files: DataFrame, hunk_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counters per commit, also of commits whose files have no hunk."""
    f = files.groupBy("commit_sha").agg(F.count("*").alias("files_changed"), F.sum("additions").alias("line_additions"), F.sum("deletions").alias("line_deletions"))
    h = hunk_rows.groupBy("commit_sha").agg(F.count("*").alias("hunk_count"))
    b = found.groupBy("commit_sha").agg(F.count_if(F.col("op") == "add").alias("block_additions"), F.count_if(F.col("op") == "del").alias("block_deletions"))
    out = f.join(h, "commit_sha", "left").join(b, "commit_sha", "left")
    return out.select("commit_sha", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files_changed", "hunk_count", "line_additions", "line_deletions", "block_additions", "block_deletions")])


def warehouse(tags: DataFrame, ranges: DataFrame, range_commits: DataFrame, commits: DataFrame, patches: DataFrame) -> dict[str, DataFrame]:
    """All tables from the source rows; patches: commit_sha, patch_text. A commit is parsed once, however many ranges hold it."""
    commits = commits.dropDuplicates(["commit_sha"])
    lines = diff_lines(patches.dropDuplicates(["commit_sha"]))
    files, hunk_rows, found = patch_files(lines), hunks(lines), blocks(lines)
    events = found.join(range_commits.select("range_id", "commit_sha", "ordinal"), "commit_sha")
    order = Window.partitionBy("range_id").orderBy("ordinal", "file_index", "hunk_index", "block_index")
    first = ranges.select("range_id", "seq").distinct()
    events = events.join(first, "range_id").withColumn("event_id", F.col("seq") * F.lit(1 << 32) + F.row_number().over(order))
    events = events.select(
        "event_id", "range_id", "commit_sha", F.xxhash64("commit_sha", F.col("file_index")).alias("file_patch_id"), F.xxhash64("commit_sha", F.col("file_index"), F.col("hunk_index")).alias("hunk_id"),
        "block_index", "op", "start_old", "start_new", "line_count", "block_hash", "block_diff",
    )
    return {
        "tags": tags, "ranges": ranges, "range_commits": range_commits, "commits": commits, "patch_files": files, "hunks": hunk_rows.drop("commit_sha", "file_index"),
        "code_blocks": code_blocks(found), "block_events": events, "commit_stats": commit_stats(files, hunk_rows, found),
    }


def commit_patch_summary(t: dict[str, DataFrame]) -> DataFrame:
    out = t["range_commits"].join(t["ranges"], "range_id").join(t["commits"], "commit_sha").join(t["commit_stats"], "commit_sha")
    return out.select(
        F.col("seq").alias("range_seq"), "from_tag", "to_tag", F.col("ordinal").alias("commit_ordinal"), "commit_sha", "author_date", "author_name", "subject",
        "files_changed", "hunk_count", "line_additions", "line_deletions", "block_additions", "block_deletions",
    )


#: What the timeline joins to the events: table, keys, columns.
TIMELINE = [
    ("ranges", ["range_id"], ["seq", "from_tag", "to_tag"]), ("range_commits", ["range_id", "commit_sha"], ["ordinal"]), ("commits", ["commit_sha"], ["author_date", "subject"]),
    ("patch_files", ["file_patch_id"], ["file_index", "old_path", "new_path", "change_type"]), ("hunks", ["hunk_id"], ["hunk_index"]), ("code_blocks", ["block_hash"], ["content AS block_content"]),
]


def block_timeline(t: dict[str, DataFrame]) -> DataFrame:
    """Every event with its range, commit, file, hunk and block. Of a table that ``t`` lacks, the events carry the columns already; keys are of any type."""
    out = t["block_events"].withColumnRenamed("line_count", "event_lines")
    for name, keys, columns in TIMELINE:
        if name in t:
            out = out.join(t[name].selectExpr(*keys, *columns), keys)
    return out.select(
        "event_id", F.col("seq").alias("range_seq"), "from_tag", "to_tag", F.col("ordinal").alias("commit_ordinal"), "commit_sha", "author_date", "subject", "file_index", "old_path", "new_path",
        "change_type", "hunk_index", "block_index", "op", "start_old", "start_new", F.col("event_lines").alias("line_count"), "block_hash", "block_content", "block_diff",
    )


SUMS = ["files_changed", "hunks", "line_additions", "line_deletions", "block_additions", "block_deletions"]


def range_summary(t: dict[str, DataFrame]) -> DataFrame:
    """Per range, also of ranges without commits: distinct commits and sums, 0 where there are none."""
    stats = t["commit_stats"].withColumnRenamed("hunk_count", "hunks")
    per = t["range_commits"].join(stats, "commit_sha", "left").groupBy("range_id").agg(F.count_distinct("commit_sha").alias("commits"), *[F.sum(c).alias(c) for c in SUMS])
    out = t["ranges"].join(per, "range_id", "left")
    return out.select("range_id", "seq", "from_tag", "to_tag", "range_expr", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("commits", *SUMS)])


def block_lifecycle(t: dict[str, DataFrame]) -> DataFrame:
    """Per block, also of blocks without events: the first and last commit come from the event order in the one
    aggregation, where correlated subqueries would read the events again for each block."""
    e = t["block_events"].join(t["range_commits"].select("range_id", "commit_sha"), ["range_id", "commit_sha"], "left_semi").join(t["ranges"].select("range_id"), "range_id", "left_semi")
    add, gone = F.col("op") == "add", F.col("op") == "del"
    per = e.groupBy("block_hash").agg(
        F.count_if(add).alias("add_events"), F.count_if(gone).alias("del_events"), F.sum(F.when(add, F.col("line_count")).otherwise(-F.col("line_count"))).alias("net_lines"),
        F.min_by("commit_sha", "event_id").alias("first_commit"), F.max_by("commit_sha", "event_id").alias("last_commit"),
    )
    out = t["code_blocks"].join(per, "block_hash", "left")
    return out.select(
        "block_hash", "line_count", "byte_count", F.coalesce("add_events", F.lit(0)).cast("bigint").alias("add_events"), F.coalesce("del_events", F.lit(0)).cast("bigint").alias("del_events"),
        F.col("net_lines").cast("bigint").alias("net_lines"), F.when(F.col("net_lines") > 0, 1).otherwise(0).alias("is_active_estimate"), "first_commit", "last_commit",
    )


def every_event(t: dict[str, DataFrame]) -> DataFrame:
    return block_timeline(t).orderBy("range_seq", "commit_ordinal", "file_index", "hunk_index", "block_index")


def track_block(t: dict[str, DataFrame], block_hash: str) -> DataFrame:
    """Events of one block; the filter reaches the events before any join."""
    return block_timeline(t | {"block_events": t["block_events"].where(F.col("block_hash") == block_hash)}).orderBy("event_id")


def track_file(t: dict[str, DataFrame], path: str) -> DataFrame:
    return block_timeline(t | {"patch_files": t["patch_files"].where((F.col("old_path") == path) | (F.col("new_path") == path))}).orderBy("event_id")


def volatile_files(t: dict[str, DataFrame], top: int = 100) -> DataFrame:
    """Files by their block events: the events need only their file's path."""
    e = t["block_events"].join(t["patch_files"].select("file_patch_id", F.coalesce(F.nullif("new_path", F.lit("")), "old_path").alias("file_path")), "file_patch_id")
    g = e.groupBy("file_path").agg(F.count("*").alias("block_events"), F.count_if(F.col("op") == "add").alias("additions"), F.count_if(F.col("op") == "del").alias("deletions"))
    return g.orderBy(F.desc("block_events"), "file_path").limit(top)


def lifecycle_top(t: dict[str, DataFrame], top: int = 200) -> DataFrame:
    return block_lifecycle(t).orderBy(F.desc(F.col("add_events") + F.col("del_events")), "block_hash").limit(top)


def totals(t: dict[str, DataFrame]) -> DataFrame:
    """Row counts of six tables."""
    names = ["ranges", "commits", "patch_files", "hunks", "block_events", "code_blocks"]
    parts = [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_markdown(t: dict[str, DataFrame]) -> str:
    """The counts and the ranges as a page; only aggregates reach the driver."""
    counts = "\n".join(f"- {r.table_name}: {r.n}" for r in totals(t).collect())
    head = "| range | commits | files | hunks | + | - |\n|-|-|-|-|-|-|"
    rows = "\n".join(f"| {r.from_tag} to {r.to_tag} | {r.commits} | {r.files_changed} | {r.hunks} | {r.line_additions} | {r.line_deletions} |" for r in range_summary(t).orderBy("seq").collect())
    return f"# Patch timeline\n\n{counts}\n\n{head}\n{rows}\n"


def save(t: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Every table as Parquet; overwriting is the reset. Keys are made unique as the loader would."""
    for name, df in t.items():
        (df.dropDuplicates(KEYS[name]) if name in KEYS else df).write.mode(mode).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in KEYS if name != "metadata"}


def key_violations(t: dict[str, DataFrame]) -> DataFrame:
    """(table_name, duplicates): what primary keys would refuse."""
    out = None
    for name, key in KEYS.items():
        if name in t:
            one = t[name].groupBy(*key).count().where("count > 1").agg(F.count("*").alias("duplicates")).select(F.lit(name).alias("table_name"), "duplicates")
            out = one if out is None else out.unionByName(one)
    return out


def register(t: dict[str, DataFrame]) -> None:
    """Tables and views under their names, for SQL."""
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    for name, f in (("v_commit_patch_summary", commit_patch_summary), ("v_block_timeline", block_timeline), ("v_range_summary", range_summary), ("v_block_lifecycle", block_lifecycle)):
        f(t).createOrReplaceTempView(name)


#: The query pack, for spark.sql(sql, args=...).
QUERY_PACK = {
    "range_overview": "SELECT * FROM v_range_summary ORDER BY seq",
    "commit_overview": "SELECT * EXCEPT (author_name) FROM v_commit_patch_summary ORDER BY range_seq, commit_ordinal",
    "every_event": "SELECT * FROM v_block_timeline ORDER BY range_seq, commit_ordinal, file_index, hunk_index, block_index",
    "track_block": "SELECT * FROM v_block_timeline WHERE block_hash = :hash ORDER BY event_id",
    "track_file": "SELECT * FROM v_block_timeline WHERE old_path = :path OR new_path = :path ORDER BY event_id",
    "volatile_files": "SELECT coalesce(nullif(new_path, ''), old_path) AS file_path, count(*) AS block_events, count_if(op = 'add') AS additions, count_if(op = 'del') AS deletions FROM v_block_timeline GROUP BY 1 ORDER BY block_events DESC, file_path LIMIT 100",
    "lifecycle_top": "SELECT * FROM v_block_lifecycle ORDER BY add_events + del_events DESC, block_hash LIMIT 200",
}
