"""Small text tools: search, tail, statistics, lint, retention, test-log totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: extension -> (rule, pattern) of lint checks by line (fixed values).
LINT = {
    "rs": [("bare unwrap()", r"unwrap\(\)"), ("unfinished code", r"todo!|unimplemented!")],
    "py": [("wildcard import", r"import \*")],
    "sh": [("eval usage", r"eval ")],
    "bash": [("eval usage", r"eval ")],
}


def search(lines: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Lines (path, line_no, line) that hold a regular expression; line numbers as shown, from 1."""
    return lines.where(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)).select("path", (F.col("line_no") + 1).alias("line_no"), "line")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file."""
    w = Window.partitionBy("path").orderBy(F.desc("line_no"))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def tail_search(lines: DataFrame, n: int, pattern: str) -> DataFrame:
    """Matches in the last n lines, as JSON."""
    hit = search(tail(lines, n), pattern)
    return hit.select("path", "line_no", F.to_json(F.struct("path", "line_no", "line")).alias("json"))


def stats(files: DataFrame) -> DataFrame:
    """path, lines (line breaks), words, bytes."""
    return files.select(
        "path", F.regexp_count("content", F.lit("\n")).cast("bigint").alias("lines"), F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"), F.octet_length("content").cast("bigint").alias("bytes")
    )


def lint(lines: DataFrame, rules: dict | None = None) -> DataFrame:
    """path, line_no (from 1), rule: one pass over the lines, every rule of the file's extension; a file of another extension has no checks."""
    ext = F.substring_index("path", ".", -1)
    found = [F.when((ext == e) & F.col("line").rlike(p), F.lit(name)) for e, rs in (rules or LINT).items() for name, p in rs]
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return lines.select("path", (F.col("line_no") + 1).alias("line_no"), F.explode(hits).alias("rule"))


def older_than(files: DataFrame, days: int, now) -> DataFrame:
    """Files whose whole days of age exceed a number; now is a timestamp column."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("modified")) / 86_400)
    return files.where(age > days)


def over_budget(files: DataFrame, budget_mb: int) -> DataFrame:
    """The oldest files whose removal brings the total under the budget. Sizes are floored to MB one by one.

    A running sum over all files by age is a single order, so days are summed first, and only the order within a day is a window of its own.
    """
    mb = F.floor(F.floor(F.col("length") / 1024) / 1024).cast("bigint")
    d = files.withColumn("mb", mb).withColumn("day", F.to_date("modified"))
    days = d.groupBy("day").agg(F.sum("mb").alias("day_mb"))
    all_days = Window.partitionBy()
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("day_mb").over(upto), F.lit(0)).alias("before"), (F.sum("day_mb").over(all_days) - budget_mb).alias("excess"))
    w = Window.partitionBy("day").orderBy("modified", "path").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(days, "day").withColumn("freed", F.col("before") + F.coalesce(F.sum("mb").over(w), F.lit(0)))
    return d.where("freed < excess").select("path", "length", "modified", F.col("freed").cast("bigint").alias("freed"))


def binary_label(line: Column) -> Column:
    """The binary that a heading names: without its path in brackets, the words before a unit test's source, folder and extension."""
    name = line
    for gone in (r"^[ \t]+Running ", r" \(.*\)$", r"^unittests ", r"^tests/", r"\.rs$", r"/mod$"):
        name = F.regexp_replace(name, gone, "")
    return name


def log_summary(lines: DataFrame) -> DataFrame:
    """Per log and test binary: passed, failed, failed_tests (names, in order), from its result lines; lines: line_no, line, and log if there are several."""
    by = ["log"] if "log" in lines.columns else []
    d = lines.where(F.col("line").rlike(r"^     Running |^test result: |\.\.\. FAILED$"))
    head = F.when(F.startswith("line", F.lit("     Running ")), binary_label(F.col("line")))
    w = Window.partitionBy(*by).orderBy("line_no")
    d = d.withColumn("binary", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = lambda what: F.when(F.startswith("line", F.lit("test result: ")), F.regexp_extract("line", rf"(\d+) {what};", 1).try_cast("bigint"))
    failed = F.when(F.col("line").rlike(r"\.\.\. FAILED$"), F.struct("line_no", F.get(F.split(F.btrim("line"), "[ \t]+"), F.lit(1)).alias("name")))
    g = d.groupBy(*by, "binary").agg(F.sum(n("passed")).alias("passed"), F.sum(n("failed")).alias("failed"), F.sort_array(F.collect_list(failed)).alias("f"))
    return g.where("passed is not null or failed is not null").select(*by, "binary", F.coalesce("passed", F.lit(0)).cast("bigint").alias("passed"), F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"), F.transform("f", lambda x: x["name"]).alias("failed_tests"))


def log_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
