"""Where a text stands in a content: exact, then fuzzy over line windows. Spans are bytes, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_start, occurrences

DEFAULT_THRESHOLD = 0.85
MAX_EXPANSION = 200


def dealt(files: DataFrame) -> DataFrame:
    """files over as many tasks as there are cores, if a plain scan comes in fewer splits; a table of many splits, and one that was
    shuffled already, stay as they are."""
    plan = files._jdf.queryExecution().executedPlan()
    cores = files.sparkSession.sparkContext.defaultParallelism
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.execute().getNumPartitions() >= cores:
        return files
    return files.repartition(cores)


def exact_hits(files: DataFrame, needles: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """needle x file rows where search stands in content, with byte span and count.

    needles: needle_id, search; files: path, content. The test is contains(), the cheapest; offsets are only
    computed for hits. A file table of fewer splits than cores is dealt out first. Needles are
    broadcast in blocks of about ``max_broadcast`` rows, after a count: one block as a rule, and a pass over the files for each.
    Patches that name their files don't come here: they join by path (see plans.engine).
    """
    small = needles.where(F.length("search") > 0).select("needle_id", "search")
    blocks = max(1, -(-small.count() // max_broadcast))
    src = dealt(files)
    out = None
    for k in range(blocks):
        block = small if blocks == 1 else small.where(F.pmod(F.xxhash64("needle_id", "search"), F.lit(blocks)) == k)
        hit = src.join(F.broadcast(block), F.contains("content", F.col("search")))
        out = hit if out is None else out.unionAll(hit)
    start = byte_start(F.col("content"), F.col("search"))
    return out.select("needle_id", "path", start.alias("byte_start"), (start + F.octet_length("search")).alias("byte_end"), occurrences(F.col("content"), F.col("search")).alias("n"))


def status_of(n: Column) -> Column:
    """Uniqueness: 0 is no match, 1 located, more ambiguous."""
    return F.when(n == 0, "NoMatch").when(n == 1, "Located").otherwise("Ambiguous")


def line_table(files: DataFrame) -> DataFrame:
    """path, line_no (from 0), line (without CR), byte_start, byte_end (without the line break): a running sum of lengths."""
    d = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0)).cast("bigint")
    return d.select("path", "line_no", F.regexp_replace("raw", "\r$", "").alias("line"), start.alias("byte_start"), (start + F.octet_length("raw")).alias("byte_end"))


def fuzzy_best(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Best window per key. pairs: key columns, search, content, threshold, expansion.

    Windows of n to n + expansion lines compete, n being the lines of the search; the highest normalised Levenshtein score
    from the threshold on wins, ties by the smaller window, then the earlier one. The bound on the distance that
    the threshold leaves goes into levenshtein(), which stops there, after a check by length alone; the score is then exact.
    """
    # as lines() counts: a final line break ends a line and starts none
    d = pairs.withColumn("_raw", F.split("content", "\n"))
    d = d.withColumn("_lines", F.transform(F.when(F.endswith("content", F.lit("\n")) | (F.col("content") == ""), F.slice("_raw", F.lit(1), F.size("_raw") - 1)).otherwise(F.col("_raw")), lambda x: F.regexp_replace(x, "\r$", "")))
    n = F.size(F.split(F.regexp_replace("search", r"\n\z", ""), "\n"))
    d = d.withColumn("_n", F.when(F.col("search") == "", 0).otherwise(n)).where("_n > 0 and size(_lines) >= _n")
    d = d.withColumn("window_lines", F.explode(F.sequence(F.col("_n"), F.least(F.col("_n") + F.coalesce("expansion", F.lit(0)), F.size("_lines")))))
    d = d.withColumn("start_line", F.explode(F.sequence(F.lit(0), F.size("_lines") - F.col("window_lines"))))
    d = d.withColumn("matched_text", F.array_join(F.slice("_lines", F.col("start_line") + 1, F.col("window_lines")), "\n"))
    longest = F.greatest(F.length("search"), F.length("matched_text"))
    bound = F.ceil((1 - F.col("threshold")) * longest).cast("int")
    d = d.where(F.abs(F.length("search") - F.length("matched_text")) <= bound).withColumn("_distance", F.call_function("levenshtein", "search", "matched_text", bound)).where("_distance >= 0")
    # within the bound the distance is exact, and so is the score
    d = d.withColumn("score", F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.col("_distance") / longest)).where("score >= threshold")
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "window_lines", "start_line")
    d = d.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")

    def upto(k: Column) -> Column:
        return F.aggregate(F.slice("_raw", F.lit(1), k), F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x) + 1)

    return d.select(*key, upto(F.col("start_line")).alias("byte_start"), (upto(F.col("start_line") + F.col("window_lines")) - 1).alias("byte_end"), "score", "matched_text", "window_lines", "start_line")


def needle_status(hits: DataFrame, needles: DataFrame) -> DataFrame:
    """Per needle over all files: matches and status."""
    n = hits.groupBy("needle_id").agg(F.sum("n").alias("n"))
    out = needles.select("needle_id").join(n, "needle_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    return out.select("needle_id", F.col("n").alias("match_count"), status_of(F.col("n")).alias("status"))
