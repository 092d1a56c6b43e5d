"""Registered queries: each operator over whole tables, with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as tx
from ..operators import autofix, edits, guards, locate, structure, textops, toml_spans
from ..sources import configs
from ..sources import files as src
from ..streaming import flows as fl
from . import engine, timeline
from . import projections as pj
from .projections import SQL
from .registry import ORACLES, QUERIES

FILES = "f AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content, doc_id FROM documents)"
HITS = f"WITH {FILES}, h AS (SELECT item_id AS needle_id, path, content, text AS search, strlen(substr(content, 1, strpos(content, text) - 1)) AS s FROM benchmark JOIN f ON contains(content, text))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- text location -------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return locate.exact_hits(pj.files(spark, sf), pj.needles(spark, sf))


@query(f"{HITS} SELECT needle_id, path, CAST(s AS BIGINT) AS byte_start, CAST(s + strlen(search) AS BIGINT) AS byte_end, CAST((length(content) - length(replace(content, search, ''))) / length(search) AS BIGINT) AS n FROM h")
def text_exact_locate(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


@query(f"{HITS}, c AS (SELECT needle_id, sum(CAST((length(content) - length(replace(content, search, ''))) / length(search) AS BIGINT)) AS n FROM h GROUP BY 1) SELECT item_id AS needle_id, CAST(coalesce(n, 0) AS BIGINT) AS match_count, CASE WHEN coalesce(n, 0) = 0 THEN 'NoMatch' WHEN n = 1 THEN 'Located' ELSE 'Ambiguous' END AS status FROM benchmark LEFT JOIN c ON needle_id = item_id")
def text_status(spark: SparkSession, sf: str) -> DataFrame:
    return locate.needle_status(_hits(spark, sf), pj.needles(spark, sf))


@query(f"WITH {FILES}, w AS (SELECT path, content, lower(regexp_extract(content, '[A-Za-z]+')) AS word FROM f) SELECT path, word, CAST((length(content) - length(replace(content, word, ''))) / length(word) AS BIGINT) AS n FROM w WHERE word <> ''")
def text_match_count(spark: SparkSession, sf: str) -> DataFrame:
    d = pj.files(spark, sf).withColumn("word", F.lower(F.regexp_extract("content", "[A-Za-z]+", 0))).where("word <> ''")
    return d.select("path", "word", tx.occurrences(F.col("content"), F.col("word")).alias("n"))


LINES = f"WITH {FILES}, l AS (SELECT path, doc_id, unnest(range(len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM f)"


@query(f"{LINES}, o AS (SELECT path, line_no, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l) SELECT path, line_no, line, CAST(s AS BIGINT) AS byte_start, CAST(s + strlen(line) AS BIGINT) AS byte_end FROM o")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return locate.line_table(pj.files(spark, sf))


def _fuzzy(spark: SparkSession, sf: str, expansion: int) -> DataFrame:
    """The second line of every document, its letters e in capitals, searched again in the document. Without SQL: DuckDB's distance counts bytes."""
    d = pj.files(spark, sf).withColumn("search", F.replace(F.get(F.split("content", "\n"), F.lit(1)), F.lit("e"), F.lit("E"))).where("search <> ''")
    got = locate.fuzzy_best(d.select("path", "search", "content", F.lit(0.85).alias("threshold"), F.lit(expansion).alias("expansion")), ["path"])
    return got.select("path", "byte_start", "byte_end", F.round("score", 6).alias("score"), "window_lines", "start_line")


@query()
def fuzzy_fixed_best(spark: SparkSession, sf: str) -> DataFrame:
    return _fuzzy(spark, sf, 0)


@query()
def fuzzy_elastic_best(spark: SparkSession, sf: str) -> DataFrame:
    return _fuzzy(spark, sf, 2)


# --- edits -----------------------------------------------------------------------------------------------------------


def _edits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = pj.files(spark, sf).select("path", "content")
    h = _hits(spark, sf).where("n = 1")
    text = F.concat(F.lit("[["), F.col("needle_id").cast("string"), F.lit("]]"))
    s = pj.needles(spark, sf)
    e = h.join(s, "needle_id").select("path", F.col("needle_id").cast("int").alias("ord"), "byte_start", "byte_end", text.alias("new_text"), *[c.alias(n) for c, n in zip(edits.verification(F.col("search")), ("verify_kind", "verify_text"), strict=True)], F.lit(None).cast("decimal(20,0)").alias("verify_hash"), F.col("search").alias("expected"))
    return files, edits.with_hashes(e).drop("expected")


EDITS = f"""{HITS}, e AS (SELECT path, needle_id, s, s + strlen(search) AS e, search FROM h WHERE (length(content) - length(replace(content, search, ''))) / length(search) = 1),
o AS (SELECT *, coalesce(lead(e) OVER (PARTITION BY path ORDER BY s DESC, needle_id) > s, false) AS over FROM e), v AS (SELECT *, bool_or(over) OVER (PARTITION BY path) AS bad FROM o)"""


@query(f"{EDITS} SELECT path, CAST(needle_id AS INTEGER) AS ord, CASE WHEN bad THEN 'Failed' ELSE 'Applied' END AS status, CAST(CASE WHEN bad THEN 0 ELSE strlen('[[' || needle_id || ']]') END AS BIGINT) AS bytes_changed FROM v")
def edit_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return edits.run_edits(*_edits(spark, sf)).select("path", "ord", "status", "bytes_changed")


@query(f"{EDITS}, r AS (SELECT path, list({{'a': search, 'b': '[[' || needle_id || ']]'}} ORDER BY needle_id) AS rs FROM v WHERE NOT bad GROUP BY path) SELECT f.path, sha256(CASE WHEN r.path IS NULL THEN content ELSE list_reduce(list_prepend({{'a': content, 'b': ''}}, rs), lambda x, y: {{'a': replace(x.a, y.a, y.b), 'b': ''}}).a END) AS content_sha256, r.path IS NOT NULL AS changed FROM f LEFT JOIN r ON r.path = f.path")
def edit_apply_batch(spark: SparkSession, sf: str) -> DataFrame:
    files, e = _edits(spark, sf)
    return edits.applied(files, e).select("path", F.sha2("content", 256).alias("content_sha256"), "changed")


@query(f"{EDITS} SELECT CASE WHEN bad THEN 'Failed' ELSE 'Applied' END AS status, count(*) AS n FROM v GROUP BY 1")
def edit_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return engine.counts(edits.run_edits(*_edits(spark, sf)))


@query("WITH e AS (SELECT l_orderkey AS p, l_linenumber AS s, l_linenumber + CAST(l_quantity AS BIGINT) % 3 AS e, l_partkey AS o, l_suppkey AS x, l_extendedprice AS pr FROM lineitem), w AS (SELECT p, coalesce(lead(e) OVER (PARTITION BY p ORDER BY s DESC, o, x, pr) > s, false) AS over FROM e) SELECT p AS path, bool_or(over) AS overlap, count(*) AS n FROM w GROUP BY 1")
def edit_overlap(spark: SparkSession, sf: str) -> DataFrame:
    li = pj.read(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("byte_start"), (F.col("l_linenumber") + F.col("l_quantity").cast("bigint") % 3).alias("byte_end"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord"))
    return edits.overlaps(e).groupBy("path").agg(F.max("overlap").alias("overlap"), F.count("*").alias("n"))


@query("SELECT event_id, sha256('{\"k\":' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 0 AS VARCHAR) || '}') = sha256(replace(props, ' ', '')) AS same, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return pj.read(spark, sf, "events").select("event_id", (F.sha2(F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")), 256) == F.sha2(F.replace("props", F.lit(" "), F.lit("")), 256)).alias("same"), k.alias("k"))


# --- warehouse -------------------------------------------------------------------------------------------------------


def _view(name: str, order: str = "") -> str:
    return f"{SQL} SELECT * FROM {name}"


@query(_view("v_commit_patch_summary"))
def commit_patch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.commit_patch_summary(pj.warehouse(spark, sf))


@query(_view("v_block_timeline"))
def block_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return pj.spelled(timeline.block_timeline(pj.timeline_tables(spark, sf)))


@query(f"{SQL} SELECT range_id, seq, from_tag, to_tag, range_expr, commits, CAST(files_changed AS BIGINT) AS files_changed, CAST(hunks AS BIGINT) AS hunks, CAST(line_additions AS BIGINT) AS line_additions, CAST(line_deletions AS BIGINT) AS line_deletions, CAST(block_additions AS BIGINT) AS block_additions, CAST(block_deletions AS BIGINT) AS block_deletions FROM v_range_summary")
def range_summary(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.range_summary(pj.warehouse(spark, sf))


LIFE = "SELECT block_hash, line_count, byte_count, CAST(add_events AS BIGINT) AS add_events, CAST(del_events AS BIGINT) AS del_events, CAST(net_lines AS BIGINT) AS net_lines, is_active_estimate, first_commit, last_commit FROM v_block_lifecycle"


@query(f"{SQL} {LIFE}")
def block_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.block_lifecycle(pj.warehouse(spark, sf))


@query(f"{SQL} {LIFE} ORDER BY add_events + del_events DESC, block_hash LIMIT 200")
def lifecycle_top(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.lifecycle_top(pj.warehouse(spark, sf))


@query(f"{SQL} SELECT * FROM v_block_timeline WHERE block_hash = sha256('12')")
def track_block(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    return timeline.track_block(pj.warehouse(spark, sf), hashlib.sha256(b"12").hexdigest())


@query(f"{SQL} SELECT * FROM v_block_timeline WHERE old_path = 'src/3.rs' OR new_path = 'src/3.rs'")
def track_file(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.track_file(pj.warehouse(spark, sf), "src/3.rs")


@query(f"{SQL} SELECT coalesce(nullif(new_path, ''), old_path) AS file_path, count(*) AS block_events, CAST(count_if(op = 'add') AS BIGINT) AS additions, CAST(count_if(op = 'del') AS BIGINT) AS deletions FROM v_block_timeline GROUP BY 1 ORDER BY block_events DESC, file_path LIMIT 100")
def volatile_files(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.volatile_files(pj.warehouse(spark, sf))


@query(f"{SQL} SELECT 'ranges' AS table_name, count(*) AS n FROM ranges UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'patch_files', count(*) FROM patch_files UNION ALL SELECT 'hunks', count(*) FROM hunks UNION ALL SELECT 'block_events', count(*) FROM block_events UNION ALL SELECT 'code_blocks', count(*) FROM code_blocks")
def warehouse_totals(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.totals(pj.warehouse(spark, sf))


@query(f"{LINES} SELECT sha256(line) AS block_hash, line AS content, CAST(1 AS BIGINT) AS line_count, CAST(strlen(line) AS BIGINT) AS byte_count, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL")
def block_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = pj.files(spark, sf).select(F.explode(F.split("content", "\n")).alias("content")).where("content <> ''")
    g = d.groupBy("content").agg(F.count("*").alias("n"))
    return g.select(F.sha2("content", 256).alias("block_hash"), "content", tx.line_count(F.col("content")).alias("line_count"), tx.byte_count(F.col("content")).alias("byte_count"), "n")


def _diff_patches(spark: SparkSession, sf: str) -> DataFrame:
    """One commit per order: its line items as a diff, returned ones deleted, the rest added or context by quantity."""
    li = pj.read(spark, sf, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_quantity").cast("bigint") % 2 == 0, "+").otherwise(" ")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.concat(sign, F.col("l_partkey").cast("string")).alias("t"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    name = F.col("l_orderkey").cast("string")
    head = F.concat(F.lit("diff --git a/"), name, F.lit(".rs b/"), name, F.lit(".rs\n--- a/"), name, F.lit(".rs\n+++ b/"), name, F.lit(".rs\n@@ -10,3 +20 @@ fn x\n"))
    return g.select(name.alias("commit_sha"), F.concat(head, body).alias("patch_text"))


@query("""
WITH t AS (
  SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN '-' WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN '+' ELSE ' ' END AS sign, CAST(l_partkey AS VARCHAR) AS txt,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i
  FROM lineitem),
c AS (SELECT *, 10 + coalesce(sum(CASE WHEN sign <> '+' THEN 1 ELSE 0 END) OVER b, 0) AS so, 20 + coalesce(sum(CASE WHEN sign <> '-' THEN 1 ELSE 0 END) OVER b, 0) AS sn,
             CASE WHEN sign <> ' ' AND sign IS DISTINCT FROM lag(sign) OVER (PARTITION BY k ORDER BY i) THEN 1 ELSE 0 END AS st
      FROM t WINDOW b AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY i) AS bi FROM c)
SELECT CAST(k AS VARCHAR) AS commit_sha, CAST(bi AS BIGINT) AS block_index, CASE WHEN sign = '+' THEN 'add' ELSE 'del' END AS op, CAST(min(so) AS BIGINT) AS start_old, CAST(min(sn) AS BIGINT) AS start_new, count(*) AS line_count,
       sha256(string_agg(txt, chr(10) ORDER BY i)) AS block_hash, string_agg(sign || txt, chr(10) ORDER BY i) AS block_diff
FROM g WHERE sign <> ' ' GROUP BY k, bi, sign""")
def diff_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = timeline.blocks(timeline.diff_lines(_diff_patches(spark, sf)))
    return b.select("commit_sha", "block_index", "op", "start_old", "start_new", "line_count", "block_hash", "block_diff")


@query("""
WITH t AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN '-' WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN '+' ELSE ' ' END AS sign, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS i FROM lineitem),
c AS (SELECT *, CASE WHEN sign <> ' ' AND sign IS DISTINCT FROM lag(sign) OVER (PARTITION BY k ORDER BY i) THEN sign END AS st FROM t)
SELECT CAST(k AS VARCHAR) AS commit_sha, CAST(1 AS BIGINT) AS files_changed, CAST(1 AS BIGINT) AS hunk_count, CAST(count_if(sign = '+') AS BIGINT) AS line_additions, CAST(count_if(sign = '-') AS BIGINT) AS line_deletions,
       CAST(coalesce(count_if(st = '+'), 0) AS BIGINT) AS block_additions, CAST(coalesce(count_if(st = '-'), 0) AS BIGINT) AS block_deletions FROM c GROUP BY k""")
def commit_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = timeline.diff_lines(_diff_patches(spark, sf))
    return timeline.commit_stats(timeline.patch_files(lines), timeline.hunks(lines), timeline.blocks(lines))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS commit_sha, l_orderkey || '.rs' AS old_path, l_orderkey || '.rs' AS new_path, 'modify' AS change_type, CAST(count_if(l_returnflag <> 'R' AND CAST(l_quantity AS BIGINT) % 2 = 0) AS BIGINT) AS additions, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS deletions, CAST(10 AS BIGINT) AS old_start, CAST(3 AS BIGINT) AS old_lines, CAST(20 AS BIGINT) AS new_start, CAST(1 AS BIGINT) AS new_lines FROM lineitem GROUP BY l_orderkey")
def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    lines = timeline.diff_lines(_diff_patches(spark, sf))
    f, h = timeline.patch_files(lines), timeline.hunks(lines)
    return f.join(h.select("file_patch_id", "old_start", "old_lines", "new_start", "new_lines"), "file_patch_id").select("commit_sha", "old_path", "new_path", "change_type", "additions", "deletions", "old_start", "old_lines", "new_start", "new_lines")


# --- versions and configs --------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT p_partkey, p_size, p_partkey % 3 AS a, p_size % 20 AS b, p_partkey % 7 AS c FROM part) SELECT p_partkey, a || '.' || b || '.' || c AS version, (a, b, c) >= (0, 10, 2) AND (a, b, c) < (2, 5, 0) AS in_range, a = 1 AND b >= 4 AS caret, a = 1 AND b = 4 AND c >= 2 AS tilde, a = 1 AND b = 4 AND c = 3 AS exact FROM v")
def semver_gate(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), (F.col("p_size") % 20).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    d = pj.read(spark, sf, "part").select("p_partkey", v.alias("version"))
    c = F.col("version")
    return d.select("p_partkey", "version", semver.satisfies(c, ">=0.10.2, <2.5.0").alias("in_range"), semver.satisfies(c, "^1.4").alias("caret"), semver.satisfies(c, "~1.4.2").alias("tilde"), semver.satisfies(c, "=1.4.3").alias("exact"))


@query("""
WITH p AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN ' ' ELSE 'p' || item_id END AS id, CASE item_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'ast-grep' WHEN 2 THEN 'toml' ELSE 'text' END AS qt,
                  CASE item_id % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'delete' ELSE 'replace-value' END AS ot, CASE WHEN item_id % 6 = 0 THEN '' ELSE text END AS s FROM benchmark)
SELECT CAST(item_id AS INTEGER) AS ord, kind FROM (
  SELECT item_id, 'blank-id' AS kind FROM p WHERE trim(id) = ''
  UNION ALL SELECT item_id, 'no-target' FROM p WHERE qt = 'toml'
  UNION ALL SELECT item_id, 'blank-pattern' FROM p WHERE qt = 'ast-grep' AND s = ''
  UNION ALL SELECT item_id, 'blank-search' FROM p WHERE qt = 'text' AND s = ''
  UNION ALL SELECT item_id, 'threshold' FROM p WHERE qt = 'text' AND item_id % 8 = 0
  UNION ALL SELECT item_id, 'needs-key' FROM p WHERE qt = 'toml' AND ot = 'replace-value'
  UNION ALL SELECT item_id, 'combination' FROM p WHERE NOT ((qt = 'text' AND ot = 'replace') OR (qt = 'ast-grep' AND ot IN ('replace', 'delete')) OR (qt = 'toml' AND ot = 'replace-value')))""")
def config_issues(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    s = F.when(i % 6 == 0, "").otherwise(F.col("text"))
    qt = F.when(i % 4 == 1, "ast-grep").when(i % 4 == 2, "toml").otherwise("text")
    ot = F.when(i % 3 == 0, "replace").when(i % 3 == 1, "delete").otherwise("replace-value")
    none = F.lit(None)
    q = F.struct(qt.alias("type"), none.cast("string").alias("section"), none.cast("string").alias("key"), none.cast("boolean").alias("ensure_absent"), none.cast("boolean").alias("ensure_present"), s.alias("pattern"), s.alias("search"), F.when(i % 8 == 0, 1.5).otherwise(0.5).alias("fuzzy_threshold"), none.cast("int").alias("fuzzy_expansion"))
    o = F.struct(ot.alias("type"), F.lit("t").alias("text"), F.lit("v").alias("value"), F.lit("k").alias("new_key"), none.cast("string").alias("insert_comment"), none.cast("string").alias("after_section"), none.cast("string").alias("before_section"), none.cast("boolean").alias("at_end"), none.cast("boolean").alias("at_beginning"))
    p = pj.read(spark, sf, "benchmark").select(i.cast("int").alias("ord"), F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("id"), F.lit("a.rs").alias("file"), q.alias("query"), o.alias("operation"))
    return guards.issues(p).select("ord", "kind")


@query(f"WITH {FILES}, p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/ws/a/' || path WHEN 1 THEN '/ws/a/../../' || path WHEN 2 THEN '/ws/a/target/' || path ELSE '/wsx/' || path END AS full_path FROM f) SELECT full_path AS path, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 2 THEN 'forbidden' ELSE 'outside' END AS verdict FROM p")
def path_guard(spark: SparkSession, sf: str) -> DataFrame:
    d = pj.files(spark, sf)
    k = F.col("doc_id") % 4
    p = F.concat(F.when(k == 0, "/ws/a/").when(k == 1, "/ws/a/../../").when(k == 2, "/ws/a/target/").otherwise("/wsx/"), "path")
    return d.select(p.alias("path")).withColumn("verdict", guards.guard(F.col("path"), "/ws", ["/ws/a/target"]))


# --- flows -----------------------------------------------------------------------------------------------------------


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    e = pj.read(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_id") % 2 == 0, "request").otherwise("response").alias("direction"), F.col("event_type").alias("method"), F.lit("https://api.openai.com/v1").alias("url"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("props").alias("body"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("event_id").cast("double").alias("ts"),
    )


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS messages, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS tokens, max(CAST(event_id AS DOUBLE)) AS last_ts, CAST(count_if(event_id % 2 = 0) AS BIGINT) AS requests, CAST(count_if(event_id % 2 <> 0) AS BIGINT) AS responses FROM events GROUP BY user_id")
def session_totals(spark: SparkSession, sf: str) -> DataFrame:
    return fl.session_totals(_flows(spark, sf))


@query("SELECT count(*) AS messages, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS tokens, CAST(count_if(event_id % 2 = 0) AS BIGINT) AS requests, CAST(count_if(event_id % 2 <> 0) AS BIGINT) AS responses FROM events")
def flow_totals(spark: SparkSession, sf: str) -> DataFrame:
    return fl.global_totals(_flows(spark, sf))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, CASE WHEN event_type = 'error' THEN 'err' WHEN event_id % 2 = 0 THEN 'req' ELSE 'res' END AS class, CASE WHEN k >= 1000 THEN printf('%.1f', k / 1000.0) || 'k' ELSE CAST(k AS VARCHAR) END AS shown FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) * 37 AS k FROM events)")
def flow_messages(spark: SparkSession, sf: str) -> DataFrame:
    d = _flows(spark, sf)
    return d.select("session_id", F.col("ts").cast("bigint").alias("event_id"), fl.message_class(F.col("direction"), F.col("status")).alias("class"), fl.short_tokens(F.col("tokens") * 37).alias("shown"))


_SESSION = "CASE event_id % 8 WHEN 0 THEN 's' || user_id % 10 WHEN 1 THEN 'r' || user_id % 7 WHEN 2 THEN 'o' || user_id % 5 WHEN 3 THEN 's' || user_id % 10 WHEN 4 THEN 's' || user_id % 10 WHEN 5 THEN 'q' || user_id % 7 ELSE substr('conn-' || user_id || '-abcdefgh', 1, 12) END"


@query(f"""WITH e AS (SELECT event_id, {_SESSION} AS session_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 8 = 1 AS stream FROM events WHERE event_id % 9 <> 0),
b AS (SELECT *, CASE WHEN stream THEN 'data: ' || props || chr(10) || 'data: plain' || chr(10) || 'data: {{"usage":{{"total_tokens":' || k || '}}}}' || chr(10) || 'data: [DONE]' || chr(10) ELSE props END AS raw FROM e)
SELECT event_id, session_id, CASE WHEN stream THEN '[' || props || ',"plain",{{"usage":{{"total_tokens":' || k || '}}}}]' ELSE props END AS body, CAST(CASE WHEN stream AND k <> 0 THEN k ELSE strlen(raw) // 4 END AS BIGINT) AS tokens FROM b""")
def flow_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events: session ids in every place, streams and plain bodies, some of other hosts."""
    k, u = F.col("event_id") % 8, F.col("user_id")
    name = lambda p, n: F.concat(F.lit(p), (u % n).cast("string"))
    none = F.expr("cast(map() as map<string,string>)")
    own = F.when(k == 0, F.create_map(F.lit("X-Session-Id"), name("s", 10))).when(k == 1, F.create_map(F.lit("x-request-id"), name("r", 7), F.lit("content-type"), F.lit("text/event-stream; charset=utf-8"))).when(k == 2, F.create_map(F.lit("x-oai-request-id"), name("o", 5)))
    own = own.when(k == 4, F.create_map(F.lit("x-session-id"), name("s", 10), F.lit("x-oai-request-id"), F.lit("z"))).when(k == 5, F.create_map(F.lit("x-request-id"), F.lit(""), F.lit("x-oai-request-id"), name("q", 7))).otherwise(none)
    asked = F.when(k == 3, F.create_map(F.lit("x-session-id"), name("s", 10))).otherwise(none)
    stream = F.concat(F.lit("data: "), "props", F.lit('\ndata: plain\ndata: {"usage":{"total_tokens":'), F.get_json_object("props", "$.k"), F.lit("}}\ndata: [DONE]\n"))
    e = pj.read(spark, sf, "events").select(
        own.alias("headers"), asked.alias("request_headers"), F.concat(F.lit("conn-"), u.cast("string"), F.lit("-abcdefgh")).alias("connection_id"), F.when(F.col("event_id") % 2 == 0, "request").otherwise("response").alias("direction"), F.when(F.col("event_id") % 9 == 0, "example.org").otherwise("api.openai.com").alias("host"),
        F.lit("POST").alias("method"), F.lit("https://api.openai.com/v1").alias("url"), F.lit(200).alias("status"), F.when(k == 1, stream).otherwise(F.col("props")).alias("body"), F.col("event_id").cast("double").alias("ts"),
    )
    return fl.messages(e).select(F.col("ts").cast("bigint").alias("event_id"), "session_id", "body", "tokens")


@query("SELECT conv_id, turn, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE strlen(text) // 4 END AS BIGINT) AS tokens FROM conversations")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return pj.read(spark, sf, "conversations").select("conv_id", "turn", fl.tokens(F.col("text")).alias("tokens"))


@query("SELECT page_id, CASE WHEN strpos(rest, '?') > 0 THEN substr(rest, 1, strpos(rest, '?')) || substr(substr(rest, strpos(rest, '?') + 1), 1, 39) WHEN rest = '' THEN '/' ELSE rest END AS shown FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS rest FROM pages)")
def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    return pj.read(spark, sf, "pages").select("page_id", fl.url_path(F.col("url")).alias("shown"))


@query("SELECT event_id, CASE WHEN s < 5 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' END AS age FROM (SELECT event_id, event_id % 9000 AS s FROM events)")
def relative_times(spark: SparkSession, sf: str) -> DataFrame:
    return pj.read(spark, sf, "events").select("event_id", fl.relative_time(F.col("event_id") % 9000).alias("age"))


# --- text tools ------------------------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT path, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS lines, CAST(len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words, CAST(strlen(content) AS BIGINT) AS bytes FROM f")
def file_stats(spark: SparkSession, sf: str) -> DataFrame:
    return textops.stats(pj.files(spark, sf))


@query(f"{LINES} SELECT path, line_no + 1 AS line_no, line FROM l WHERE regexp_matches(line, '(?i)licen[cs]e|@')")
def line_search(spark: SparkSession, sf: str) -> DataFrame:
    lines = pj.files(spark, sf).select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return textops.search(lines, "licen[cs]e|@", ignore_case=True)


@query(f"{LINES}, t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no DESC) AS r FROM l) SELECT path, line_no + 1 AS line_no FROM t WHERE r <= 3 AND regexp_matches(line, 'the')")
def tail_search(spark: SparkSession, sf: str) -> DataFrame:
    lines = pj.files(spark, sf).select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return textops.tail_search(lines, 3, "the").select("path", "line_no")


@query(f"""{LINES}, e AS (SELECT path || CASE doc_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.sh' ELSE '' END AS path, doc_id % 4 AS m, line_no, line || CASE line_no % 5 WHEN 0 THEN ' x.unwrap()' WHEN 1 THEN ' todo!()' WHEN 2 THEN ' import *' WHEN 3 THEN ' eval x' ELSE '' END AS line FROM l),
r(m, rule, p) AS (VALUES (0, 'bare unwrap()', 'unwrap()'), (0, 'unfinished code', 'todo!'), (0, 'unfinished code', 'unimplemented!'), (1, 'wildcard import', 'import *'), (2, 'eval usage', 'eval '))
SELECT DISTINCT path, line_no + 1 AS line_no, rule FROM e JOIN r ON e.m = r.m AND contains(line, p)""")
def lint_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents with code at their ends, as files of four kinds."""
    k = F.col("doc_id") % 4
    lines = pj.files(spark, sf).select(F.concat("path", _of(k, [".rs", ".py", ".sh", ""])).alias("path"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return textops.lint(lines.withColumn("line", F.concat("line", _of(F.col("line_no") % 5, [" x.unwrap()", " todo!()", " import *", " eval x", ""]))))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    o = pj.read(spark, sf, "orders")
    return o.select(F.concat(F.lit("rollouts/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_totalprice") * 40).cast("bigint").alias("length"), F.to_timestamp("o_orderdate").alias("modified"))


LISTING = "WITH r AS (SELECT 'rollouts/' || o_orderkey AS path, CAST(floor(o_totalprice * 40) AS BIGINT) AS length, o_orderdate AS modified FROM orders)"


@query(f"{LISTING} SELECT path, length FROM r WHERE floor((epoch(TIMESTAMP '1998-01-01') - epoch(modified)) / 86400) > 30")
def retention_age(spark: SparkSession, sf: str) -> DataFrame:
    return textops.older_than(_listing(spark, sf), 30, F.lit("1998-01-01").cast("timestamp")).select("path", "length")


@query(f"{LISTING}, w AS (SELECT *, CAST(floor(floor(length / 1024) / 1024) AS BIGINT) AS mb FROM r), c AS (SELECT *, coalesce(sum(mb) OVER (ORDER BY modified, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(mb) OVER () - 500 AS excess FROM w) SELECT path, length, CAST(freed AS BIGINT) AS freed FROM c WHERE freed < excess")
def retention_budget(spark: SparkSession, sf: str) -> DataFrame:
    return textops.over_budget(_listing(spark, sf), 500).select("path", "length", "freed")


@query("SELECT l_suppkey AS log, CASE WHEN l_suppkey % 2 = 0 THEN 'src/t' || l_suppkey ELSE 'integration' || l_suppkey END AS binary, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS passed, CAST(sum(l_linenumber) AS BIGINT) AS failed, coalesce(string_agg(CASE WHEN l_returnflag = 'R' THEN 't::p' || l_partkey END, ',' ORDER BY l_orderkey, l_linenumber, l_partkey), '') AS failed_tests FROM lineitem GROUP BY l_suppkey")
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A log per supplier: a heading, then a result line per line item, behind a failed test for the returned ones."""
    li = pj.read(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"))
    rows = li.select(F.col("l_suppkey").alias("log"), (n * 2).alias("n"), "l_quantity", "l_linenumber", "l_partkey", "l_returnflag")
    body = rows.select("log", F.col("n").alias("line_no"), F.format_string("test result: FAILED. %d passed; %d failed; 0 ignored", F.col("l_quantity").cast("bigint"), F.col("l_linenumber")).alias("line"))
    failed = rows.where("l_returnflag = 'R'").select("log", (F.col("n") - 1).alias("line_no"), F.concat(F.lit("test t::p"), F.col("l_partkey").cast("string"), F.lit(" ... FAILED")).alias("line"))
    k = F.col("log").cast("string")
    head = F.when(F.col("log") % 2 == 0, F.concat(F.lit("     Running unittests src/t"), k, F.lit(".rs (target/debug/deps/x-1)"))).otherwise(F.concat(F.lit("     Running tests/integration"), k, F.lit("/mod.rs (target/debug/deps/y-2)")))
    heads = li.select(F.col("l_suppkey").alias("log")).distinct().select("log", F.lit(0).alias("line_no"), head.alias("line"))
    return textops.log_summary(body.unionByName(failed).unionByName(heads)).withColumn("failed_tests", F.array_join("failed_tests", ","))


# --- functions -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN regexp_matches(n, '(_level|_limit|_timeout|_override|_config|_policy)$') OR regexp_matches(n, '^(optional_|maybe_)') OR contains(n, 'sandbox') THEN 'None' WHEN regexp_matches(n, '^(is_|has_|can_|should_|enable|disable)') OR regexp_matches(n, '(_enabled|_disabled|_allowed)$') THEN 'false' WHEN regexp_matches(n, 's$') AND NOT regexp_matches(n, 'ss$') THEN 'Vec::new()' WHEN regexp_matches(n, '(_count|_size|_index)$') THEN '0' WHEN regexp_matches(n, '(_name|_path|_url|_message)$') THEN 'String::new()' ELSE 'None' END AS value FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'is_' WHEN 1 THEN 'optional_' ELSE '' END || lower(replace(p_type, ' ', '_')) || CASE p_size % 8 WHEN 0 THEN '_limit' WHEN 1 THEN '_names' WHEN 2 THEN '_count' WHEN 3 THEN '_path' WHEN 4 THEN '_class' WHEN 5 THEN '_enabled' ELSE '' END AS n FROM part)")
def default_values(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.lit("")
    for k, t in ((5, "_enabled"), (4, "_class"), (3, "_path"), (2, "_count"), (1, "_names"), (0, "_limit")):
        tail = F.when(F.col("p_size") % 8 == k, t).otherwise(tail)
    head = F.when(F.col("p_partkey") % 9 == 0, "is_").when(F.col("p_partkey") % 9 == 1, "optional_").otherwise("")
    n = F.concat(head, F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), tail)
    return pj.read(spark, sf, "part").select("p_partkey", tx.default_value(n).alias("value"))


@query("SELECT s_suppkey, CAST(greatest(0, s_suppkey * 7919) AS VARCHAR) AS value, length(s_name) AS n, CASE WHEN greatest(length(s_name), length(n_name)) = 0 THEN 1.0::DOUBLE ELSE round(1.0::DOUBLE - levenshtein(s_name, n_name)::DOUBLE / greatest(length(s_name), length(n_name)), 6) END AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = pj.read(spark, sf, "supplier").join(pj.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    h = F.concat(F.lit("0x"), F.hex(F.col("s_suppkey") * 7919))
    return d.select("s_suppkey", tx.hex_to_decimal(h).cast("string").alias("value"), F.length("s_name").alias("n"), F.round(tx.normalized_levenshtein(F.col("s_name"), F.col("n_name")), 6).alias("score"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM pages")
def html_escapes(spark: SparkSession, sf: str) -> DataFrame:
    return pj.read(spark, sf, "pages").select("page_id", F.sha2(tx.html_escape(F.col("html")), 256).alias("escaped_sha256"))


@query("WITH a AS (SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS byte_start, l_partkey AS byte_end FROM lineitem WHERE l_quantity > 10), b AS (SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS byte_start, l_partkey AS byte_end FROM lineitem WHERE l_returnflag = 'R') SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND b.byte_start = a.byte_start AND b.byte_end = a.byte_end)")
def error_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Errors after an edit that weren't there before, line items standing for errors."""
    li = pj.read(spark, sf, "lineitem")
    spans = [F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("byte_start"), F.col("l_partkey").alias("byte_end")]
    return edits.new_errors(li.where("l_quantity > 10").select(*spans), li.where("l_returnflag = 'R'").select(*spans)).select("path", "byte_start", "byte_end")


@query("WITH m AS (SELECT l_orderkey AS path, l_linenumber * 10 AS byte_start, l_linenumber * 10 + l_suppkey % 9 AS byte_end FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS path, l_linenumber * 10 - 5 AS fs, l_linenumber * 10 + 16 AS fe, 'f' || l_linenumber AS name FROM lineitem WHERE l_linenumber % 2 = 1) SELECT m.path, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end, name AS function FROM m JOIN f ON f.path = m.path AND byte_start >= fs AND byte_end <= fe")
def match_in_function(spark: SparkSession, sf: str) -> DataFrame:
    """Matches within a function's span: a containment join keyed by path."""
    li = pj.read(spark, sf, "lineitem")
    at = F.col("l_linenumber").cast("bigint") * 10
    m = li.select(F.col("l_orderkey").alias("path"), at.alias("byte_start"), (at + F.col("l_suppkey") % 9).alias("byte_end"))
    f = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("path"), (at - 5).alias("byte_start"), (at + 16).alias("byte_end"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name")).distinct()
    return structure.inside(m, f)


@query("SELECT p_partkey, replace(replace('fn $NAME($TYPE, $$$REST)', '$$$REST', p_brand), '$NAME', p_name) AS x, replace(replace(replace('fn $NAME($TYPE, $$$REST)', '$$$REST', p_brand), '$NAME', p_name), '$TYPE', p_type) AS filled FROM part")
def capture_template(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lit("fn $NAME($TYPE, $$$REST)")
    m = F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("TYPE"), F.col("p_type"), F.lit("REST"), F.col("p_brand"))
    two = F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("REST"), F.col("p_brand"))
    return pj.read(spark, sf, "part").select("p_partkey", edits.expand_captures(t, two).alias("x"), edits.expand_captures(t, m).alias("filled"))


@query()
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """XXH3 of every document (no SQL function)."""
    from ..functions.hashing import xxh3_64

    return pj.files(spark, sf).select("path", xxh3_64("content").alias("xxh3"))


@query(f"{HITS}, one AS (SELECT path, min(needle_id) AS k FROM h GROUP BY path), r AS (SELECT f.path, string_split(content, chr(10)) AS a, string_split(replace(content, b.text, '[[x]]'), chr(10)) AS b FROM one JOIN benchmark b ON b.item_id = one.k JOIN f ON f.path = one.path) SELECT path, CAST(len(a) AS BIGINT) AS before_lines, CAST(len(b) AS BIGINT) AS after_lines FROM r")
def line_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of either side of a document's diff; the layout of a diff is not unique, what it rebuilds is."""
    files = pj.files(spark, sf).select("path", "content")
    first = _hits(spark, sf).groupBy("path").agg(F.min("needle_id").alias("needle_id")).join(pj.needles(spark, sf), "needle_id")
    after = files.join(first.select("path", "search"), "path").select("path", F.replace("content", F.col("search"), F.lit("[[x]]")).alias("content"))
    d = engine.line_diff(files, after)
    return d.groupBy("path").agg(F.count_if(F.col("tag") != "+").alias("before_lines"), F.count_if(F.col("tag") != "-").alias("after_lines"))


# --- the patch engine over the documents -------------------------------------------------------------------------------


@query(f"""{HITS}, c AS (SELECT needle_id, path, CAST((length(content) - length(replace(content, search, ''))) / length(search) AS BIGINT) AS n FROM h), one AS (SELECT needle_id, min(path) AS path FROM c GROUP BY 1),
p AS (SELECT CAST(item_id AS INTEGER) AS ord, coalesce(one.path, 'missing.txt') AS file, item_id % 4 AS k, item_id, text FROM benchmark LEFT JOIN one ON needle_id = item_id),
e AS (SELECT p.*, n, strlen(substr(f.content, 1, strpos(f.content, p.text) - 1)) AS s FROM p LEFT JOIN c ON c.needle_id = p.item_id AND c.path = p.file LEFT JOIN f ON f.path = p.file),
o AS (SELECT ord, coalesce(lead(s + strlen(text)) OVER (PARTITION BY file ORDER BY s DESC, ord) > s, false) AS over, file FROM e WHERE n = 1 AND k <> 3), b AS (SELECT file, bool_or(over) AS bad FROM o GROUP BY file)
SELECT e.ord, CASE WHEN k = 3 THEN 'SkippedVersion' WHEN n IS NULL OR n > 1 OR bad THEN 'Failed' ELSE 'Applied' END AS status FROM e LEFT JOIN b ON b.file = e.file""")
def patch_apply(spark: SparkSession, sf: str) -> DataFrame:
    """A text patch per benchmark passage on the first document that holds it; every fourth asks for a later version."""
    hits = _hits(spark, sf).groupBy("needle_id").agg(F.min("path").alias("path"))
    none = F.lit(None)
    n = pj.needles(spark, sf).join(hits, "needle_id", "left")
    q = F.struct(F.lit("text").alias("type"), *[none.cast("string").alias(c) for c in ("section", "key")], *[none.cast("boolean").alias(c) for c in ("ensure_absent", "ensure_present")], none.cast("string").alias("pattern"), F.col("search"), none.cast("double").alias("fuzzy_threshold"), none.cast("int").alias("fuzzy_expansion"))
    o = F.struct(F.lit("replace").alias("type"), F.concat(F.lit("[["), F.col("needle_id").cast("string"), F.lit("]]")).alias("text"), *[none.cast("string").alias(c) for c in configs.OPERATION[2:7]], *[none.cast("boolean").alias(c) for c in configs.OPERATION[7:]])
    p = n.select(
        F.col("needle_id").cast("int").alias("ord"), F.lit("c").alias("config"), F.lit("n").alias("name"), F.lit(">=1.0.0").alias("version_range"), F.lit(False).alias("workspace_relative"), F.col("needle_id").cast("string").alias("id"),
        F.coalesce("path", F.lit("missing.txt")).alias("file"), F.when(F.col("needle_id") % 4 == 3, ">=2.0.0").alias("version"), q.alias("query"), o.alias("operation"),
        F.struct(*[none.cast("string").alias(c) for c in ("method", "expected_text", "algorithm", "expected")]).alias("verify"), F.struct(none.cast("boolean").alias("ensure_absent"), none.cast("boolean").alias("ensure_present"), none.cast("string").alias("function_context")).alias("constraint"),
    )
    return engine.plan(p, pj.files(spark, sf).select("path", "content"), "1.2.3")["results"].select("ord", "status")


# --- code: a generated Rust and TOML text per part ---------------------------------------------------------------------

RUST = """use std::fmt;

/// fn hidden() {}
pub struct P@ { x: i32, y: i32 }

impl P@ {
    pub fn len(&self) -> f64 { let s = "fn no() {"; 0.0 }
}

impl fmt::Display for P@ {
    fn fmt(&self) -> u8 { match self.x { 0 => 1, _ => 2 } }
}

const MAX_@: usize = 10;
static NAME: &str = "é@";

fn main() { println!("{}", 1); foo(a, b); foo(c@, c@); }
"""
#: Its nodes: parent, kind, name, trait, text, the text before its body.
RUST_NODES = [
    (None, "use_declaration", "std::fmt", None, "use std::fmt;", None),
    (None, "struct_item", "P@", None, "pub struct P@ { x: i32, y: i32 }", "pub struct P@ "),
    (None, "impl_item", "P@", None, 'impl P@ {\n    pub fn len(&self) -> f64 { let s = "fn no() {"; 0.0 }\n}', "impl P@ "),
    (2, "function_item", "len", None, 'pub fn len(&self) -> f64 { let s = "fn no() {"; 0.0 }', "pub fn len(&self) -> f64 "),
    (None, "impl_item", "P@", "fmt::Display", "impl fmt::Display for P@ {\n    fn fmt(&self) -> u8 { match self.x { 0 => 1, _ => 2 } }\n}", "impl fmt::Display for P@ "),
    (4, "function_item", "fmt", None, "fn fmt(&self) -> u8 { match self.x { 0 => 1, _ => 2 } }", "fn fmt(&self) -> u8 "),
    (5, "match_arm", "0", None, "0 => 1", "0 => "),
    (5, "match_arm", "_", None, "_ => 2", "_ => "),
    (None, "const_item", "MAX_@", None, "const MAX_@: usize = 10;", None),
    (None, "static_item", "NAME", None, 'static NAME: &str = "é@";', None),
    (None, "function_item", "main", None, 'fn main() { println!("{}", 1); foo(a, b); foo(c@, c@); }', "fn main() "),
]
TOML_TEXT = '# head @\n[package]\nname = "a@" # note\nversion = "1"\n\n[profile.release]\nopt-level = 3\n'


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _per_part(spark: SparkSession, sf: str, template: str, ext: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return pj.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("p/"), k, F.lit(ext)).alias("path"), F.replace(F.lit(template), F.lit("@"), k).alias("content"))


def _per_part_sql(template: str, ext: str) -> str:
    return f"f AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, 'p/' || p_partkey || '{ext}' AS path, replace({_quoted(template)}, '@', CAST(p_partkey AS VARCHAR)) AS content FROM part)"


CODE = f"""WITH {_per_part_sql(RUST, '.rs')},
t(node_id, parent_id, kind, name, trait, txt, head) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, (k, *row))) + ')' for k, row in enumerate(RUST_NODES))}),
n AS (SELECT path, p_partkey, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, kind, replace(name, '@', k) AS name, trait, CAST(strlen(substr(content, 1, strpos(content, replace(txt, '@', k)) - 1)) AS BIGINT) AS byte_start, strlen(replace(txt, '@', k)) AS size, strlen(replace(head, '@', k)) AS lead FROM f, t),
nodes AS (SELECT path, p_partkey, node_id, parent_id, kind, name, trait, byte_start, byte_start + size AS byte_end, byte_start + lead AS body_start, CASE WHEN lead IS NOT NULL THEN byte_start + size END AS body_end FROM n)"""


def _rust(spark: SparkSession, sf: str) -> DataFrame:
    return _per_part(spark, sf, RUST, ".rs").select("path", "content")


@query(f"{CODE} SELECT path, node_id, parent_id, kind, name, trait, byte_start, byte_end, body_start, body_end FROM nodes")
def rust_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return structure.node_table(_rust(spark, sf))


@query(f"WITH {_per_part_sql(RUST, '.rs')}, e AS (SELECT path, strlen(content) AS n, p_partkey % 3 AS m FROM f) SELECT path, CAST(n + 8 AS BIGINT) AS byte_start, CAST(n + 9 AS BIGINT) AS byte_end FROM e WHERE m = 2 UNION ALL SELECT path, CAST(n + d AS BIGINT), CAST(n + d + 1 AS BIGINT) FROM e, (VALUES (7), (9)) AS x(d) WHERE m = 1")
def syntax_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the texts ends in two open brackets, a third in an open string."""
    k = F.col("p_partkey") % 3
    broken = _per_part(spark, sf, RUST, ".rs").select("path", F.concat("content", F.when(k == 1, "fn x() { (\n").when(k == 2, 'let s = "open').otherwise("")).alias("content"))
    return structure.errors(structure.node_table(broken)).select("path", "byte_start", "byte_end")


#: Targets and what they mean in the generated texts.
TARGETS = [
    ("fn main", "kind = 'function_item' AND name = 'main'"), ("fn P7::len", "kind = 'function_item' AND name = 'len' AND CAST(p_partkey AS VARCHAR) LIKE '7%'"), ("struct P11", "kind = 'struct_item' AND name = 'P11'"),
    ("impl fmt::Display for P12", "kind = 'impl_item' AND trait = 'fmt::Display' AND name = 'P12'"), ("const /^MAX_1/", "kind = 'const_item' AND name LIKE 'MAX\\_1%' ESCAPE '\\'"), ("static NAME", "kind = 'static_item'"), ("use std", "kind = 'use_declaration'"),
]


@query(f"{CODE} " + " UNION ALL ".join(f"SELECT {_quoted(dsl)} AS target, path, byte_start, byte_end FROM nodes WHERE {where}" for dsl, where in TARGETS))
def structural_targets(spark: SparkSession, sf: str) -> DataFrame:
    return structure.locate_all(structure.node_table(_rust(spark, sf)), [dsl for dsl, _ in TARGETS]).select("target", "path", "byte_start", "byte_end")


@query(f"{CODE} SELECT path, node_id, name, byte_start, byte_end FROM nodes WHERE kind = 'match_arm' AND name = '0'")
def match_arms(spark: SparkSession, sf: str) -> DataFrame:
    f = _rust(spark, sf)
    return structure.match_arms(f, structure.node_table(f), "0").select("path", "node_id", "name", "byte_start", "byte_end")


_CALLS = " UNION ALL ".join(f"SELECT path, CAST(strlen(substr(content, 1, strpos(content, {t}) - 1)) AS BIGINT) AS byte_start, CAST(strlen(substr(content, 1, strpos(content, {t}) - 1)) + strlen({t}) AS BIGINT) AS byte_end, {t} AS text, {a} AS a, {b} AS b FROM f" for t, a, b in (("'foo(a, b)'", "'a'", "'b'"), ("'foo(c' || k || ', c' || k || ')'", "'c' || k", "'c' || k")))


@query(f"WITH {_per_part_sql(RUST, '.rs')} {_CALLS}")
def ast_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return structure.matches(_rust(spark, sf), pattern="foo($A, $B)").select("path", "byte_start", "byte_end", "text", F.col("captures")["A"].alias("a"), F.col("captures")["B"].alias("b"))


@query(f"WITH {_per_part_sql(RUST, '.rs')}, c AS ({_CALLS}) SELECT path, 'main' AS function, byte_start, text FROM c")
def pattern_in_function(spark: SparkSession, sf: str) -> DataFrame:
    return structure.find_in_function(_rust(spark, sf), "foo($A, $B)", "main").select("path", "function", "byte_start", "text")


@query(f"WITH {_per_part_sql(RUST, '.rs')} SELECT path, sha256(replace(replace(content, 'foo(a, b)', 'bar(b, a)'), 'foo(c' || k || ', c' || k || ')', 'bar(c' || k || ', c' || k || ')')) AS content_sha256, true AS changed FROM f")
def pattern_replace(spark: SparkSession, sf: str) -> DataFrame:
    done = structure.find_and_replace(_rust(spark, sf), "foo($A, $B)", "bar($B, $A)")
    return done.select("path", F.sha2("content", 256).alias("content_sha256"), "changed")


@query(f"""WITH {_per_part_sql(TOML_TEXT, '.toml')}, h AS (SELECT *, strlen(content) AS n, strlen('# head ' || k) + 1 AS a FROM f), p AS (SELECT *, strlen(substr(content, 1, strpos(content, '[profile') - 1)) AS b FROM h)
SELECT path, 'package' AS section, CAST(a AS BIGINT) AS header_start, CAST(a + 9 AS BIGINT) AS header_end, CAST(a + 10 AS BIGINT) AS body_start, CAST(b AS BIGINT) AS body_end FROM p
UNION ALL SELECT path, 'profile.release', CAST(b AS BIGINT), CAST(b + 17 AS BIGINT), CAST(b + 18 AS BIGINT), CAST(n AS BIGINT) FROM p""")
def toml_sections(spark: SparkSession, sf: str) -> DataFrame:
    return toml_spans.sections(_per_part(spark, sf, TOML_TEXT, ".toml").select("path", "content"))


@query(f"WITH {_per_part_sql(TOML_TEXT, '.toml')} SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'AlreadyApplied' WHEN p_partkey % 4 = 1 THEN 'Failed' ELSE 'Applied' END AS status, sha256(CASE p_partkey % 4 WHEN 0 THEN replace(content, 'opt-level = 3', 'opt-level = 2') WHEN 1 THEN replace(content, 'profile.release', 'profile.bench') ELSE replace(content, 'opt-level = 3', 'opt-level = 2') END) AS content_sha256 FROM f")
def toml_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A patch per file: set a value that some files have already, and whose section others lack."""
    text = '[meta]\nname = "t"\n[[patches]]\nid = "a"\nfile = "Cargo.toml"\nquery = { type = "toml", section = "profile.release", key = "opt-level" }\noperation = { type = "replace-value", value = "2" }\nconstraint = { ensure_present = true }\n'
    files = _per_part(spark, sf, TOML_TEXT, ".toml")
    k = F.col("p_partkey") % 4
    files = files.withColumn("content", F.when(k == 0, F.replace("content", F.lit("opt-level = 3"), F.lit("opt-level = 2"))).when(k == 1, F.replace("content", F.lit("profile.release"), F.lit("profile.bench"))).otherwise(F.col("content")))
    one = configs.from_text(spark, text)
    patches = files.select("p_partkey", "path").join(F.broadcast(one.drop("ord", "file")), F.lit(True)).withColumn("ord", F.col("p_partkey").cast("int")).withColumn("file", F.col("path")).select(one.columns)
    p = engine.plan(patches, files.select("path", "content"), "1.0.0")
    return p["results"].join(p["files"], F.col("file") == F.col("path")).select(F.col("ord").cast("long").alias("ord"), "status", F.sha2("content", 256).alias("content_sha256"))


_FIELD = ["max_count", "is_on", "items"]
_VALUE = ["0", "false", "Vec::new()"]
_INIT = ["let point = Point { x: @ };\n", "let point = Point {\n    x: @,\n};\n", "let point@ = Point {};\n"]


def _of(k, options: list[str]):
    out = F.lit(options[-1])
    for n in range(len(options) - 1):
        out = F.when(k == n, F.lit(options[n])).otherwise(out)
    return out


def _of_sql(k: str, options: list[str]) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {n} THEN {_quoted(x)}" for n, x in enumerate(options)) + " END"


@query(f"""WITH f AS (SELECT p_partkey, 'p/' || p_partkey || '.rs' AS path, replace({_of_sql('p_partkey % 3', _INIT)}, '@', CAST(p_partkey AS VARCHAR)) AS content, {_of_sql('p_partkey // 3 % 3', [f'{a}: {b}' for a, b in zip(_FIELD, _VALUE, strict=True)])} AS pair FROM part)
SELECT path, CAST(strpos(content, '}}') - 1 AS BIGINT) AS byte_start, CAST(strpos(content, '}}') - 1 AS BIGINT) AS byte_end, CASE p_partkey % 3 WHEN 0 THEN ',' || chr(10) || ' ' || pair WHEN 1 THEN chr(10) || '    ' || pair || ',' ELSE chr(10) || '    ' || pair || ',' || chr(10) END AS new_text, 'E0063' AS rule FROM f""")
def autofix_edits(spark: SparkSession, sf: str) -> DataFrame:
    """A compiler message per part about a field that its initializer lacks."""
    k = F.col("p_partkey")
    d = pj.read(spark, sf, "part").select(F.concat(F.lit("p/"), k.cast("string"), F.lit(".rs")).alias("path"), F.replace(_of(k % 3, _INIT), F.lit("@"), k.cast("string")).alias("content"), _of(F.floor(k / 3) % 3, _FIELD).alias("field"))
    span = F.struct(F.col("path").alias("file_name"), (F.instr("content", "Point {") - 1).alias("byte_start"), F.instr("content", "}").alias("byte_end"), F.lit(True).alias("is_primary"))
    message = F.struct(F.concat(F.lit("missing field `"), "field", F.lit("` in initializer of `Point`")).alias("message"), F.lit("error").alias("level"), F.struct(F.lit("E0063").alias("code")).alias("code"), F.array(span).alias("spans"))
    lines = d.select(F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message"))).alias("line"))
    return autofix.fixes(src.parse_diagnostics(lines), d.select("path", "content"))["edits"].select("path", "byte_start", "byte_end", "new_text", "rule")
