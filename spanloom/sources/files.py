"""Scans: workspace files, listings, logs, diagnostics, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW = "session_id string, direction string, method string, url string, status int, body string, tokens bigint, ts double"
FLOW_EVENT = "headers map<string,string>, request_headers map<string,string>, connection_id string, direction string, host string, method string, url string, status int, body string, ts double"
_SPAN = "struct<file_name:string,byte_start:bigint,byte_end:bigint,line_start:bigint,line_end:bigint,is_primary:boolean,suggested_replacement:string,suggestion_applicability:string,expansion:struct<macro_decl_name:string>>"
_LEAF = f"struct<message:string,level:string,spans:array<{_SPAN}>>"
_CHILD = _LEAF
for _ in range(2):  # children of children, three levels in all
    _CHILD = f"struct<message:string,level:string,spans:array<{_SPAN}>,children:array<{_CHILD}>>"
DIAGNOSTIC = f"reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<{_SPAN}>,children:array<{_CHILD}>>"


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, content_bin, error: whole files; what is no UTF-8 has an error and no content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    d = r.load(path).select("path", F.col("content").alias("content_bin"))
    d = d.withColumn("text", F.try_validate_utf8(F.col("content_bin").cast("string")))
    return d.select(F.regexp_replace("path", "^file:(?://)?", "").alias("path"), F.col("text").alias("content"), "content_bin", F.when(F.col("text").isNull(), "Io").alias("error"))


def listing(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """path, length, modified: file names without their content (the scan is pruned to metadata)."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return d.select("path", "length", F.col("modificationTime").alias("modified"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log (the file), line_no, line of logs, kept whole per file so that the order of its lines is known."""
    d = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("log"))
    return d.select("log", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Compiler messages of level error from JSON lines; lines that are none are skipped."""
    return parse_diagnostics(spark.read.text(path).select(F.col("value").alias("line")))


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """diag_id, message struct. The id digests the line, so equal lines are one diagnostic."""
    d = lines.where(F.startswith(F.ltrim("line"), F.lit("{"))).select("line", F.from_json("line", DIAGNOSTIC).alias("m"))
    d = d.where((F.col("m.reason") == "compiler-message") & (F.col("m.message.level") == "error"))
    return d.select(F.sha2("line", 256).alias("diag_id"), F.col("m.message").alias("message"))


def passes(diags: DataFrame) -> DataFrame:
    """One row: whether there is no error."""
    return diags.agg((F.count("*") == 0).alias("passed"))


def flow_stream(spark: SparkSession, path: str, schema: str = FLOW_EVENT) -> DataFrame:
    """A folder of JSON flow events as a stream; what doesn't parse comes as null and is dropped."""
    d = spark.readStream.text(path).select(F.from_json("value", schema).alias("e")).where("e is not null").select("e.*")
    return d.where(F.coalesce(F.col("direction"), F.col("method"), F.col("url")).isNotNull())
