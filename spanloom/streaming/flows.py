"""Request and response flows: messages and per-session totals, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import SPLITLINES

BODY_CAP, CHUNK_CAP, SHOWN = 65_536, 100, 30
#: Where a session id stands, in order, in a response's headers and in a request's (fixed values).
RESPONSE_HEADERS = ["x-request-id", "x-oai-request-id"]
REQUEST_HEADERS = ["x-session-id", "x-oai-request-id"]


def wanted(host: Column) -> Column:
    return F.contains(host, F.lit("openai.com")) | F.contains(host, F.lit("api.openai"))


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; null if it is missing or empty."""
    return F.nullif(F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0)), F.lit(""))


def session_id(direction: Column, headers: Column, request_headers: Column, connection: Column) -> Column:
    """A response's own headers first, then those of the request, then the connection's first 12 characters."""
    asked = F.when(direction == "request", headers).otherwise(request_headers)
    own = [F.when(direction == "response", header(headers, h)) for h in RESPONSE_HEADERS]
    return F.coalesce(*own, *[header(asked, h) for h in REQUEST_HEADERS], F.substring(connection, 1, 12))


def sse_chunks(body: Column) -> Column:
    """The first 100 data lines of an event stream; its end mark isn't one."""
    data = F.filter(F.split(body, SPLITLINES), lambda x: F.startswith(x, F.lit("data: ")) & (x != "data: [DONE]"))
    return F.transform(F.slice(data, F.lit(1), F.lit(CHUNK_CAP)), lambda x: F.substring(x, F.lit(7), F.length(x)))


def head(body: Column) -> Column:
    """The first 64 KB, what is left of a character at the cut replaced."""
    return F.when(F.octet_length(body) <= BODY_CAP, body).otherwise(F.make_valid_utf8(F.substring(F.encode(body, "UTF-8"), F.lit(1), F.lit(BODY_CAP)).cast("string")))


def _is_stream(content_type: Column) -> Column:
    return F.contains(F.coalesce(content_type, F.lit("")), F.lit("event-stream"))


def tokens(body: Column, content_type: Column | None = None) -> Column:
    """Total tokens as the body states them (the highest of a stream's chunks; other bodies within their first 64 KB), else a quarter of its bytes."""

    def said(x: Column) -> Column:
        return F.get_json_object(x, "$.usage.total_tokens").try_cast("bigint")

    kind = F.lit("") if content_type is None else content_type
    stated = F.when(_is_stream(kind), F.array_max(F.transform(sse_chunks(body), said))).otherwise(F.when(F.try_parse_json(head(body)).isNotNull(), said(head(body))))
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.coalesce(F.nullif(stated, F.lit(0)), F.floor(F.octet_length(body) / 4).cast("bigint")))


def parsed_body(body: Column, content_type: Column | None = None) -> Column:
    """struct(kind, text): empty; sse, an array of its chunks, those that are no JSON as strings; json; or text, within the first 64 KB.
    An event stream is told by its content type."""
    kind_of = F.lit("") if content_type is None else content_type

    def chunk(x: Column) -> Column:
        quoted = F.to_json(F.array(x))
        return F.when(F.try_parse_json(x).isNotNull(), x).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))

    kind = F.when(F.coalesce(body, F.lit("")) == "", "empty").when(_is_stream(kind_of), "sse").when(F.try_parse_json(head(body)).isNotNull(), "json").otherwise("text")
    text = F.when(kind == "sse", F.concat(F.lit("["), F.array_join(F.transform(sse_chunks(body), chunk), ","), F.lit("]"))).when(kind != "empty", head(body))
    return F.struct(kind.alias("kind"), text.alias("text"))


def url_path(url: Column) -> Column:
    """Path and at most 39 characters of the query; a text that is no URL as it is."""
    path, query = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    shown = F.when(query.isNull(), path).otherwise(F.concat(path, F.lit("?"), F.substring(query, 1, 39)))
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), url).otherwise(F.when(shown == "", "/").otherwise(shown))


def message_class(direction: Column, status: Column) -> Column:
    return F.when(status >= 400, "err").when(direction == "request", "req").otherwise("res")


def short_tokens(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(n.cast("string"))


def relative_time(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return (
        F.when(whole < 5, F.lit("now"))
        .when(whole < 60, F.concat(whole.cast("string"), F.lit("s")))
        .when(whole < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h")))
    )


def messages(events: DataFrame) -> DataFrame:
    """Raw events (sources.files.FLOW_EVENT) of the wanted hosts as flow rows."""
    d = events.where(wanted(F.col("host"))).withColumn("kind", header(F.col("headers"), "content-type"))
    session = session_id(F.col("direction"), F.col("headers"), F.col("request_headers"), F.col("connection_id"))
    return d.select(session.alias("session_id"), "direction", "method", "url", "status", parsed_body(F.col("body"), F.col("kind"))["text"].alias("body"), tokens(F.col("body"), F.col("kind")).alias("tokens"), "ts")


def session_totals(flows: DataFrame, watermark: str | None = None) -> DataFrame:
    """Per session: messages, tokens, last_ts, requests, responses. Batch or streaming (update or complete mode); the state of a stream is
    unbounded, as sessions are, unless a watermark is given (an extension), which closes hourly windows."""
    keys: list = ["session_id"]
    if watermark:
        flows = flows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", watermark)
        keys.append(F.window("at", "1 hour"))
    return flows.groupBy(*keys).agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("direction") == "request").alias("requests"), F.count_if(F.col("direction") == "response").alias("responses"),
    )


def global_totals(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(F.col("direction") == "request").alias("requests"), F.count_if(F.col("direction") == "response").alias("responses"))


def latest(flows: DataFrame, top: int = SHOWN) -> DataFrame:
    return flows.orderBy(F.desc("ts")).limit(top)


def start(flows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, name: str = "spanloom_sessions", every: str = "10 seconds", once: bool = False) -> StreamingQuery:
    """Run the totals as a stream into a sink per batch, or into a memory table."""
    w = session_totals(flows).writeStream.outputMode("update" if sink else "complete").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=every)
    return (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
