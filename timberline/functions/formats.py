"""Log lines rendered from the test tables, and the lines of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(docs: DataFrame, *, stream: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """stream_id, source_offset (key * 2^20 + line from 0) and raw of every line; a carriage return at its end goes."""
    lines = docs.select(F.col(stream).cast("string").alias("stream_id"), F.col(key).alias("__key"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    return lines.select("stream_id", (F.col("__key") * (1 << 20) + F.col("line")).alias("source_offset"), F.regexp_replace("raw", r"\r\z", "").alias("raw"))


SQL_TEXT_LINES = """
SELECT source AS stream_id, doc_id * 1048576 + i - 1 AS source_offset, regexp_replace(u.l[i], '\\r\\z', '') AS raw
FROM (SELECT source, doc_id, str_split(text, chr(10)) AS l FROM documents) AS u, unnest(range(1, len(u.l) + 1)) AS r(i)"""


def event_lines(events: DataFrame, kind: str) -> DataFrame:
    """stream_id, source_offset, ts, event_type and raw of the events table as nginx, syslog or json lines."""
    user, n, ts = F.col("user_id"), F.col("event_id"), F.col("ts")
    method = F.element_at(F.array(*map(F.lit, ["GET", "POST", "DELETE"])), (user % 3).cast("int") + 1)
    status = F.element_at(F.array(*map(F.lit, ["200", "404", "500", "302"])), (n % 4).cast("int") + 1)
    if kind == "nginx":
        when = F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss")
        raw = F.concat(F.lit("10.0."), (user % 256).cast("string"), F.lit("."), (n % 256).cast("string"), F.lit(" - - ["), when, F.lit(' +0000] "'), method, F.lit(" /"), "event_type", F.lit("/"), n.cast("string"), F.lit(' HTTP/1.1" '), status, F.lit(" "), (n * 7 % 5000).cast("string"))
    elif kind == "syslog":
        level = F.element_at(F.array(*map(F.lit, ["134", "131", "130", "133"])), (n % 4).cast("int") + 1)
        raw = F.concat(F.lit("<"), level, F.lit(">1 "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z host01 app - - - "), "event_type", F.lit(" by user "), user.cast("string"), F.when(n % 5 == 0, " failed: ERROR").otherwise(" done"))
    else:
        level = F.element_at(F.array(*map(F.lit, ["info", "WARN", "error", "odd"])), (n % 4).cast("int") + 1)
        raw = F.concat(F.lit('{ "level" : "'), level, F.lit('" , "msg" : "'), "event_type", F.lit('" , "user_id" : '), user.cast("string"), F.lit(' , "id" : "'), F.lpad(F.lower(F.hex(n)), 8, "a"), F.lit('" }'))
    return events.select(F.lit(kind).alias("stream_id"), n.alias("source_offset"), "ts", "event_type", raw.alias("raw"))


def sql_event_lines(kind: str) -> str:
    method, status = "['GET', 'POST', 'DELETE'][user_id % 3 + 1]", "['200', '404', '500', '302'][event_id % 4 + 1]"
    if kind == "nginx":
        raw = f"""'10.0.' || user_id % 256 || '.' || event_id % 256 || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || {method} || ' /' || event_type || '/' || event_id || ' HTTP/1.1" ' || {status} || ' ' || event_id * 7 % 5000"""
    elif kind == "syslog":
        raw = "'<' || ['134', '131', '130', '133'][event_id % 4 + 1] || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z host01 app - - - ' || event_type || ' by user ' || user_id || CASE WHEN event_id % 5 = 0 THEN ' failed: ERROR' ELSE ' done' END"
    else:
        raw = """'{ "level" : "' || ['info', 'WARN', 'error', 'odd'][event_id % 4 + 1] || '" , "msg" : "' || event_type || '" , "user_id" : ' || user_id || ' , "id" : "' || lpad(lower(hex(event_id)), 8, 'a') || '" }'"""
    return f"SELECT '{kind}' AS stream_id, event_id AS source_offset, ts, event_type, {raw} AS raw FROM events"
