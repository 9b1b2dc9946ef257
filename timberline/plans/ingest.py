"""From raw lines to enriched, mined events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import fnv, masking
from timberline.operators import enrich, mining, redact


def parse(lines: DataFrame) -> DataFrame:
    """Adds parse_status, tokens and masked; every line stays."""
    rows = lines.withColumns({"parse_status": masking.parse_status(F.col("raw")), "tokens": masking.tokens(F.col("raw"))})
    return rows.withColumn("masked", masking.masked(F.col("tokens")))


def derive(events: DataFrame, *, json_severity: bool = True, default_zone: str | None = None, time_formats: list[str] | None = None, times_by_stream: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds event_time, tz_source, resolution, severity, severity_source, captures and attributes, in that order. Formats of times are
    names of ``enrich.FORMATS``, for all streams and for single ones."""
    raw = F.col("raw")
    structured = F.coalesce(enrich.syslog_level(raw), enrich.json_level(raw)) if json_severity else enrich.syslog_level(raw)
    rows = events.withColumns(enrich.event_time(raw, default_zone=default_zone, formats=time_formats, by_stream=times_by_stream, stream=F.col("stream_id"))).withColumns({"__s": structured, "__p": enrich.text_level(raw)})
    rows = rows.withColumns(enrich.severity(F.col("__s"), F.col("__p"))).drop("__s", "__p").withColumn("captures", masking.captures(F.col("tokens")))
    return rows.withColumn("attributes", enrich.attributes(enrich.json_attributes(raw), F.col("captures"), F.col("severity_source")))


def ingest(lines: DataFrame, *, classes: list | None = None, params: mining.Params | None = None, formats: dict[str, str] | None = None, **derived) -> DataFrame:
    """Redact, parse, derive, fingerprint and mine: lines have stream_id, source_offset and raw. ``formats`` names the known
    formats of streams, which set the depth of their mining; what else is named goes to ``derive``."""
    params = params or mining.Params.of_formats(formats or {})
    rows = derive(parse(lines.withColumn("raw", redact.redact(F.col("raw"), classes))), **derived)
    rows = rows.withColumn("fingerprint", F.when(F.size("masked") > 0, fnv.fingerprint(F.col("masked"))))
    return mining.mine_online(rows, params)
