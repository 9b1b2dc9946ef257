"""Severity with its provenance, attributes, event time, lateness and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import running

# ---- fixed values: the severity scale and the sources' native levels
LEVELS = ["trace", "debug", "info", "notice", "warn", "error", "fatal"]
SYSLOG = {0: "fatal", 1: "fatal", 2: "fatal", 3: "error", 4: "warn", 5: "notice", 6: "info", 7: "debug"}
JOURNALD = {0: "fatal", 1: "fatal", 2: "fatal", 3: "error", 4: "warn", 5: "notice", 6: "info", 7: "debug"}
APP = {"trace": "trace", "debug": "debug", "info": "info", "notice": "notice", "warn": "warn", "warning": "warn", "error": "error", "fatal": "fatal", "panic": "fatal"}
MARKERS = {"FATAL": "fatal", "panic": "fatal", "ERROR": "error", "Exception": "error", "exception": "error", "Traceback": "error", "WARN": "warn", "WARNING": "warn"}
#: Optional markers by HTTP status, not part of the default rules.
HTTP_STATUS = [(200, 399, "info"), (400, 499, "warn"), (500, 599, "error")]


def rank(name: Column) -> Column:
    """0 for trace to 6 for fatal; null for what is unknown."""
    return _lookup({v: i for i, v in enumerate(LEVELS)}, name).cast("tinyint")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def syslog_level(raw: Column) -> Column:
    """From ``<PRI>`` at the start of a line."""
    return _lookup(SYSLOG, F.regexp_extract(raw, r"^<([0-9]{1,3})>", 1).try_cast("int") % 8)


def journald_level(priority: Column) -> Column:
    return _lookup(JOURNALD, priority.try_cast("int"))


def json_level(raw: Column, path: str = "$.level") -> Column:
    return _lookup(APP, F.lower(F.trim(F.get_json_object(raw, path))))


def app_level(value: Column) -> Column:
    return _lookup(APP, F.lower(F.trim(value)))


_MARKER = r"\b(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")\b"


def text_level(raw: Column) -> Column:
    """From the leftmost marker in the text."""
    return _lookup(MARKERS, F.nullif(F.regexp_extract(raw, _MARKER, 1), F.lit("")))


def http_status_level(raw: Column) -> Column:
    """The optional rule: the status after the quoted request."""
    status = F.regexp_extract(raw, r'" ([0-9]{3}) ', 1).try_cast("int")
    out = F.lit(None).cast("string")
    for low, high, name in reversed(HTTP_STATUS):
        out = F.when(status.between(low, high), name).otherwise(out)
    return out


def severity(structured: Column, pattern: Column) -> dict[str, Column]:
    """severity (name or null) and severity_source: structured, else pattern, else default; never a guess."""
    return {"severity": F.coalesce(structured, pattern), "severity_source": F.when(structured.isNotNull(), "structured").when(pattern.isNotNull(), "pattern").otherwise("default")}


def error_bearing(severity: Column, source: Column, floor: str = "warn") -> Column:
    """Trusted provenance and at least the floor; what is unknown is never error-bearing."""
    return F.coalesce(source.isin("structured", "pattern") & (rank(severity) >= LEVELS.index(floor)), F.lit(False))


_ENTRY = "array<struct<key:string,value:string>>"


def json_attributes(raw: Column) -> Column:
    """Top-level fields of a JSON line in their order, as (key, value); none if it is no object."""
    return F.coalesce(F.map_entries(F.from_json(raw, "map<string,string>")), F.array()).cast(_ENTRY)


def logfmt_attributes(raw: Column) -> Column:
    """key=value pairs of a line; a value may be quoted."""
    pairs = F.regexp_extract_all(raw, F.lit(r'[A-Za-z_][A-Za-z0-9_.-]*=(?:"[^"]*"|[^ "]*)'), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)), '^"|"$', "").alias("value")))


def attributes(fields: Column, captures: Column, source: Column) -> Column:
    """Fields, then what masks captured (by placeholder), then severity_source, which is always there."""
    held = F.transform(captures, lambda c: F.struct(c["placeholder"].alias("key"), c["value"].alias("value")))
    return F.concat(fields, held, F.array(F.struct(F.lit("severity_source").alias("key"), source.alias("value"))))


def attribute(attributes: Column, key: str) -> Column:
    """The last value of a key, or null."""
    found = F.filter(attributes, lambda a: a["key"] == key)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


_DATE, _CLOCK = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
_ZONE = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Formats that are looked for by default, by name: a pattern, how Spark reads it, whether it names its zone, and its resolution.
#: Fractions of a second are of any length, of which six digits count. Years of RFC 3164 are those of ``year``.
FORMATS = {
    "rfc3339_ms": (_DATE + "[Tt]" + _CLOCK + r"[.,][0-9]{1,3}" + _ZONE, "yyyy-MM-dd'T'HH:mm:ss[.SSS][.SS][.S]XXX", True, "ms"),
    "rfc3339_us": (_DATE + "[Tt]" + _CLOCK + r"[.,][0-9]{4,}" + _ZONE, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", True, "us"),
    "rfc3339": (_DATE + "[Tt]" + _CLOCK + _ZONE, "yyyy-MM-dd'T'HH:mm:ssXXX", True, "s"),
    "access_log": (r"[0-9]{2}/" + _MONTH + r"/[0-9]{4}:" + _CLOCK + r" [+-][0-9]{4}", "dd/MMM/yyyy:HH:mm:ss Z", True, "s"),
    "iso_local_ms": (_DATE + "[T ]" + _CLOCK + r"[.,][0-9]{1,9}", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", False, "ms"),
    "iso_local": (_DATE + "[T ]" + _CLOCK, "yyyy-MM-dd'T'HH:mm:ss", False, "s"),
    "rfc3164": (_MONTH + r" {1,2}[0-9]{1,2} " + _CLOCK, "yyyy MMM d HH:mm:ss", False, "s"),
    "epoch_ms": (r"^[\[(]?1[0-9]{12}(?![0-9])", "epoch", True, "ms"),
    "epoch": (r"^[\[(]?1[0-9]{9}(?:\.[0-9]{1,9})?(?![0-9])", "epoch", True, "s"),
}


def _read_time(name: str, found: Column, form: str, year: Column) -> Column:
    """A timestamp from what a format's pattern found, or null."""
    if form == "epoch":
        n = F.regexp_replace(found, r"^[\[(]", "").try_cast("decimal(28,9)")
        return F.timestamp_micros((n * (1000 if name.endswith("_ms") else 1_000_000)).cast("bigint"))
    if name == "rfc3164":
        return F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(found, " +", " ")), F.lit(form))
    if name == "access_log":
        return F.try_to_timestamp(found, F.lit(form))
    # one spelling: T between date and time, six digits of a second, a colon in the zone
    parts = F.regexp_extract(found, r"^(.{10})", 1), F.regexp_extract(found, r"^.{11}(.{8})", 1)
    fraction = F.substring(F.concat(F.regexp_extract(found, r"^.{19}[.,]([0-9]+)", 1), F.lit("000000")), 1, 6)
    zone = F.regexp_replace(F.upper(F.regexp_extract(found, r"([Zz]|[+-][0-9]{2}:?[0-9]{2})$", 1)), r"^([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    zoned = name.startswith("rfc3339")
    return F.try_to_timestamp(F.concat(parts[0], F.lit("T"), parts[1], F.lit("."), fraction, zone if zoned else F.lit("")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + ("XXX" if zoned else "")))


def event_time(raw: Column, *, default_zone: str | None = None, ingestion_zone: str = "UTC", formats: list[str] | None = None, by_stream: dict[str, list[str]] | None = None, stream: Column | None = None, year: Column | None = None) -> dict[str, Column]:
    """event_time, tz_source (explicit, stream_default or ingestion_fallback) and resolution by the first format that parses;
    all null if none does. ``formats`` names those to look for (all by default), ``by_stream`` those of single streams, by the
    column ``stream``; ``year`` is that of times that tell none (this year by default). The session's zone must be UTC."""
    lists = {None: formats or list(FORMATS)} | (by_stream or {})
    year = year if year is not None else F.year(F.current_timestamp())
    found = []
    for name, (pattern, form, zoned, unit) in FORMATS.items():
        # none of the streams reads it: no expression
        named = [s for s, wanted in lists.items() if s is not None and name in wanted]
        if name not in lists[None] and not named:
            continue
        text = F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))
        if by_stream:
            others = stream.isin(*(s for s in lists if s is not None))
            text = F.when((stream.isin(*named) if named else F.lit(False)) | (~others if name in lists[None] else F.lit(False)), text)
        told = "explicit" if zoned else "stream_default" if default_zone else "ingestion_fallback"
        found.append(_told(text, name, form, year, None if zoned else default_zone or ingestion_zone, told, unit))
    # the first that reads a time is the last that is tried
    one = F.coalesce(*found, F.lit(None).cast("struct<at:timestamp,source:string,resolution:string>"))
    return {"event_time": one["at"], "tz_source": one["source"], "resolution": one["resolution"]}


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _told(text: Column, name: str, form: str, year: Column, zone: str | None, source: str, unit: str) -> Column:
    def held(at: Column) -> Column:
        return F.when(at.isNotNull(), F.struct(at.cast("timestamp").alias("at"), F.lit(source).alias("source"), F.lit(unit).alias("resolution")))

    def read(t: Column) -> Column:
        at = _read_time(name, t, form, year)
        return _let(at if zone is None else F.to_utc_timestamp(at, zone), held)

    return F.when(text.isNotNull(), _let(text, read))


def order_time(event: str = "event_time", ingestion: str = "ingestion_time") -> Column:
    return F.coalesce(F.col(event), F.col(ingestion))


def lateness(events: DataFrame, *, bound_seconds: int = 600, stream: str = "stream_id", order: str = "source_offset", time: str = "event_time") -> DataFrame:
    """Adds watermark (the greatest earlier time in the stream) and lateness (on_time, late, very_late; null without a time). No row goes."""
    gap = F.unix_micros(F.col("watermark").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    state = F.when(F.col(time).isNull(), F.lit(None)).when(F.col("watermark").isNull() | (gap <= 0), "on_time").when(gap <= bound_seconds * 1_000_000, "late").otherwise("very_late")
    return running.greatest_before(events, [stream], order, time, "watermark").withColumn("lateness", state)


def merged_order(events: DataFrame) -> DataFrame:
    """Streams merged best-effort: by event time or else ingestion time, then stream and offset."""
    return events.orderBy(order_time(), "stream_id", "source_offset")


def severity_accuracy(events: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of right severities by provenance; unknown where the label is null is right."""
    both = events.join(labels.select(*keys, F.col("severity").alias("expected")), keys)
    right = F.col("severity").eqNullSafe(F.col("expected"))
    return both.groupBy("severity_source").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
