"""Registered queries over sources, segments, streams, plugins and workspaces, and their SQL."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline import catalog
from timberline.catalog import query
from timberline.functions import masking, scratch
from timberline.functions.formats import SQL_TEXT_LINES, event_lines, sql_event_lines, table
from timberline.operators import corpus, insights, mining, redact
from timberline.plans import ingest, lql, plugins, workspace
from timberline.sources import files, segments
from timberline.streaming import mine as streaming

# ---- sources


def _files(spark, sf_dir) -> str:
    """The rendered access log as one file of text."""
    path = scratch.folder(spark, "files")
    files.write_file(event_lines(table(spark, sf_dir, "events"), "nginx"), f"{path}/access.log", order="source_offset", line="raw")
    return path


_FILE_LINES = f"SELECT raw, CAST(coalesce(sum(octet_length(encode(raw)) + 1) OVER (ORDER BY source_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_offset FROM ({sql_event_lines('nginx')})"


@query("file_lines", _FILE_LINES)
def file_lines(spark, sf_dir):
    """Lines and the bytes at which they begin."""
    return files.read_files(spark, _files(spark, sf_dir)).select("raw", "source_offset")


@query("file_lines_from", f"SELECT * FROM ({_FILE_LINES}) WHERE source_offset >= 10000")
def file_lines_from(spark, sf_dir):
    """From a cursor on."""
    path = _files(spark, sf_dir)
    name = files.read_files(spark, path).select("stream_id").first()["stream_id"]
    return files.read_files(spark, path, start={name: 10_000}).select("raw", "source_offset")


@query("raw_event_fields", f"SELECT raw, source_offset, 0 AS generation, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS template_id FROM ({_FILE_LINES})")
def raw_event_fields(spark, sf_dir):
    """Events as they are admitted, with nothing derived yet."""
    return files.raw_events(files.read_files(spark, _files(spark, sf_dir))).select("raw", "source_offset", "generation", "severity", "template_id")


@query("tail_lines", _FILE_LINES)
def tail_lines(spark, sf_dir):
    """The same file read as a stream, in tasks of 64 KB; backlog and tail have the same offsets as files."""
    # a tail reads files of a folder that every executor mounts, which a temporary folder of the driver's need not be
    folder = files.local_path(scratch.folder(spark, "tail"))
    os.makedirs(folder)
    # by hand: Hadoop's file systems leave checksum files beside theirs
    shutil.copyfile(f"{files.local_path(_files(spark, sf_dir))}/access.log", f"{folder}/access.log")
    files.register(spark)
    target, marks = scratch.folder(spark, "tail-out"), scratch.folder(spark, "tail-marks")
    live = spark.readStream.format("line_tail").option("path", folder).option("maxBytesPerTask", 1 << 16).load()
    run = live.writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).start()
    run.processAllAvailable()
    run.stop()
    return spark.read.schema(files.RAW).parquet(target).select("raw", "source_offset")


@query("journal_events", "SELECT 'unit' || user_id % 3 || '.service' AS stream_id, event_id AS source_offset, 'user ' || user_id || ' ' || event_type AS raw, CAST(event_id % 8 AS VARCHAR) AS priority FROM events")
def journal_events(spark, sf_dir):
    path = scratch.folder(spark, "journal")
    text = lambda *parts: F.concat(*(F.lit(p) if p[0] != "$" else F.col(p[1:]).cast("string") for p in parts))
    rows = table(spark, sf_dir, "events").select(
        text("user ", "$user_id", " ", "$event_type").alias("MESSAGE"), (F.col("event_id") % 8).cast("string").alias("PRIORITY"), F.concat(F.lit("unit"), (F.col("user_id") % 3).cast("string"), F.lit(".service")).alias("_SYSTEMD_UNIT"), F.col("event_id").cast("string").alias("__REALTIME_TIMESTAMP"),
    )
    rows.write.json(path)
    return files.read_journal(spark, path).select("stream_id", "source_offset", "raw", "priority")


@query("docker_events", "SELECT CASE WHEN event_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END AS channel, epoch_us(date_trunc('millisecond', ts)) AS source_offset, event_type AS raw FROM events")
def docker_events(spark, sf_dir):
    path = scratch.folder(spark, "docker")
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("\n")).alias("log"), F.when(F.col("event_id") % 2 == 0, "stdout").otherwise("stderr").alias("stream"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"))
    rows.write.json(path)
    return files.read_docker(spark, path).select(F.element_at(F.split("stream_id", ":"), -1).alias("channel"), "source_offset", "raw")


@query(
    "file_generations",
    """SELECT stream_id, seen_at, CAST(sum(fresh) OVER (PARTITION BY stream_id ORDER BY seen_at) AS INTEGER) AS generation FROM (
    SELECT 'u' || user_id AS stream_id, event_id AS seen_at, CASE WHEN lag(event_type) OVER w <> event_type OR lag(value) OVER w > value THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
)
def file_generations(spark, sf_dir):
    """Events as looks at files, whose identity is the type and whose size is the value."""
    shots = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("stream_id"), F.col("event_id").alias("seen_at"), F.col("event_type").alias("identity"), F.col("value").alias("size"))
    return files.generations(shots).select("stream_id", "seen_at", "generation")


# ---- admission


@query("redact_withheld", f"SELECT count(*) FILTER (NOT contains(raw, 'token')) AS admitted, count(*) FILTER (contains(raw, 'token')) AS withheld FROM ({SQL_TEXT_LINES})")
def redact_withheld(spark, sf_dir):
    """A redactor that fails on some lines: these are held back, not let through."""

    def odd(text: str) -> str:
        if "token" in text:
            raise ValueError(text)
        return text.upper()

    let, held = redact.plugged(catalog.lines(spark, sf_dir), odd)
    return let.agg(F.count("*").alias("admitted")).crossJoin(F.broadcast(held.agg(F.count("*").alias("withheld"))))


_ODD = "SELECT 'odd' AS stream_id, event_id AS source_offset, CASE WHEN event_id % 997 = 0 THEN repeat('long', 17000) WHEN event_id % 7 = 0 THEN chr(9) WHEN event_id % 7 = 1 THEN NULL ELSE event_type || ' of ' || user_id END AS raw FROM events"


@query("unparsed_lines", f"SELECT source_offset, {masking.sql_status('raw')} AS parse_status, CAST(NULL AS BIGINT) AS template_id, length(raw) AS size FROM ({_ODD}) WHERE {masking.sql_status('raw')} <> 'ok'")
def unparsed_lines(spark, sf_dir):
    """Empty, missing and over-long lines stay, without a template."""
    n = F.col("event_id")
    raw = F.when(n % 997 == 0, F.repeat(F.lit("long"), F.lit(17_000))).when(n % 7 == 0, "\t").when(n % 7 == 1, None).otherwise(F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")))
    rows = ingest.parse(table(spark, sf_dir, "events").select(F.lit("odd").alias("stream_id"), n.alias("source_offset"), raw.alias("raw")))
    mined = mining.mine_online(rows.select("stream_id", "source_offset", "raw", "parse_status", "masked"))
    return mined.filter("parse_status <> 'ok'").select("source_offset", "parse_status", "template_id", F.length("raw").alias("size"))


@query(
    "template_similarity",
    f"""{catalog._REGISTRY} SELECT n.stream_id, n.source_offset, CAST(len(list_filter(list_zip(masked, str_split(t.pattern, ' ')), lambda z: z[1] = z[2] OR z[2] = '<*>')) AS DOUBLE) / len(masked) AS similarity
FROM numbered AS n JOIN registry AS t ON n.stream_id = t.stream_id AND n.template_id = t.template_id""",
)
def template_similarity(spark, sf_dir):
    """Of every line with its template as it is at the end: 1 wherever widening only ever widens."""
    return catalog._mined(spark, sf_dir).similarities()


# ---- segments


@query("segment_terms", f"SELECT stream_id, source_offset, event_type FROM ({catalog._EVENTS}) WHERE event_type = 'click'")
def segment_terms(spark, sf_dir):
    """Events by a term, after sealing and compaction."""
    store = catalog._store(spark, sf_dir)
    store.compact([0, 1])
    return store.read(terms=["click"])[0].select("stream_id", "source_offset", "event_type")


@query("segment_quarantined", f"SELECT stream_id, source_offset FROM ({catalog._EVENTS}) WHERE least((day(time) - 1) // 8, 3) <> 1")
def segment_quarantined(spark, sf_dir):
    """A segment whose rows are not what was sealed is set aside; the others open."""
    store = catalog._store(spark, sf_dir)
    spark.read.parquet(store._folder(0)).limit(10).write.mode("overwrite").parquet(store._folder(1))
    if store.verify() != [1]:
        raise AssertionError("the damaged segment was not found")
    return store.read()[0].select("stream_id", "source_offset")


@query("segment_missing", f"SELECT stream_id, source_offset FROM ({catalog._EVENTS}) WHERE least((day(time) - 1) // 8, 3) <> 2")
def segment_missing(spark, sf_dir):
    """A segment that is gone makes the answer partial, and says so."""
    store = catalog._store(spark, sf_dir)
    fs, path = store._fs(store._folder(2))
    fs.delete(path, True)
    rows, coverage = store.read()
    if not coverage["partial"] or coverage["missing"] != [2]:
        raise AssertionError("the answer is not marked as partial")
    return rows.select("stream_id", "source_offset")


@query("sink_insights", f"SELECT kind, template_id, status, confidence, bumps FROM ({catalog._PIPE})")
def sink_insights(spark, sf_dir):
    """Insights through the file sink and back."""
    path = scratch.folder(spark, "sink")
    plugins.FileSink(path).emit(catalog._pipeline(spark, sf_dir))
    return spark.read.schema("kind string, template_id string, status string, confidence double, bumps bigint").json(path)


# ---- streams


def _live(spark, rows: DataFrame) -> DataFrame:
    source = scratch.folder(spark, "live")
    rows.write.parquet(source)
    return spark.readStream.schema(rows.schema).parquet(source)


@query("stream_lateness", catalog.ORACLE_SQL["lateness"].replace("source_offset, watermark, CASE", "source_offset, CASE"))
def stream_lateness(spark, sf_dir):
    """Late events flagged as they come; none goes."""
    rows = catalog._events(spark, sf_dir).select("stream_id", "source_offset", F.col("event_time").cast("timestamp").alias("event_time"))
    target, marks = scratch.folder(spark, "late-out"), scratch.folder(spark, "late-marks")
    run = streaming.lateness_stream(_live(spark, rows)).writeStream.format("parquet").option("path", target).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(streaming.LATE).parquet(target).select("source_offset", "lateness")


@query("stream_sealed", f"SELECT stream_id, source_offset, event_type FROM ({catalog._EVENTS})")
def stream_sealed(spark, sf_dir):
    """Micro-batches sealed as segments, by a run that is started twice: each event once."""
    live = _live(spark, catalog._events(spark, sf_dir))
    store, marks = segments.Store(spark, scratch.folder(spark, "sealed")), scratch.folder(spark, "sealed-marks")
    for _ in range(2):
        streaming.seal_batches(store, live, marks).awaitTermination()
    return store.read()[0].select("stream_id", "source_offset", "event_type")


@query("stream_window_counts", "SELECT 'events' AS stream_id, event_type AS template_id, date_trunc('hour', ts) AS win_start, count(*) AS cnt FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """Tumbling counts of a stream, with no row too late."""
    live = _live(spark, catalog._subjects(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp")))
    target = scratch.folder(spark, "counts")
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
    streaming.window_counts_stream(live).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch.folder(spark, "counts-marks")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select("stream_id", "template_id", F.col("win_start").cast("timestamp_ntz").alias("win_start"), "cnt")


@query("stream_detect", f"SELECT kind, template_id, win_start, cnt, confidence FROM ({catalog._SPIKE}) WHERE win_start < (SELECT max(date_trunc('hour', ts)) FROM events)")
def stream_detect(spark, sf_dir):
    """Spikes told by a running stream, of all windows but the one that is still open."""
    live = _live(spark, catalog._subjects(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp")))
    target = scratch.folder(spark, "told")
    detector = streaming.Detector(spark, scratch.folder(spark, "detector"), insights.Settings(window="1 hour"), lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}"), horizon="10000 days")
    detector.start(live, scratch.folder(spark, "detector-marks")).awaitTermination()
    return spark.read.parquet(target).select("kind", "template_id", F.col("win_start").cast("timestamp_ntz").alias("win_start"), "cnt", "confidence")


# ---- plugins and workspaces


@query(
    "corpus_mask_miner",
    f"SELECT 'syslog-rfc5424' AS format_id, count(*) AS lines, round(avg(CASE WHEN array_to_string(masked, ' ') = expected THEN 1.0 ELSE 0.0 END), 6) AS pa_exact FROM ({catalog._EVENT_MASKED['syslog']}) AS m JOIN (SELECT source_offset, {catalog._GOLDEN_SQL['syslog'][1]} AS expected FROM (SELECT source_offset, {catalog._GOLDEN_SQL['syslog'][0]} AS gid FROM ({sql_event_lines('syslog')}))) AS g ON g.source_offset = m.source_offset",
)
def corpus_mask_miner(spark, sf_dir):
    """Another miner behind the same protocol: the masked line is its template."""

    def plain(lines: DataFrame) -> DataFrame:
        pattern = masking.pattern(masking.masked(masking.tokens(F.col("raw"))))
        return lines.select("format_id", "line", pattern.alias("pattern"), pattern.alias("group"))

    assigned = corpus.assignments(*catalog._corpus(spark, sf_dir), miner=plain)
    return corpus.accuracy(assigned).filter("format_id = 'syslog-rfc5424'").select("format_id", "lines", "pa_exact")


@query("plugin_enrichers", "SELECT event_id, upper(event_type) AS loud, event_type || '!' AS told FROM events")
def plugin_enrichers(spark, sf_dir):
    """Two enrichers, of which one fails and is isolated, and a query function."""

    class Loud:
        def enrich(self, events):
            return events.withColumn("loud", F.upper("event_type"))

    class Broken:
        def enrich(self, events):
            return events.select("nosuch")

    held = plugins.Registry()
    for name, one in (("loud", Loud()), ("broken", Broken())):
        held.register(name, "Enricher", one)
        held.validate(name)
        held.activate(name)
    out = held.apply("Enricher", lambda p: p.enrich(table(spark, sf_dir, "events")))
    if set(out) != {"loud"} or held.held["broken"]["state"] != "isolated":
        raise AssertionError("the broken enricher was not isolated")
    held.functions(spark, {"tell": F.pandas_udf(lambda s: s + "!", "string")})
    return out["loud"].select("event_id", "loud", F.call_function("tell", F.col("event_type")).alias("told"))


@query("workspace_restored", f"SELECT stream_id, source_offset FROM ({catalog._LOG}) WHERE stream_id IN ('syslog', 'other') AND {catalog._rank('severity')} >= 4 AND contains(raw, 'failed')")
def workspace_restored(spark, sf_dir):
    """Streams, filters and a recalled query of a workspace that was saved and restored."""
    held = workspace.Workspace(streams=["syslog", "other"], filters=[workspace.Filter("severity >= warn"), workspace.Filter("template_id = 99", enabled=False)])
    held.submit('text contains "failed"')
    held.submit("severity = info")
    held.recall(0)
    with tempfile.NamedTemporaryFile(suffix=".json") as f:
        held.save(f.name)
        again = workspace.Workspace.restore(f.name)
    return again.run(catalog.log(spark, sf_dir)).select("stream_id", "source_offset")


@query("workspace_page", f"SELECT stream_id, source_offset FROM ({catalog._EVENTS}) WHERE event_type = 'click' AND (stream_id, source_offset) >= ('u3', 100) ORDER BY stream_id, source_offset LIMIT 40")
def workspace_page(spark, sf_dir):
    held = workspace.Workspace(query="attr.type = click", anchor=("u3", 100), size=40)
    return held.page(catalog._click_events(spark, sf_dir)).select("stream_id", "source_offset")


@query("lql_after_prune", f"SELECT stream_id, source_offset FROM ({catalog._EVENTS}) WHERE event_type = 'error' AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def lql_after_prune(spark, sf_dir):
    """A query over segments that its time window and a term leave gives what it gives over all."""
    source = "attr.type = error during [2024-01-05T00:00:00, 2024-01-20T00:00:00]"
    begin, end = lql.bounds(lql.parse(source))
    rows, _ = catalog._store(spark, sf_dir).read(begin=begin, end=end, terms=["error"])
    rows = rows.withColumn("attributes", F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value"))))
    return lql.run(rows, source).select("stream_id", "source_offset")
