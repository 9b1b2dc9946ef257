"""Command line: ingest, query, validate, status, version."""

from __future__ import annotations

import argparse
import json
import sys

from timberline.plans import lql, settings

VERSION = "0.1.0"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="timberline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {"ingest": ["path", "store"], "query": ["store", "query"], "status": ["store"], "validate": [], "version": []}.items():
        p = verbs.add_parser(verb)
        for n in names:
            p.add_argument(n)
        p.add_argument("--config")
        p.add_argument("--limit", type=int, default=100)
    given = parser.parse_args(args)
    if given.verb == "version":
        print(VERSION)
        return 0
    try:
        config = settings.load(given.config)
        if given.verb == "query":
            lql.validate(lql.parse(given.query))
    except (settings.ConfigError, lql.QueryError) as e:
        print(e, file=sys.stderr)
        return 2
    if given.verb == "validate":
        print("valid")
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from timberline.operators import enrich
    from timberline.plans import ingest
    from timberline.shipping import ship
    from timberline.sources import files, segments

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    store = segments.Store(spark, given.store)
    if given.verb == "ingest":
        lines = files.read_files(spark, given.path).withColumn("ingestion_time", F.current_timestamp())
        classes = [(r["class"], r["pattern"]) for r in config["redaction"]] or None
        rows = ingest.ingest(lines, classes=classes, params=settings.mining_params(config), default_zone=config["default_timezone"], times_by_stream=settings.times_by_stream(config) or None)
        print(store.seal(rows.withColumn("time", enrich.order_time().cast("timestamp_ntz"))))
    elif given.verb == "query":
        begin, end = lql.bounds(lql.parse(given.query))
        rows, coverage = store.read(begin=begin, end=end)
        for row in [] if rows is None else lql.run(rows, given.query).limit(given.limit).toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
        if coverage["partial"]:
            print("partial:", coverage["missing"] + coverage["quarantined"], file=sys.stderr)
    else:
        for row in store.manifest().orderBy("segment_id", "stream_id").toLocalIterator():
            print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
