"""What a user looks at: streams, filters, query, viewport, history; intent only, no data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from timberline.plans import lql

SCHEMA_VERSION = 1


@dataclass
class Filter:
    query: str
    enabled: bool = True


@dataclass
class Workspace:
    streams: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    query: str = ""
    anchor: tuple[str, int] | None = None
    size: int = 100
    follow_tail: bool = False
    bookmarks: list[tuple[str, int]] = field(default_factory=list)
    history: list[str] = field(default_factory=list)

    def compiled(self) -> str:
        """Streams, enabled filters and the query as one LQL query."""
        parts = [f"({f.query})" for f in self.filters if f.enabled]
        if self.streams:
            parts.insert(0, "stream in (" + ", ".join(json.dumps(s) for s in self.streams) + ")")
        return " and ".join([*parts, *([f"({self.query})"] if self.query else [])])

    def run(self, events: DataFrame) -> DataFrame:
        source = self.compiled()
        return lql.run(events, source) if source else events

    def submit(self, query: str) -> None:
        lql.validate(lql.parse(query))
        self.query = query
        self.history.append(query)

    def recall(self, at: int) -> str:
        """The entry of the history becomes the query again."""
        self.query = self.history[at]
        return self.query

    def page(self, events: DataFrame) -> DataFrame:
        return lql.viewport(self.run(events), anchor=self.anchor, size=self.size, follow_tail=self.follow_tail)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"schema_version": SCHEMA_VERSION} | asdict(self), f)

    @classmethod
    def restore(cls, path: str) -> Workspace:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if held.pop("schema_version", None) != SCHEMA_VERSION:
            raise ValueError("a snapshot of another version")
        held["filters"] = [Filter(**x) for x in held["filters"]]
        held["anchor"] = tuple(held["anchor"]) if held["anchor"] else None
        held["bookmarks"] = [tuple(b) for b in held["bookmarks"]]
        return cls(**held)
