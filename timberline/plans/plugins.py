"""Extension points as protocols, a registry with states, a bus of callbacks, and budgets."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class SourceAdapter(Protocol):
    def read(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class Enricher(Protocol):
    def enrich(self, events: DataFrame) -> DataFrame: ...


@runtime_checkable
class TemplateMiner(Protocol):
    def mine(self, events: DataFrame) -> DataFrame: ...


@runtime_checkable
class QueryEvaluator(Protocol):
    def run(self, events: DataFrame, source: str) -> DataFrame: ...


@runtime_checkable
class InsightDetector(Protocol):
    def detect(self, baselines: DataFrame) -> DataFrame: ...


@runtime_checkable
class Sink(Protocol):
    def emit(self, insights: DataFrame) -> None: ...


@runtime_checkable
class StorageBackend(Protocol):
    def seal(self, events: DataFrame, segment: int | None = None) -> int: ...


KINDS = {c.__name__: c for c in (SourceAdapter, Enricher, TemplateMiner, QueryEvaluator, InsightDetector, Sink, StorageBackend)}


class Registry:
    """register, validate, activate, isolate, deactivate; a plugin that fails is isolated and the rest goes on."""

    def __init__(self):
        self.held: dict[str, dict[str, Any]] = {}

    def register(self, name: str, kind: str, plugin: object) -> None:
        if name in self.held:
            raise ValueError(f"{name} is registered")
        self.held[name] = {"kind": kind, "plugin": plugin, "state": "registered", "error": None}

    def validate(self, name: str) -> None:
        x = self.held[name]
        if x["kind"] not in KINDS or not isinstance(x["plugin"], KINDS[x["kind"]]):
            raise TypeError(f"{name} is no {x['kind']}")
        x["state"] = "validated"

    def activate(self, name: str) -> None:
        if self.held[name]["state"] not in ("validated", "inactive"):
            raise ValueError(f"{name} is {self.held[name]['state']}")
        self.held[name]["state"] = "active"

    def deactivate(self, name: str) -> None:
        self.held[name]["state"] = "inactive"

    def apply(self, kind: str, call: Callable[[Any], Any]) -> dict[str, Any]:
        """The results of all active plugins of a kind."""
        out = {}
        for name, x in self.held.items():
            if x["kind"] == kind and x["state"] == "active":
                try:
                    out[name] = call(x["plugin"])
                except Exception as e:  # noqa: BLE001  whatever a plugin raises isolates it alone
                    x["state"], x["error"] = "isolated", f"{type(e).__name__}: {e}"
        return out

    def functions(self, spark: SparkSession, functions: dict[str, Callable]) -> None:
        """Functions of plugins for SQL."""
        for name, f in functions.items():
            spark.udf.register(name, f)


class FileSink:
    """Writes insights as JSON lines into a folder."""

    def __init__(self, path: str):
        self.path = path

    def emit(self, insights: DataFrame) -> None:
        insights.write.mode("append").json(self.path)


class ChannelSink:
    """Gives pushed insights to a callback, one at a time, without holding them all."""

    def __init__(self, call: Callable[[dict], None]):
        self.call = call

    def emit(self, insights: DataFrame) -> None:
        for row in insights.toLocalIterator():
            self.call(row.asDict(recursive=True))


class Bus:
    """Topics and callbacks; a callback that fails does not stop the others."""

    def __init__(self):
        self.calls: dict[str, list[Callable]] = defaultdict(list)
        self.failed: list[tuple[str, str]] = []

    def subscribe(self, topic: str, call: Callable[[dict], None]) -> Callable[[], None]:
        self.calls[topic].append(call)
        return lambda: self.calls[topic].remove(call)

    def publish(self, topic: str, event: dict) -> int:
        n = 0
        for call in list(self.calls[topic]):
            try:
                call(event)
                n += 1
            except Exception as e:  # noqa: BLE001
                self.failed.append((topic, str(e)))
        return n


def with_retries(call: Callable[[], Any], *, tries: int = 4, first: float = 0.1, jitter: Callable[[], float] = random.random, sleep: Callable[[float], None] = time.sleep, dead_letter: Callable[[Exception], None] | None = None) -> Any:
    """Call again after growing, jittered pauses; after the last try the error goes to the dead letters, or on."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001  what fails for good is reported below
            if k == tries - 1:
                if dead_letter is None:
                    raise
                dead_letter(e)
                return None
            sleep(first * 2**k * (0.5 + jitter()))
    return None


#: Measures of the budgets; which way is worse.
BUDGETS = {"ingest_latency_p99_ms": "max", "query_first_result_ms": "max", "query_complete_ms": "max", "memory_mb_per_gb": "max", "indexing_lines_per_s": "min"}


def evaluate(budgets: dict[str, float], measured: dict[str, float]) -> dict[str, str]:
    """within or exceeded by measure; unmeasured ones are unknown."""
    out = {}
    for name, limit in budgets.items():
        if name not in BUDGETS:
            raise ValueError(f"no such budget: {name}")
        v = measured.get(name)
        out[name] = "unknown" if v is None else "within" if (v <= limit if BUDGETS[name] == "max" else v >= limit) else "exceeded"
    return out
