"""Configuration: defaults, file, environment and flags, merged key by key and validated once."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field

from timberline.operators import enrich, mining

DEFAULTS: dict = {"default_timezone": None, "state_dir": "./state", "streams": [], "redaction": [], "budgets": {}, "retention_days": None, "mining": {"depth": 4, "threshold": 0.5, "most_templates": 10_000, "stable_at": 5}}
PREFIX = "TIMBERLINE_"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Stream:
    id: str
    source_type: str = "file"
    mode: str = "batch"
    path: str | None = None
    timezone: str | None = None
    floor: str = "warn"
    format: str | None = None
    time_formats: list = field(default_factory=list)
    mining: dict = field(default_factory=dict)


def merge(*layers: dict) -> dict:
    """Later layers win, key by key; nested tables merge."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_env(env: dict[str, str] | None = None) -> dict:
    """TIMBERLINE_MINING__DEPTH=5 is mining.depth; numbers are read as such."""
    out: dict = {}
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(PREFIX):
            at = out
            *head, last = k[len(PREFIX) :].lower().split("__")
            for part in head:
                at = at.setdefault(part, {})
            at[last] = int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d+\.\d+", v) else v
    return out


def load(path: str | None = None, *, env: dict[str, str] | None = None, flags: dict | None = None) -> dict:
    layer = {}
    if path:
        with open(path, "rb") as f:
            layer = tomllib.load(f)
    out = merge(DEFAULTS, layer, from_env(env), flags or {})
    validate(out)
    return out


def validate(config: dict) -> None:
    """All faults at once: unknown keys, ids twice, wrong modes, patterns, numbers, and secrets written out."""
    wrong = [f"unknown key {k}" for k in config if k not in DEFAULTS]
    seen = set()
    for s in config["streams"]:
        if not s.get("id") or s["id"] in seen:
            wrong.append(f"stream id {s.get('id')!r} is missing or there twice")
        seen.add(s.get("id"))
        if s.get("source_type", "file") not in ("file", "stdin", "docker", "journald"):
            wrong.append(f"{s.get('id')}: source_type {s['source_type']!r}")
        if s.get("mode", "batch") not in ("batch", "tail", "hybrid"):
            wrong.append(f"{s.get('id')}: mode {s['mode']!r}")
        if s.get("floor", "warn") not in enrich.LEVELS:
            wrong.append(f"{s.get('id')}: floor {s['floor']!r}")
        wrong += [f"{s.get('id')}: time format {name!r}" for name in s.get("time_formats", []) if name not in enrich.FORMATS]
    for r in config["redaction"]:
        try:
            re.compile(r["pattern"])
        except (re.error, KeyError) as e:
            wrong.append(f"redaction {r.get('class')!r}: {e}")
    m = config["mining"]
    if not (isinstance(m["depth"], int) and 1 <= m["depth"] <= 255) or not 0 < m["threshold"] <= 1 or m["most_templates"] < 1 or m["stable_at"] < 1:
        wrong.append(f"mining {m}")

    def secrets(at, name: str) -> None:
        for k, v in at.items() if isinstance(at, dict) else enumerate(at) if isinstance(at, list) else ():
            if isinstance(v, dict | list):
                secrets(v, f"{name}{k}.")
            elif re.search(r"(?i)password|secret|token|api_?key", str(k)) and not str(k).endswith("_env"):
                wrong.append(f"{name}{k}: secrets come by environment variable, named in {k}_env")

    secrets(config, "")
    if wrong:
        raise ConfigError("; ".join(wrong))


def streams(config: dict) -> list[Stream]:
    known = Stream.__dataclass_fields__
    return [Stream(**{k: v for k, v in s.items() if k in known}) for s in config["streams"]]


def mining_params(config: dict) -> mining.Params:
    """The mining parameters, with the depths of streams that name one, or a format that has one."""
    m = config["mining"]
    depths = {s.id: s.mining.get("depth") or mining.FORMAT_DEPTH.get(s.format) for s in streams(config)}
    return mining.Params(m["depth"], m["threshold"], m["most_templates"], m["stable_at"], {k: v for k, v in depths.items() if v})


def times_by_stream(config: dict) -> dict[str, list[str]]:
    return {s.id: s.time_formats for s in streams(config) if s.time_formats}
