"""Job configurations: YAML, TOML, HOCON or JSON text to a JobSpec."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from changeflow.functions.scalars import flatten_config
from changeflow.plans import hocon


class ConfigError(ValueError):
    pass


def parse(text: str, kind: str = "yaml") -> dict:
    kind = kind.lower().lstrip(".")
    if kind in ("yaml", "yml"):
        import yaml

        got = yaml.safe_load(text)
    elif kind == "toml":
        got = tomllib.loads(text)
    elif kind == "json":
        got = json.loads(text)
    elif kind in ("conf", "hocon"):
        got = hocon.loads(text)
    else:
        raise ConfigError(f"unknown configuration format {kind!r}")
    if not isinstance(got, dict):
        raise ConfigError("a job is a mapping")
    return got


@dataclass(frozen=True)
class Plugin:
    name: str
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def flat(self) -> dict[str, str]:
        return flatten_config(self.options)

    @property
    def key(self) -> str:
        return self.name.lower().replace("-", "").replace("_", "")


@dataclass(frozen=True)
class Pipeline:
    name: str
    source: Plugin
    sinks: tuple[Plugin, ...]
    transforms: tuple[Plugin, ...] = ()
    parallelism: int = 1
    on_sink_failure: str = "fail"


@dataclass(frozen=True)
class JobSpec:
    name: str
    pipelines: tuple[Pipeline, ...]
    job_id: str | None = None
    checkpoint_interval_ms: int | None = None
    warnings: tuple[str, ...] = ()


#: Options that are taken but do nothing.
IGNORED = ("exactly_once", "exactly-once", "format", "debezium", "chunk-key.even-distribution.factor.lower-bound", "chunk-key.even-distribution.factor.upper-bound", "sample-sharding.threshold", "inverse-sampling.rate", "incremental.parallelism", "connect.timeout.ms", "connect.max-retries")


def plugins(block: Any, what: str) -> tuple[Plugin, ...]:
    """`{Name: {...}}`, `{plugin_name: Name, ...}` or lists of them; mappings go by name."""
    if block is None:
        return ()
    if isinstance(block, list):
        return tuple(p for b in block for p in plugins(b, what))
    if not isinstance(block, dict):
        raise ConfigError(f"{what} must be a mapping or a list")
    name = block.get("plugin_name") or block.get("plugin-name")
    if name:
        return (Plugin(name, {k: v for k, v in block.items() if k not in ("plugin_name", "plugin-name")}),)
    for k, v in block.items():
        if not isinstance(v, (dict, list, type(None))):
            raise ConfigError(f"{what}: {k} has no block of options")
    return tuple(Plugin(k, o or {}) for k in sorted(block) for o in (block[k] if isinstance(block[k], list) else [block[k]]))


def _env(env: dict, *names: str, default: Any = None) -> Any:
    flat = flatten_config(env)
    return next((flat[n] for n in names if n in flat), default)


def job(config: dict) -> JobSpec:
    env = config.get("env") or {}
    shared = plugins(config.get("transform") or config.get("transforms"), "transform")
    failure = str(_env(env, "on-sink-failure", "on_sink_failure", default="fail"))
    parallelism = int(_env(env, "parallelism", "parallelism.default", default=1))
    blocks = config.get("pipelines") or [config]
    made, warnings = [], []
    for i, b in enumerate(blocks):
        sources = plugins(b.get("source"), "source")
        sinks = plugins(b.get("sinks") or b.get("sink"), "sink")
        if len(sources) != 1:
            raise ConfigError(f"pipeline {i} needs one source, has {len(sources)}")
        if not sinks:
            raise ConfigError(f"pipeline {i} has no sink")
        own = shared if b is config else (*shared, *plugins(b.get("transform") or b.get("transforms"), "transform"))
        on_failure = str(b.get("on-sink-failure") or b.get("on_sink_failure") or failure)
        if on_failure not in ("fail", "isolate"):
            raise ConfigError(f"unknown on-sink-failure {on_failure!r}")
        if "cdc" in sources[0].key:
            warnings += [f"{sources[0].name}: option {k} has no effect" for k in IGNORED if k in sources[0].flat]
        made.append(Pipeline(str(b.get("name") or f"pipeline-{i}") if b is not config else "pipeline-0", sources[0], sinks, own, int(b.get("parallelism") or parallelism) if b is not config else parallelism, on_failure))
    interval = _env(env, "checkpoint.interval", "checkpoint_interval")
    return JobSpec(str(_env(env, "job.name", default="job")), tuple(made), _env(env, "job.id"), int(interval) if interval else None, tuple(warnings))


def load(path: str) -> JobSpec:
    p = Path(path)
    return job(parse(p.read_text(), p.suffix or ".yaml"))


@dataclass(frozen=True)
class Rules:
    """Which options must or may be there."""

    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    exclusive: tuple[tuple[str, ...], ...] = ()
    bundled: tuple[tuple[str, ...], ...] = ()
    conditional: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    def errors(self, options: dict[str, Any]) -> list[str]:
        """exclusive: exactly one of each; bundled: all or none; conditional: (option, value, what it requires)."""
        there = {k for k, v in options.items() if v is not None and v != ""}
        out = [f"missing option {r}" for r in self.required if r not in there]
        out += [f"exactly one of {', '.join(g)}" for g in self.exclusive if len(there.intersection(g)) != 1]
        out += [f"all or none of {', '.join(g)}" for g in self.bundled if 0 < len(there.intersection(g)) < len(g)]
        for name, value, needs in self.conditional:
            if str(options.get(name)) == value:
                out += [f"missing option {n}, as {name} is {value}" for n in needs if n not in there]
        return out
