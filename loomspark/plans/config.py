"""Keys and defaults of the configuration files.

Configurations: closed dataclasses, but for validators and detectors, which take options of their own; YAML files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any

from loomspark.errors import ConfigurationError


@dataclass
class SourceConfig:
    kind: str = "file"
    path: str | None = None
    encoding: str = "utf-8"
    throttle_rps: float | None = None


@dataclass
class ParserConfig:
    kind: str = "hdfs"


@dataclass
class OpenConfig:
    """A kind and options."""

    kind: str = ""
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class SequenceDetectorConfig:
    kind: str = "sequence_ngram"
    model_path: str | None = None
    threshold: float = 0.0


@dataclass
class SessionizerConfig:
    enabled: bool = False
    idle_window_s: float = 30.0
    max_records_per_trace: int = 1000
    max_open_traces: int = 50_000
    flush_interval_s: float = 5.0


@dataclass
class TemplateMatcherConfig:
    enabled: bool = False
    templates_path: str = "data/HDFS/preprocessed/HDFS.log_templates.csv"


@dataclass
class RepositoryConfig:
    kind: str = "memory"
    dsn: str | None = None
    path: str | None = None


@dataclass
class RuntimeConfig:
    """num_workers bounds partitions of a local run; the other knobs are accepted and have no counterpart in Spark."""

    num_workers: int = 4
    queue_size: int = 1000
    batch_size: int = 100
    flush_interval_s: float = 1.0


@dataclass
class PipelineConfig:
    source: SourceConfig
    parser: ParserConfig = field(default_factory=ParserConfig)
    validation: list[OpenConfig] = field(default_factory=list)
    template_matcher: TemplateMatcherConfig = field(default_factory=TemplateMatcherConfig)
    sessionizer: SessionizerConfig = field(default_factory=SessionizerConfig)
    detectors: list[OpenConfig] = field(default_factory=list)
    sequence_detector: SequenceDetectorConfig | None = None
    repository: RepositoryConfig = field(default_factory=RepositoryConfig)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)


def _check(value, kind: str, where: str):
    """value as the type that an annotation names, or an error."""
    if value is None:
        if "None" in kind:
            return None
        raise ConfigurationError(f"{where} must not be null")
    kind = kind.replace(" | None", "")
    fits = {"str": isinstance(value, str), "bool": isinstance(value, bool), "int": isinstance(value, int) and not isinstance(value, bool), "float": isinstance(value, (int, float)) and not isinstance(value, bool)}
    if not fits.get(kind, True):
        raise ConfigurationError(f"{where} must be of type {kind}")
    return float(value) if kind == "float" else value


def _closed(cls, data, where: str):
    if not isinstance(data, dict):
        raise ConfigurationError(f"{where} must be a mapping")
    known = {f.name: str(f.type) for f in fields(cls)}
    if unknown := sorted(set(data) - set(known)):
        raise ConfigurationError(f"unknown keys in {where}: {unknown}")
    return cls(**{k: _check(v, known[k], f"{where}.{k}") for k, v in data.items()})


def _open(data, where: str, kinds=None, **defaults) -> OpenConfig:
    if not isinstance(data, dict) or not isinstance(data.get("kind"), str):
        raise ConfigurationError(f"{where} needs a kind")
    if kinds and data["kind"] not in kinds:
        raise ConfigurationError(f"unknown kind in {where}: {data['kind']!r}")
    return OpenConfig(data["kind"], {**defaults, **{k: v for k, v in data.items() if k != "kind"}})


def parse_config(data: dict[str, Any]) -> PipelineConfig:
    """A checked configuration, or a ConfigurationError that says what is wrong."""
    if not isinstance(data, dict):
        raise ConfigurationError("a configuration must be a mapping")
    parts = {"parser": ParserConfig, "template_matcher": TemplateMatcherConfig, "sessionizer": SessionizerConfig, "repository": RepositoryConfig, "runtime": RuntimeConfig}
    if unknown := sorted(set(data) - set(parts) - {"source", "validation", "detectors", "sequence_detector"}):
        raise ConfigurationError(f"unknown keys: {unknown}")
    if "source" not in data:
        raise ConfigurationError("source is required")
    out = PipelineConfig(_closed(SourceConfig, data["source"], "source"))
    for name, cls in parts.items():
        if name in data:
            setattr(out, name, _closed(cls, data[name], name))
    for name in ("validation", "detectors"):
        if not isinstance(data.get(name, []), list):
            raise ConfigurationError(f"{name} must be a list")
    out.validation = [_open(x, f"validation[{i}]", ("schema", "size", "rate_limit")) for i, x in enumerate(data.get("validation", []))]
    out.detectors = [_open(x, f"detectors[{i}]", None, metric_key="metric") for i, x in enumerate(data.get("detectors", []))]
    if data.get("sequence_detector") is not None:
        out.sequence_detector = _closed(SequenceDetectorConfig, data["sequence_detector"], "sequence_detector")
    for what, value, known in (("source.kind", out.source.kind, ("file", "stdin", "iterable")), ("repository.kind", out.repository.kind, ("memory", "parquet", "postgres"))):
        if value not in known:
            raise ConfigurationError(f"{what} must be one of {known}")
    if out.source.kind == "file" and not out.source.path:
        raise ConfigurationError("source.path is required when kind=file")
    if out.repository.kind == "postgres" and not out.repository.dsn:
        raise ConfigurationError("repository.dsn is required when kind=postgres")
    if out.repository.kind == "parquet" and not out.repository.path:
        raise ConfigurationError("repository.path is required when kind=parquet")
    run = out.runtime
    if not 1 <= run.num_workers <= 64 or run.queue_size < 1 or run.batch_size < 1 or run.flush_interval_s <= 0:
        raise ConfigurationError("runtime: num_workers must be 1 to 64, queue_size and batch_size 1 or more, flush_interval_s positive")
    return out


def load_config(path: str) -> PipelineConfig:
    import yaml

    if not os.path.exists(path):
        raise ConfigurationError(f"config file not found: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    except yaml.YAMLError as e:
        raise ConfigurationError(f"failed to parse YAML at {path}: {e}") from e
    return parse_config(data)
