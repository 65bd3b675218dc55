"""Subscribers to closed traces and anomalies, and wrappers of stages: retries, timing, logging."""

from __future__ import annotations

import logging
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame

from loomspark.errors import TransientStageError
from loomspark.operators.metrics import MetricsRegistry, default_registry

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class TracesClosed:
    traces: DataFrame


@dataclass(frozen=True)
class AnomaliesPublished:
    anomalies: DataFrame


class EventBus:
    """Calls what subscribes to an event's exact type; a subscriber that fails is logged and doesn't stop others."""

    def __init__(self):
        self._subscribers: dict[type, list[Callable]] = defaultdict(list)

    def subscribe(self, kind: type, listener: Callable) -> None:
        self._subscribers[kind].append(listener)

    def unsubscribe(self, kind: type, listener: Callable) -> None:
        if listener in self._subscribers[kind]:
            self._subscribers[kind].remove(listener)

    def publish(self, event) -> None:
        for listener in list(self._subscribers[type(event)]):
            try:
                listener(event)
            except Exception:
                log.exception("a listener of %s failed", type(event).__name__)


class ConsoleListener:
    """Prints the first rows of what is published."""

    def __init__(self, rows: int = 20):
        self.rows = rows

    def __call__(self, event) -> None:
        for df in vars(event).values():
            df.show(self.rows, truncate=False)


class CollectingListener:
    """Keeps the events, for tests."""

    def __init__(self):
        self.events = []

    def __call__(self, event) -> None:
        self.events.append(event)


class MetricsListener:
    """Counts events by type, traces by why they closed and anomalies by detector: one small aggregate for each event."""

    def __init__(self, registry: MetricsRegistry = default_registry):
        self.registry = registry

    def __call__(self, event) -> None:
        self.registry.inc(f"event.{type(event).__name__}")
        for df, by, name in ((getattr(event, "traces", None), "closed_reason", "traces.closed"), (getattr(event, "anomalies", None), "detector_name", "anomalies")):
            if df is not None and by in df.columns:
                for r in df.groupBy(by).count().collect():
                    self.registry.inc(f"{name}.{r[by]}", r["count"])


#: What the wrappers below wrap: a stage that builds a plan, or an action that runs one, such as LogStore.save_batch.
Stage = Callable[[DataFrame], DataFrame | None]


def with_retry(stage: Stage, max_retries: int = 3, base_delay_s: float = 0.05, max_delay_s: float = 1.0, backoff_factor: float = 2.0, sleep=time.sleep) -> Stage:
    """A stage that is tried again after a TransientStageError, after growing waits; other errors pass."""
    if max_retries < 0:
        raise ValueError("max_retries must be >= 0")
    if base_delay_s < 0:
        raise ValueError("base_delay_s must be >= 0")

    @wraps(stage)
    def tried(df: DataFrame) -> DataFrame:
        for attempt in range(max_retries + 1):
            try:
                return stage(df)
            except TransientStageError:
                if attempt == max_retries:
                    raise
                sleep(min(max_delay_s, base_delay_s * backoff_factor**attempt))

    return tried


def with_timing(stage: Stage, name: str, registry: MetricsRegistry = default_registry) -> Stage:
    """A stage whose time and number of calls are counted, also if it fails: of a plan its building, of an action its run."""

    @wraps(stage)
    def timed(df: DataFrame) -> DataFrame:
        start = time.perf_counter()
        try:
            return stage(df)
        finally:
            registry.timing(f"stage.{name}.duration_s", time.perf_counter() - start)
            registry.inc(f"stage.{name}.invocations")

    return timed


def with_logging(stage: Stage, name: str) -> Stage:
    """A stage that says when it begins, ends and fails."""

    @wraps(stage)
    def logged(df: DataFrame) -> DataFrame:
        log.debug("stage %s begins", name)
        try:
            out = stage(df)
        except Exception:
            log.warning("stage %s failed", name)
            raise
        log.debug("stage %s ends", name)
        return out

    return logged
