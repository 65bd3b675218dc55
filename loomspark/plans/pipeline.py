"""From a configuration to plans: records, quarantine, traces and anomalies of one run, and their writing."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.errors import ConfigurationError, RepositoryError
from loomspark.functions.parsing import parse
from loomspark.functions.templates import classify
from loomspark.operators import sessionize, validate
from loomspark.operators.detect import default_detectors
from loomspark.operators.events import AnomaliesPublished, EventBus, TracesClosed, with_retry, with_timing
from loomspark.operators.metrics import RunResult, default_registry
from loomspark.operators.store import JdbcStore, LogStore, union_anomalies
from loomspark.plans.config import PipelineConfig
from loomspark.schema import to_records
from loomspark.sources import text

ORDER = text.ORDER
log = logging.getLogger(__name__)


@dataclass
class Plan:
    """The tables of a run, not computed yet."""

    run_id: str
    records: DataFrame
    rejected: DataFrame
    traces: DataFrame | None
    anomalies: DataFrame | None
    stages: tuple[str, ...]
    typed: DataFrame
    kept: DataFrame | None = None


def source_lines(spark: SparkSession, config: PipelineConfig, lines=None) -> DataFrame:
    source = config.source
    if source.throttle_rps:
        raise ConfigurationError("source.throttle_rps paces a replay, which a batch isn't: use streaming.traces.replay")
    if source.kind == "file":
        return text.lines(spark, source.path, encoding=source.encoding)
    if source.kind == "stdin":
        return text.from_stdin(spark, lines)
    if lines is None:
        raise ConfigurationError("an iterable source needs lines")
    return lines if isinstance(lines, DataFrame) else text.from_iterable(spark, lines)


def build(spark: SparkSession, config: PipelineConfig, lines=None, run_id: str | None = None, series_by=(), metric=None, keep: bool = False) -> Plan:
    """The plan of a run: lines, parse, validate, classify; then records, traces and anomalies of the same rows.

    metric: a Column that numeric detectors read under their metric_key, or a dict of such by metric_key; without one,
    a detector reads the column of that name, if its source_dict has it. keep: rows are parsed, checked and classified
    once, kept (Plan.kept), and all outputs come from them.
    """
    run_id = run_id or str(uuid.uuid4())
    parsed = parse(source_lines(spark, config, lines), config.parser.kind)
    stages = [f"parse:{config.parser.kind}"]
    rows = parsed.withColumn("reject_reason", F.col("parse_error"))
    if config.validation:
        checks = [validate.build(v.kind, **v.options) for v in config.validation]
        rows = validate.chain(rows, checks, ORDER, known=F.col("parse_error"))
        stages.append(validate.chain_name(checks))
    if config.template_matcher.enabled:
        rows = classify(rows, text.templates(spark, config.template_matcher.templates_path))
        stages.append("template_matcher")
    if keep:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    good = rows.where("reject_reason is null").drop("reject_reason")
    rejected = rows.where("reject_reason is not null").select("id", "raw", F.col("reject_reason").alias("reason"))
    numeric, sequence = default_detectors()
    anomalies, traces = [], None
    if config.sessionizer.enabled:
        s = config.sessionizer
        traces = sessionize.traces(good, ORDER, s.max_records_per_trace, s.idle_window_s, run_id=run_id, max_open_traces=s.max_open_traces)
        stages.append("sessionizer")
    for d in config.detectors:
        try:
            detector = numeric.create(d.kind, **d.options)
        except (TypeError, ValueError) as e:
            raise ConfigurationError(f"detector {d.kind}: {e}") from e
        own = metric.get(detector.metric) if isinstance(metric, dict) else metric
        anomalies.append(detector.anomalies(good if own is None else good.withColumn(detector.metric, own.cast("double")), ORDER, series_by))
        stages.append(d.kind)
    if config.sequence_detector is not None:
        if traces is None:
            raise ConfigurationError("a sequence detector needs the sessionizer")
        s = config.sequence_detector
        anomalies.append(sequence.create(s.kind, model_path=s.model_path, threshold=s.threshold).anomalies(traces))
    return Plan(run_id, to_records(good, run_id, tuple(stages)), rejected, traces, union_anomalies(*anomalies) if anomalies else None, tuple(stages), good, rows if keep else None)


def repository(spark: SparkSession, config: PipelineConfig) -> LogStore:
    r = config.repository
    return JdbcStore(spark, r.dsn) if r.kind == "postgres" else LogStore(spark, r.path if r.kind == "parquet" else None)


def run(spark: SparkSession, config: PipelineConfig, lines=None, bus: EventBus | None = None, store: LogStore | None = None) -> tuple[RunResult, LogStore]:
    """Builds and runs: saves records, traces and anomalies, publishes the latter two, and counts.

    Lines are read, parsed and checked once, and traces and anomalies are computed once: what several outputs share is
    kept while they are written. Saving is timed, and tried again after a TransientStageError; records whose saving
    fails count as failed, and the run goes on.
    """
    started, bus = datetime.now(UTC), bus or EventBus()
    plan = build(spark, config, lines, keep=True)
    store = store or repository(spark, config)
    counts = {r["failed"]: r["count"] for r in plan.kept.groupBy(F.col("reject_reason").isNotNull().alias("failed")).count().collect()}
    processed, failed = counts.get(False, 0), counts.get(True, 0)
    saved = lambda action, name: with_timing(with_retry(action), f"save.{name}")
    try:
        saved(store.save_batch, "log_records")(plan.records)
    except RepositoryError:
        log.exception("saving %s records failed", processed)
        processed, failed = 0, failed + processed
    totals = {}
    for name, df, save, event, by in (
        ("traces", plan.traces, store.save_traces, TracesClosed, "closed_reason"), ("anomalies", plan.anomalies, store.save_anomalies, AnomaliesPublished, "detector_name"),
    ):
        totals[name] = {}
        if df is not None:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            totals[name] = {r[by]: r["count"] for r in df.groupBy(by).count().collect()}
            saved(save, name)(df)
            bus.publish(event(df))
            if store.path:
                df.unpersist()
    if store.path:
        plan.kept.unpersist()
    n_traces, n_anomalies = (sum(totals[name].values()) for name in ("traces", "anomalies"))
    for name, n in (("records.processed", processed), ("records.failed", failed), ("traces.closed", n_traces), ("anomalies.detected", n_anomalies)):
        default_registry.inc(name, n)
    for name, prefix in (("traces", "traces.closed"), ("anomalies", "anomalies")):
        for key, n in totals[name].items():
            default_registry.inc(f"{prefix}.{key}", n)
    return RunResult(plan.run_id, started, datetime.now(UTC), processed, failed, n_anomalies, n_traces), store
