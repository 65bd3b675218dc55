"""Training and evaluation over labelled logs: the sequence model by block, point detectors over bins of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.parsing import parse
from loomspark.functions.templates import classify
from loomspark.operators import evaluate, ngram, sessionize
from loomspark.operators.detect import Cusum, Iqr, ZScore
from loomspark.sources import text

ORDER = text.ORDER


def _good(spark: SparkSession, path: str, kind: str, max_lines: int | None) -> DataFrame:
    lines = text.lines(spark, path)
    return parse(lines if max_lines is None else text.cap(lines, max_lines), kind).where("parse_error is null")


def block_events(spark: SparkSession, log: str, templates: str, max_lines: int | None = None, kind: str = "hdfs") -> DataFrame:
    """Whole blocks with their events in order: block_id, event_sequence. Lines without block or template don't count."""
    rows = classify(_good(spark, log, kind, max_lines), text.templates(spark, templates)).where("event_id is not null")
    return sessionize.traces(rows, ORDER, None, janitor="none", keep_records=False)


def training_counts(spark: SparkSession, log: str, templates: str, labels: str, max_lines: int | None = None, kind: str = "hdfs") -> dict[str, int]:
    """What a training run reads and leaves out: lines parsed, matched and skipped, blocks, normal and unlabelled ones."""
    lines = text.lines(spark, log)
    rows = classify(parse(lines if max_lines is None else text.cap(lines, max_lines), kind), text.templates(spark, templates))
    good = F.col("parse_error").isNull()
    use = good & F.col("event_id").isNotNull() & (F.coalesce("block_id", F.lit("")) != "")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = rows.agg(n(good).alias("parsed"), n(use).alias("matched"), n(good & ~use).alias("skipped")).first().asDict()
    blocks = rows.where(use).select("block_id").distinct().join(text.labels(spark, labels).withColumnRenamed("BlockId", "block_id"), "block_id", "left")
    return out | blocks.agg(F.count(F.lit(1)).alias("blocks"), n(F.col("Label") == "Normal").alias("normal"), n(F.col("Label").isNull()).alias("unlabelled")).first().asDict()


def train_sequence(spark: SparkSession, log: str, templates: str, labels: str, n: int = 2, out: str | None = None, max_lines: int | None = None, kind: str = "hdfs") -> ngram.SequenceModel:
    """A model of the n-grams of blocks that are labelled Normal, saved as JSON if out is given."""
    model = ngram.train(block_events(spark, log, templates, max_lines, kind), text.labels(spark, labels), n)
    if out:
        model.save(out)
    return model


def evaluate_sequence(spark: SparkSession, log: str, templates: str, labels: str, model: ngram.SequenceModel, threshold: float = 0.0, out: str | None = None, max_lines: int | None = None, kind: str = "hdfs") -> dict:
    """The confusion matrix of the model over the blocks that have a label."""
    traces = ngram.labelled(block_events(spark, log, templates, max_lines, kind), text.labels(spark, labels))
    row = evaluate.confusion(ngram.score(traces, model, threshold), "fired", F.col("label") == "Anomaly").first().asDict()
    result = {"n": model.n, "threshold": threshold, "blocks": sum(row[c] for c in ("tp", "fp", "fn", "tn")), **row}
    if out:
        evaluate.save(result, out)
    return result


def evaluate_points(spark: SparkSession, log: str, window_seconds: int = 60, max_lines: int | None = None, out: str | None = None, detectors=None) -> dict:
    """Confusion matrices of point detectors over counts by bin, where a bin is an anomaly if it holds an alert line."""
    bins = evaluate.rates(_good(spark, log, "bgl", max_lines), window_seconds, evaluate.bgl_alert())
    bins = bins.select(F.col("bin").alias("timestamp"), F.col("n").cast("double").alias("metric"), "alert").persist()
    try:
        detectors = detectors or (ZScore(threshold=3.0, window_size=200, min_samples=50), Iqr(k=3.0, window_size=200, min_samples=50), Cusum(threshold=5.0, slack=0.5, warmup_samples=50))
        results = {d.name: evaluate.confusion(d.score(bins, ["timestamp"]), "fired", "alert").first().asDict() for d in detectors}
        result = {"window_seconds": window_seconds, "windows": bins.count(), "results": results}
    finally:
        bins.unpersist()
    if out:
        evaluate.save(result, out)
    return result


def table(results: dict[str, dict]) -> str:
    """Results by detector as a Markdown table."""
    return evaluate.markdown([{"detector": k, **v} for k, v in results.items()])
