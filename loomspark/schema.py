"""Record, trace and anomaly schemas, and the projection of typed columns to the open maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Typed columns that stand for known keys of the open maps.
RAW_PAYLOAD = ("raw", "pid", "level_raw", "line_id", "type", "node_repeat")
ENRICHMENT = ("block_id", "event_id", "parse_warning", "bgl_label", "node")

LOG_RECORDS = "id string, pipeline_run_id string, timestamp timestamp, source string, severity string, message string, raw_payload map<string,string>, enrichment map<string,string>, stage_history array<string>"
BLOCK_TRACES = "block_id string, event_sequence array<string>, record_ids array<string>, first_timestamp timestamp, last_timestamp timestamp, record_count int, pipeline_run_id string, closed_reason string"
ANOMALY_EVENTS = "id string, log_record_id string, detector_name string, severity_score double, detected_at timestamp, metadata map<string,string>"

SEVERITIES = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
CLOSED_REASONS = ("terminal", "timeout", "shutdown", "evicted")


def record_id(*parts: Column) -> Column:
    """A stable id of a record from where it is from, so that a recomputed row keeps its id."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def _map(names, columns) -> Column:
    """A map of the columns that are there and not null."""
    entries = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names if n in columns]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def to_records(df: DataFrame, run_id: str | None = None, stages: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns as LOG_RECORDS; anomaly tags (anomaly_<detector>) become enrichment keys "anomaly:<detector>"."""
    tags = [c for c in df.columns if c.startswith("anomaly_")]
    enrichment = _map([*ENRICHMENT, *(["metric"] if "metric" in df.columns else [])], df.columns)
    for tag in tags:
        entry = F.map_from_entries(F.filter(F.array(F.struct(F.lit("anomaly:" + tag.removeprefix("anomaly_")).alias("key"), F.col(tag).cast("string").alias("value"))), lambda e: e["value"].isNotNull()))
        enrichment = F.map_concat(enrichment, entry)
    return df.select(
        "id", F.lit(run_id).cast("string").alias("pipeline_run_id"), "timestamp", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("severity", F.lit("INFO")).alias("severity"), F.coalesce("message", F.lit("")).alias("message"),
        _map(RAW_PAYLOAD, df.columns).alias("raw_payload"), enrichment.alias("enrichment"), F.array(*map(F.lit, stages)).cast("array<string>").alias("stage_history"),
    )
