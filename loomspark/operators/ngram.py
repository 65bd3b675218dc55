"""N-gram novelty of traces: a model of what normal traces hold, and scores of how much of a trace it lacks."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def ngrams(events: Column, n: int) -> Column:
    """The n-grams of an array, in order; none if it is shorter than n or n isn't positive."""
    if n <= 0:
        return F.array().cast("array<array<string>>")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(events) - n + 1, F.lit(1))), lambda i: F.slice(events, i, n))
    return F.when(F.size(events) >= n, grams).otherwise(F.array().cast("array<array<string>>"))


@dataclass(frozen=True)
class SequenceModel:
    """What normal traces hold: n, distinct n-grams and the vocabulary. Small: it grows with event kinds, not with data."""

    n: int = 2
    normal_ngrams: frozenset[tuple[str, ...]] = field(default_factory=frozenset)
    vocabulary: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def from_dict(cls, data) -> SequenceModel:
        try:
            n, grams, words = data["n"], data["normal_ngrams"], data["vocabulary"]
        except (KeyError, TypeError) as e:
            raise ValueError(f"malformed model: {e}") from e
        if not isinstance(n, int) or isinstance(n, bool) or not isinstance(grams, list) or not isinstance(words, list):
            raise ValueError("malformed model: n must be a number, normal_ngrams and vocabulary lists")
        return cls(n, frozenset(tuple(map(str, g)) for g in grams), frozenset(map(str, words)))

    @classmethod
    def load(cls, path: str) -> SequenceModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @classmethod
    def load_or_empty(cls, path: str | None) -> SequenceModel:
        """An empty model, with a warning, where the file is missing: then every trace of n events or more is new."""
        if path and os.path.exists(path):
            return cls.load(path)
        log.warning("no sequence model at %s: the model is empty", path)
        return cls()

    def to_dict(self) -> dict:
        return {"n": self.n, "normal_ngrams": [list(g) for g in sorted(self.normal_ngrams)], "vocabulary": sorted(self.vocabulary)}

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(list(g),) for g in sorted(self.normal_ngrams)], "gram array<string>")


def labelled(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Traces that have a label, with it; the small side is left to the optimizer."""
    return traces.join(labels.select(F.col("BlockId").alias("block_id"), F.col("Label").alias("label")), "block_id")


def normal_ngrams(traces: DataFrame, n: int = 2, normal: str = "Normal") -> DataFrame:
    """The distinct n-grams of normal traces (event_sequence, label); each task hands on a gram once."""
    return traces.where(F.col("label") == normal).select(F.explode(F.array_distinct(ngrams(F.col("event_sequence"), n))).alias("gram")).distinct()


def vocabulary(traces: DataFrame) -> DataFrame:
    """The distinct events of labelled traces of either class."""
    return traces.select(F.explode(F.array_distinct("event_sequence")).alias("event")).distinct()


def train(traces: DataFrame, labels: DataFrame, n: int = 2, normal: str = "Normal") -> SequenceModel:
    """A model from the traces that have a label; it counts a gram of a normal trace even if others hold it too."""
    if n < 1:
        raise ValueError("n must be >= 1")
    own = labelled(traces, labels).select("event_sequence", "label").persist()
    try:
        grams = frozenset(tuple(r["gram"]) for r in normal_ngrams(own, n, normal).collect())
        words = frozenset(r["event"] for r in vocabulary(own).collect())
    finally:
        own.unpersist()
    return SequenceModel(n, grams, words)


def score(traces: DataFrame, model: SequenceModel | DataFrame, threshold: float = 0.0, n: int | None = None) -> DataFrame:
    """traces with observed_count, novel_count, ratio, novel_ngrams (sorted, the first 20) and fired.

    A trace fires if the share of its distinct n-grams that the model lacks is above the threshold. A trained model is
    a literal in the plan; a DataFrame of grams (gram) is one broadcast row.
    """
    if threshold < 0:
        raise ValueError("threshold must be >= 0")
    if isinstance(model, SequenceModel):
        n = model.n
        known = F.array(*(F.array(*map(F.lit, g)) for g in sorted(model.normal_ngrams))).cast("array<array<string>>") if model.normal_ngrams else F.array().cast("array<array<string>>")
        out = traces
    else:
        n = n or 2
        out = traces.crossJoin(F.broadcast(model.agg(F.collect_set("gram").alias("_known"))))  # one row
        known = F.col("_known")
    out = out.withColumn("_seen", F.array_distinct(ngrams(F.col("event_sequence"), n)))
    out = out.withColumn("_new", F.array_except("_seen", known))
    out = out.withColumns({"observed_count": F.size("_seen"), "novel_count": F.size("_new")})
    out = out.withColumn("ratio", F.when(F.col("observed_count") > 0, F.col("novel_count") / F.col("observed_count")))
    out = out.withColumn("novel_ngrams", F.slice(F.array_sort("_new"), 1, 20)).withColumn("fired", F.coalesce(F.col("ratio") > threshold, F.lit(False)))
    return out.drop("_seen", "_new", "_known")


class SequenceDetector:
    """Scores closed traces by a model; an anomaly is anchored at a trace's first record."""

    name = "sequence_ngram"

    def __init__(self, model_path: str | None = None, threshold: float = 0.0, model: SequenceModel | None = None):
        if threshold < 0:
            raise ValueError("threshold must be >= 0")
        self.model, self.threshold = model or SequenceModel.load_or_empty(model_path), threshold

    def anomalies(self, traces: DataFrame, detected_at: Column | None = None) -> DataFrame:
        out = score(traces, self.model, self.threshold).where("fired")
        anchor = F.coalesce(F.get("record_ids", F.lit(0)), F.sha2(F.concat_ws("|", "block_id", F.col("first_timestamp").cast("string")), 256))
        meta = {
            "block_id": F.col("block_id"), "n": F.lit(self.model.n), "novel_ngrams": F.to_json("novel_ngrams"), "observed_count": F.col("observed_count"),
            "novel_count": F.col("novel_count"), "event_sequence_length": F.size("event_sequence"), "closed_reason": F.col("closed_reason"),
        }
        entries = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in meta.items())))
        return out.select(F.sha2(F.concat_ws("|", F.lit(self.name), anchor), 256).alias("id"), anchor.alias("log_record_id"), F.lit(self.name).alias("detector_name"), F.col("ratio").alias("severity_score"), (detected_at if detected_at is not None else F.col("last_timestamp")).alias("detected_at"), entries.alias("metadata"))


def score_by_join(sequences: DataFrame, grams: DataFrame, key: str, n: int = 2) -> DataFrame:
    """key, observed_count, novel_count of sequences (key, event_sequence) against any number of grams (gram).

    For models too large for a literal: distinct grams of each sequence meet the model in a join, which Spark
    broadcasts or shuffles by size; nothing else than counts is grouped.
    """
    seen = sequences.select(key, F.explode(F.array_distinct(ngrams(F.col("event_sequence"), n))).alias("gram"))
    met = seen.join(grams.select("gram").distinct().withColumn("_known", F.lit(True)), "gram", "left")
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("observed_count"), F.sum(F.col("_known").isNull().cast("long")).alias("novel_count"))
