"""Operational metrics: counters, gauges and timers, nearest-rank percentiles, run totals."""

from __future__ import annotations

import threading
from collections import defaultdict
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(samples: Column, p: float) -> Column:
    """The nearest-rank percentile of an array: the sorted sample at int(p * n), 0 if there is none."""
    n = F.size(samples)
    at = F.greatest(F.lit(1), F.least(n, F.floor(F.lit(p) * n).cast("int") + 1))
    return F.when(n > 0, F.try_element_at(F.array_sort(samples), at)).otherwise(F.lit(0.0))


def percentiles(df: DataFrame, value: str, by: list[str], ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """count, total and nearest-rank percentiles by group, exact, without an array of a group's samples.

    Equal values are counted first; a running count over them finds the ranks, so only distinct values are sorted.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    rank = lambda p: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n"))))
    return counts.groupBy(*by).agg(F.max("_n").alias("count"), F.sum(F.col(value) * F.col("_c")).alias("total"), *(F.min(F.when(F.col("_upto") > rank(p), F.col(value))).alias(f"p{round(p * 100)}") for p in ps))


def quantiles(df: DataFrame, value: str, ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """Interpolated quantiles, for latencies."""
    return df.agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps))


class MetricsRegistry:
    """Counters, gauges and timers of the driver process."""

    def __init__(self):
        self._lock = threading.Lock()
        self.reset()

    def reset(self) -> None:
        self._counters, self._gauges, self._timers = defaultdict(int), {}, defaultdict(list)

    def inc(self, name: str, by: int = 1) -> None:
        with self._lock:
            self._counters[name] += by

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self._gauges[name] = value

    def timing(self, name: str, seconds: float) -> None:
        with self._lock:
            self._timers[name].append(seconds)

    def snapshot(self) -> dict:
        def rank(samples: list[float], p: float) -> float:
            ordered = sorted(samples)
            return ordered[max(0, min(len(ordered) - 1, int(p * len(ordered))))] if ordered else 0.0

        with self._lock:
            timers = {k: {"count": float(len(v)), "total_s": sum(v), **{f"p{round(p * 100)}_s": rank(v, p) for p in (0.5, 0.95, 0.99)}} for k, v in self._timers.items()}
            return {"counters": dict(self._counters), "gauges": dict(self._gauges), "timers": timers}


default_registry = MetricsRegistry()


@dataclass(frozen=True)
class RunResult:
    """What a run did."""

    run_id: str
    started_at: datetime
    completed_at: datetime
    records_processed: int
    records_failed: int
    anomalies_detected: int = 0
    traces_closed: int = 0


def totals(parsed: DataFrame, reason: str = "parse_error") -> DataFrame:
    """lines, processed and failed: processed + failed = lines."""
    failed = F.coalesce(F.sum(F.col(reason).isNotNull().cast("long")), F.lit(0))
    return parsed.agg(F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) - failed).alias("processed"), failed.alias("failed"))
