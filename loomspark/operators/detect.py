"""Numeric detectors over ordered series: rolling z-score, rolling IQR fence, two-sided CUSUM with reset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.registry import Registry
from loomspark.schema import ENRICHMENT, RAW_PAYLOAD

#: Where a detector looks for its metric.
BAGS = {"enrichment": ENRICHMENT, "raw_payload": RAW_PAYLOAD}


def numeric(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose metric is a number: others are skipped and are in no window. Booleans and strings aren't numbers."""
    kind = dict(df.dtypes)[metric]
    if kind in ("boolean", "string"):
        return df.where(F.lit(False)).withColumn(metric, F.lit(None).cast("double"))
    return df.where(F.col(metric).isNotNull()).withColumn(metric, F.col(metric).cast("double"))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _below(key: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds are below key, by bisection: there are as many bounds as runs, and an expression
    that names each overflows the planner's stack."""
    if not bounds:
        return F.lit(0)
    table, steps = F.lit(np.array(bounds)), F.lit(np.array([1 << i for i in reversed(range(len(bounds).bit_length()))], dtype="int32"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(key > F.get(table, at + step - 1), at + step).otherwise(at))


def chunked(df: DataFrame, order: Sequence[str], window: int, rows: int) -> DataFrame:
    """df cut into runs of about rows rows in order (_chunk), each led by the window rows before it (_halo).

    So frames of the last window rows of one long series are whole within a run, and runs are separate tasks. Bounds
    are quantiles of the first order column, which must be a time or a number without nulls; rows that share its value
    stay in one run. The driver sees a bound and a count for each run.
    """
    first = F.col(order[0])
    key = F.unix_micros(first.cast("timestamp")) if dict(df.dtypes)[order[0]].startswith("timestamp") else first.cast("double")
    n = df.count()
    runs = max(1, n // max(1, rows))
    shares = [i / runs for i in range(1, runs)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, F.lit(np.array(shares)), F.lit(10_000))).first()[0] or [])) if shares and n else []
    df = df.withColumn("_chunk", _below(key, bounds)).withColumn("_halo", F.lit(False))
    if not bounds:
        return df
    counts = {r["_chunk"]: r["c"] for r in df.groupBy("_chunk").agg(F.count(F.lit(1)).alias("c")).collect()}
    # the runs that a run's last rows lead, and how many rows of others stand between
    leads = []
    for i in range(len(bounds) + 1):
        between = 0
        for j in range(i + 1, len(bounds) + 1):
            if between >= window:
                break
            leads.append((i, j, between))
            between += counts.get(j, 0)
    back = Window.partitionBy("_chunk").orderBy(*(F.desc(c) for c in order))
    tail = df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= window)
    led = df.sparkSession.createDataFrame(leads, "_chunk int, _to int, _between long")
    halo = tail.join(F.broadcast(led), "_chunk").where(F.col("_back") + F.col("_between") <= window)
    return df.unionByName(halo.withColumn("_chunk", F.col("_to")).withColumn("_halo", F.lit(True)).select(*df.columns))


def quantile(values: Column, p: float) -> Column:
    """The interpolated p-quantile of a sorted array of doubles, null without any: low * (1 - d) + high * d as a fused
    multiply-add, which rounds the first product and the sum once, as the SQL's quantile_cont does. A value on a fence
    is inside or outside by that bit, and Spark's percentile rounds twice."""
    place = (F.size(values) - 1) * F.lit(p)
    at = F.floor(place).cast("int")
    low, high, d = F.get(values, at), F.get(values, at + 1), place - at
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - d, high * d).cast("double")
    return F.when(d == 0, low).when(low.isNotNull(), fused)


class _Detector:
    """score() adds columns to every numeric row; fired() keeps those that are anomalies."""

    name = ""
    chunk_rows: int | None = None
    bag = "enrichment"

    def _from(self, source_dict: str) -> None:
        if source_dict not in BAGS:
            raise ValueError("source_dict must be 'enrichment' or 'raw_payload'")
        self.bag = source_dict

    def numbers(self, df: DataFrame) -> DataFrame:
        """df with the metric as the detector's bag has it: a column that isn't one of the other bag's, or else the
        bag's entry, where df holds the bag as a map of text. Without either the metric is null."""
        others = {c for k, names in BAGS.items() if k != self.bag for c in names}
        if self.metric in df.columns and self.metric not in others:
            return df
        held = self.bag in df.columns and dict(df.dtypes)[self.bag].startswith("map")
        value = F.expr(f"try_cast({self.bag}[{_sql(self.metric)}] as double)") if held else F.lit(None).cast("double")
        return df.withColumn(self.metric, value)

    def _windowed(self, df: DataFrame, order: Sequence[str], series_by: Sequence[str], size: int):
        """Numeric rows, and the window of at most size rows before a row."""
        df = numeric(self.numbers(df), self.metric)
        by = list(series_by)
        if self.chunk_rows and not by:
            df, by = chunked(df, order, size, self.chunk_rows), ["_chunk"]
        return df, Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(-size, -1)

    @staticmethod
    def _own(df: DataFrame) -> DataFrame:
        return df.where(~F.col("_halo")).drop("_chunk", "_halo") if "_halo" in df.columns else df

    def score(self, df: DataFrame, order: Sequence[str], series_by: Sequence[str] = ()) -> DataFrame:
        raise NotImplementedError

    def metadata(self) -> dict[str, Column]:
        raise NotImplementedError

    def fired(self, df: DataFrame, order: Sequence[str], series_by: Sequence[str] = ()) -> DataFrame:
        return self.score(df, order, series_by).where("fired")

    def anomalies(self, df: DataFrame, order: Sequence[str], series_by: Sequence[str] = (), detected_at: Column | None = None) -> DataFrame:
        """Anomaly events; detected_at is the row's time unless given."""
        at = detected_at if detected_at is not None else F.col("timestamp")
        meta = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in self.metadata().items())))
        out = self.fired(df, order, series_by)
        return out.select(F.sha2(F.concat_ws("|", F.lit(self.name), F.col("id")), 256).alias("id"), F.col("id").alias("log_record_id"), F.lit(self.name).alias("detector_name"), F.col("score").alias("severity_score"), at.alias("detected_at"), meta.alias("metadata"))


class ZScore(_Detector):
    """How many deviations a value is from the mean of the values before it, at most window_size of them.

    Nothing is scored before min_samples, nor after a constant window.
    """

    name = "z_score"

    def __init__(self, metric_key: str = "metric", threshold: float = 3.0, window_size: int = 100, min_samples: int = 30, chunk_rows: int | None = None, source_dict: str = "enrichment"):
        self._from(source_dict)
        if window_size <= 1:
            raise ValueError("window_size must be > 1")
        if threshold <= 0:
            raise ValueError("threshold must be > 0")
        if min_samples < 2:
            raise ValueError("min_samples must be >= 2")
        self.metric, self.threshold, self.window, self.least, self.chunk_rows = metric_key, threshold, window_size, min_samples, chunk_rows

    def score(self, df, order, series_by=()):
        rows, w = self._windowed(df, order, series_by, self.window)
        x = F.col(self.metric)
        out = rows.withColumns({"_n": F.count(x).over(w), "_mean": F.avg(x).over(w), "_sigma": F.stddev_pop(x).over(w), "_same": F.min(x).over(w) == F.max(x).over(w)})
        out = self._own(out)
        z = F.when((F.col("_n") >= self.least) & ~F.col("_same") & (F.col("_sigma") > 0), (x - F.col("_mean")) / F.col("_sigma"))
        out = out.withColumn("z_score", z).withColumn("window_size", F.least(F.col("_n") + 1, F.lit(self.window)).cast("long"))
        return out.withColumn("score", F.abs("z_score")).withColumn("fired", F.coalesce(F.col("score") > self.threshold, F.lit(False))).drop("_n", "_mean", "_sigma", "_same")

    def metadata(self):
        return {"metric_key": F.lit(self.metric), "value": F.col(self.metric), "z_score": F.col("z_score"), "window_size": F.col("window_size"), "threshold": F.lit(self.threshold)}


class Iqr(_Detector):
    """How far a value is outside of the fences k interquartile ranges from the quartiles of the values before it.

    Quartiles are interpolated; nothing is scored before min_samples, nor after a window whose quartiles are equal.
    """

    name = "iqr"

    def __init__(self, metric_key: str = "metric", k: float = 1.5, window_size: int = 100, min_samples: int = 30, chunk_rows: int | None = None, source_dict: str = "enrichment"):
        self._from(source_dict)
        if window_size <= 1:
            raise ValueError("window_size must be > 1")
        if k <= 0:
            raise ValueError("k must be > 0")
        if min_samples < 4:
            raise ValueError("min_samples must be >= 4")
        self.metric, self.k, self.window, self.least, self.chunk_rows = metric_key, k, window_size, min_samples, chunk_rows

    def score(self, df, order, series_by=()):
        rows, w = self._windowed(df, order, series_by, self.window)
        x = F.col(self.metric)
        out = self._own(rows.withColumns({"_n": F.count(x).over(w), "_held": F.collect_list(x).over(w)}))
        out = out.withColumn("_held", F.sort_array("_held")).withColumns({"_q1": quantile(F.col("_held"), 0.25), "_q3": quantile(F.col("_held"), 0.75)}).drop("_held")
        q1, q3 = F.col("_q1"), F.col("_q3")
        use = (F.col("_n") >= self.least) & (q3 > q1)
        out = out.withColumn("lower_fence", F.when(use, q1 - self.k * (q3 - q1))).withColumn("upper_fence", F.when(use, q3 + self.k * (q3 - q1)))
        side = F.when(x < F.col("lower_fence"), "below").when(x > F.col("upper_fence"), "above")
        out = out.withColumn("side", side).withColumn("score", F.when(F.col("side") == "below", F.col("lower_fence") - x).when(F.col("side") == "above", x - F.col("upper_fence")))
        return out.withColumn("window_size", F.least(F.col("_n") + 1, F.lit(self.window)).cast("long")).withColumn("fired", F.col("side").isNotNull()).drop("_n", "_q1", "_q3")

    def metadata(self):
        return {"metric_key": F.lit(self.metric), "value": F.col(self.metric), **{c: F.col(c) for c in ("lower_fence", "upper_fence", "side", "window_size")}}


class Cusum(_Detector):
    """Two-sided cumulative sums of deviations from a target, which the first values set and which fire at a threshold.

    The sums start anew after they fire, so a series is one after another by nature: rows pass a task in order, which
    holds one state for each series in turn, and never the series.
    """

    name = "cusum"

    def __init__(self, metric_key: str = "metric", threshold: float = 5.0, slack: float = 0.5, warmup_samples: int = 30, source_dict: str = "enrichment"):
        self._from(source_dict)
        if threshold <= 0:
            raise ValueError("threshold must be > 0")
        if slack < 0:
            raise ValueError("slack must be >= 0")
        if warmup_samples < 2:
            raise ValueError("warmup_samples must be >= 2")
        self.metric, self.threshold, self.slack, self.warmup = metric_key, threshold, slack, warmup_samples

    def score(self, df, order, series_by=()):
        from pyspark.sql import types as T

        rows = numeric(self.numbers(df), self.metric).withColumn("_series", F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in series_by)) if series_by else F.lit(""))
        schema = T.StructType([f for f in rows.schema if f.name != "_series"])
        for c in ("target", "sigma", "s_high", "s_low"):
            schema = schema.add(c, "double")
        schema = schema.add("direction", "string").add("score", "double").add("fired", "boolean")
        metric, threshold, slack, warmup = self.metric, self.threshold, self.slack, self.warmup

        def run(batches: Iterator) -> Iterator:
            series, first, target, sigma, high, low = None, [], None, None, 0.0, 0.0
            for pdf in batches:
                out = []
                for s, x in zip(pdf["_series"].tolist(), pdf[metric].tolist(), strict=True):
                    if s != series:
                        series, first, target, sigma, high, low = s, [], None, None, 0.0, 0.0
                    if target is None:
                        first.append(x)
                        if len(first) == warmup:
                            target = sum(first) / warmup
                            sigma = max((sum((v - target) ** 2 for v in first) / warmup) ** 0.5, 1e-12)
                        out.append((None, None, None, None, None, None, False))
                        continue
                    d = (x - target) / sigma
                    high, low = max(0.0, high + d - slack), max(0.0, low - d - slack)
                    fired = high > threshold or low > threshold
                    out.append((target, sigma, high, low, ("up" if high > threshold else "down") if fired else None, max(high, low) if fired else None, fired))
                    if fired:
                        high = low = 0.0
                names = ["target", "sigma", "s_high", "s_low", "direction", "score", "fired"]
                columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in names}
                yield pdf.drop(columns="_series").assign(**{n: list(c) for n, c in columns.items()})

        rows = rows.repartition("_series") if series_by else rows.coalesce(1)
        return rows.sortWithinPartitions("_series", *order).mapInPandas(run, schema)

    def metadata(self):
        return {"metric_key": F.lit(self.metric), "value": F.col(self.metric), **{c: F.col(c) for c in ("target", "sigma", "s_high", "s_low", "direction")}, "threshold": F.lit(self.threshold)}


def tagged(df: DataFrame, detector: _Detector, order: Sequence[str], series_by: Sequence[str] = ()) -> DataFrame:
    """df with anomaly_<detector>: the score where it fires; all rows stay, those without a number too. Nothing is joined."""
    tag = f"anomaly_{detector.name}"
    rows = detector.numbers(df)
    kind = dict(rows.dtypes)[detector.metric]
    plain = F.lit(True) if kind in ("boolean", "string") else F.col(detector.metric).isNull()
    scored = detector.score(rows, order, series_by).withColumn(detector.metric, F.col(detector.metric).cast(kind)).withColumn(tag, F.when(F.col("fired"), F.col("score")))
    out = scored.select(*rows.columns, tag).unionByName(rows.where(plain).withColumn(tag, F.lit(None).cast("double")))
    return out.select(*df.columns, tag)


def default_detectors() -> tuple[Registry, Registry]:
    """The numeric and the sequence detectors by kind."""
    from loomspark.operators.ngram import SequenceDetector

    numeric_, sequence = Registry("numeric detector"), Registry("sequence detector")
    for d in (ZScore, Iqr, Cusum):
        numeric_.register(d.name, d)
    sequence.register("sequence_ngram", SequenceDetector)
    return numeric_, sequence
