"""Streaming: rate buckets by source and numeric detectors by series, whose state goes on from batch to batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.errors import ConfigurationError
from loomspark.operators.detect import Cusum, Iqr, ZScore, numeric
from loomspark.operators.validate import RateLimitValidator

#: A step takes a key's state and a batch of its values in order, and returns the new state and a result for each.
Step = Callable[[list[float], list[float]], tuple[list[float], list]]


def window_step(score: Callable, size: int) -> Step:
    """score(values before, value) over at most size values before each; these are the state."""

    def step(state, values):
        import numpy as np

        every = np.array([*state, *values], np.float64)
        at = [len(state) + i for i in range(len(values))]
        return every[-size:].tolist(), [score(every[max(0, i - size) : i], every[i]) for i in at]

    return step


def quantile(values: list[float], p: float) -> float:
    """As detect.quantile, to the last bit."""
    place = p * (len(values) - 1)
    at = int(place)
    d = place - at
    return values[at] if d == 0 else math.fma(values[at], 1 - d, values[at + 1] * d)


def detector_step(detector) -> Step:
    """The step of a detector; its results are a score, and whether it fires."""
    import numpy as np

    if isinstance(detector, ZScore):

        def z(before, x):
            if len(before) < detector.least or before.min() == before.max() or not (sigma := before.std()) > 0:
                return None, False
            score = abs(float((x - before.mean()) / sigma))
            return score, score > detector.threshold

        return window_step(z, detector.window)
    if isinstance(detector, Iqr):

        def fence(before, x):
            if len(before) < detector.least:
                return None, False
            held = np.sort(before).tolist()
            q1, q3 = quantile(held, 0.25), quantile(held, 0.75)
            low, high = q1 - detector.k * (q3 - q1), q3 + detector.k * (q3 - q1)
            if q3 > q1 and (x < low or x > high):
                return float(low - x if x < low else x - high), True
            return None, False

        return window_step(fence, detector.window)
    if isinstance(detector, Cusum):

        def cusum(state, values):
            # target, sigma, both sums; or the first values, fewer than the warm-up, after a mark of their own
            warm, rest, out = bool(state) and state[0] == 1.0, list(state[1:]), []
            for x in values:
                if not warm:
                    rest.append(x)
                    if len(rest) == detector.warmup:
                        first = np.array(rest)
                        warm, rest = True, [float(first.mean()), max(float(first.std()), 1e-12), 0.0, 0.0]
                    out.append((None, False))
                    continue
                target, sigma, high, low = rest
                d = (x - target) / sigma
                high, low = max(0.0, high + d - detector.slack), max(0.0, low - d - detector.slack)
                fired = max(high, low) > detector.threshold
                out.append((max(high, low) if fired else None, fired))
                rest = [target, sigma, 0.0, 0.0] if fired else [target, sigma, high, low]
            return [float(warm), *rest], out

        return cusum
    raise ConfigurationError(f"no streaming form of {type(detector).__name__}")


def bucket_step(limit: RateLimitValidator) -> Step:
    """A token bucket, full at its first row; values are times in seconds, results whether the row gets a token."""

    def step(state, values):
        tokens, last = state or (limit.capacity, float("nan"))
        out = []
        for now in values:
            if now == now:
                if last == last:
                    tokens = min(limit.capacity, tokens + max(0.0, now - last) * limit.refill)
                last = now
            out.append((tokens >= 1.0,))
            tokens -= 1.0 if tokens >= 1.0 else 0.0
        return [tokens, last], out

    return step


class SeriesProcessor(StatefulProcessor):
    """Rows of a key in order through a step; the state is a few numbers, however many rows there were."""

    def __init__(self, step: Step, columns: Sequence[str], value: str, order: Sequence[str], names: Sequence[str]):
        self.step, self.columns, self.value, self.order, self.names = step, list(columns), value, list(order), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "numbers array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Spark hands names that begin with an underscore on as numbered ones
        new = pd.concat(list(rows)).set_axis(self.columns, axis=1).sort_values(self.order, kind="stable")
        held = [float(v) for v in self.state.get()[0]] if self.state.exists() else []
        held, results = self.step(held, [float(v) if v is not None else float("nan") for v in new[self.value].tolist()])
        self.state.update((held,))
        yield new.drop(columns=["_key", "_value"], errors="ignore").assign(**{n: list(c) for n, c in zip(self.names, zip(*results, strict=True), strict=True)})

    def close(self) -> None:
        pass


def _through(df: DataFrame, step: Step, value: str, order: Sequence[str], results: dict[str, str]) -> DataFrame:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("_key", "_value")]
    schema = ", ".join([*kept, *(f"{n} {kind}" for n, kind in results.items())])
    return df.groupBy("_key").transformWithStateInPandas(SeriesProcessor(step, df.columns, value, order, list(results)), schema, "Append", "None")


def stream_limited(df: DataFrame, limit: RateLimitValidator, order: Sequence[str], time: str = "timestamp", reason: str = "reject_reason") -> DataFrame:
    """Rows of a stream with the reason why their source's bucket rejects them, null if it holds a token.

    Rows of a micro-batch are put in order; across micro-batches the order is that of arrival, and time that goes back
    refills nothing. Give it the rows that earlier validators accept.
    """
    source = F.when(F.coalesce("source", F.lit("")) == "", F.lit("<unknown>")).otherwise(F.col("source"))
    keyed = df.drop(reason).withColumn("_key", source).withColumn("_value", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    out = _through(keyed, bucket_step(limit), "_value", order, {"_taken": "boolean"})
    return out.withColumn(reason, F.when(~F.col("_taken"), F.concat(F.lit("rate limit exceeded for "), source))).drop("_taken")


def stream_scored(df: DataFrame, detector, order: Sequence[str], series_by: Sequence[str] = ()) -> DataFrame:
    """Numeric rows of a stream with score and fired, by a z-score, IQR or CUSUM detector.

    Windows and sums go on across micro-batches: a stream in order gives what a batch gives. The state of a series is
    its last window_size values, or four numbers. Without series_by all rows are one series, which is one task.
    """
    rows = numeric(detector.numbers(df), detector.metric)
    key = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in series_by)) if series_by else F.lit("")
    return _through(rows.withColumn("_key", key), detector_step(detector), detector.metric, order, {"score": "double", "fired": "boolean"})
