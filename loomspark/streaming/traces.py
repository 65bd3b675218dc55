"""Streaming: lines from growing folders, traces with state, and a finalizer for what is still open at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.errors import ConfigurationError
from loomspark.operators.sessionize import TERMINAL, traces, with_block
from loomspark.schema import record_id
from loomspark.sources.text import ORDER

TRACE = "block_id string, chunk long, event_sequence array<string>, record_ids array<string>, first_timestamp timestamp, last_timestamp timestamp, record_count int, closed_reason string"

#: The last time of a trace without times.
NEVER = -(1 << 62)


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """raw, file, id of the lines of text files that appear in a folder; empty lines go. The rate is files a trigger.

    An id hashes a line's file, its split and text, the same when a batch is tried again; a stream can't number lines, so
    equal lines of a split have equal ids, and finalize() counts them.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = reader.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return out.where("raw <> ''").withColumn("id", record_id(F.col("file"), F.col("start"), F.col("raw")))


def replay(spark: SparkSession, lines: DataFrame, rows_per_second: float, order: Sequence[str] = ORDER) -> DataFrame:
    """A stream of given lines in their order, so many a second: ticks of Spark's rate source, each of which is a line.

    Lines are numbered by one window over all, so this is for replaying a sample to something that listens.
    """
    if rows_per_second < 1:
        raise ConfigurationError("a replay needs a rate of 1 line a second or more")
    numbered = lines.withColumn("_tick", F.row_number().over(Window.orderBy(*order)) - 1)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", int(rows_per_second)).option("numPartitions", 1).load()
    return ticks.select(F.col("value").alias("_tick")).join(numbered, "_tick").drop("_tick")


class TraceProcessor(StatefulProcessor):
    """One open trace for each block; a micro-batch stands for a pass of the janitor.

    Rows are appended first. Then a trace with a terminal event closes as "terminal"; one whose last time is behind the
    watermark by the idle window closes as "timeout" when its timer expires; a full one closes as "evicted" at once.
    """

    def __init__(self, order: Sequence[str], idle_window_s: float, most: int, terminal: Sequence[str]):
        self.order, self.idle, self.most, self.terminal = list(order), int(idle_window_s * 1000), most, frozenset(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event string, id string, ts long")
        self.meta = handle.getValueState("meta", "chunk long, events int, terminal boolean, last long")

    def _emit(self, key, rows, chunk: int, reason: str) -> pd.DataFrame:
        times = [r[2] for r in rows if r[2] is not None]
        at = lambda v: pd.Timestamp(v, unit="us", tz="UTC").tz_localize(None) if v is not None else pd.NaT
        return pd.DataFrame({
            "block_id": [key[0]], "chunk": [chunk], "event_sequence": [[r[0] for r in rows if r[0] is not None]], "record_ids": [[r[1] for r in rows]],
            "first_timestamp": [at(min(times, default=None))], "last_timestamp": [at(max(times, default=None))], "record_count": [len(rows)], "closed_reason": [reason],
        }).astype({"record_count": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new.sort_values(self.order, kind="stable")
        chunk, events, terminal, last = self.meta.get() if self.meta.exists() else (0, 0, False, NEVER)
        # rows of earlier batches stay in the state store, and are read only when their trace closes
        fresh, before, timer = [], self.rows.exists(), last
        for event, own, ts in zip(new["event_id"], new["id"], new["micros"], strict=True):
            event = None if event is None or event != event else event
            fresh.append((event, own, None if ts != ts else int(ts)))
            events += event is not None
            terminal = terminal or event in self.terminal
            if events >= self.most:
                yield self._emit(key, self._stored(before) + fresh, chunk, "evicted")
                fresh, before, events, terminal, chunk, last = [], False, 0, False, chunk + 1, NEVER
        if terminal and (fresh or before):
            yield self._emit(key, self._stored(before) + fresh, chunk, "terminal")
            fresh, before, events, terminal, chunk, last = [], False, 0, False, chunk + 1, NEVER
        if not before:
            self.rows.clear()
        if fresh:
            self.rows.appendList(fresh)
        last = max([last, *(r[2] // 1000 for r in fresh if r[2] is not None)])
        if timer != last:
            if timer != NEVER:
                self.handle.deleteTimer(timer + self.idle)
            if last != NEVER:
                self.handle.registerTimer(last + self.idle)
        self.meta.update((chunk, events, terminal, last))

    def _stored(self, before: bool) -> list:
        return [tuple(r) for r in self.rows.get()] if before else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.rows.exists():
            chunk, *_ = self.meta.get()
            yield self._emit(key, self._stored(True), chunk, "timeout")
            self.rows.clear()
            self.meta.update((chunk + 1, 0, False, NEVER))

    def close(self) -> None:
        pass


def stream_traces(parsed: DataFrame, order: Sequence[str] = ("timestamp", "id"), idle_window_s: float = 30.0, max_records_per_trace: int = 1000, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """Closed traces of a stream of parsed rows (block_id, event_id, timestamp, id), appended as they close.

    State is keyed by block and kept in the state store, so it spills and survives restarts. Rows within a micro-batch
    are put in order; later than the watermark none is dropped here, it reopens its block. Traces that are still open
    when a stream ends are found by finalize().

    The watermark drives timers alone: the time that reaches the processor isn't the column that Spark filters by.
    """
    rows = with_block(parsed).withWatermark("timestamp", "0 seconds").withColumn("micros", F.unix_micros("timestamp"))
    extra = [c for c in order if c not in ("timestamp", "id", "block_id", "event_id")]
    rows = rows.select("block_id", "event_id", "id", F.timestamp_micros("micros").alias("timestamp"), "micros", *extra)
    return rows.groupBy("block_id").transformWithStateInPandas(TraceProcessor(order, idle_window_s, max_records_per_trace, terminal), TRACE, "Append", "EventTime")


def stream_sessions(parsed: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Plain gap sessions by block: start, end (the last time and the gap), records, by Spark's own session windows; late
    rows are dropped. A row exactly a gap after the last one begins a session, as ends are exclusive: Spark joins windows
    that touch, so they are shorter by a microsecond, which is the resolution of times."""
    rows = with_block(parsed).withWatermark("timestamp", gap)
    tick = F.expr("interval 1 microsecond")
    out = rows.groupBy("block_id", F.session_window("timestamp", f"{gap} -1 microseconds").alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return out.select("block_id", F.col("w.start").alias("start"), (F.col("w.end") + tick).alias("end"), "records")


def stream_rates(parsed: DataFrame, width: str = "1 hour", delay: str = "0 seconds", by: Sequence[str] = ()) -> DataFrame:
    """Counts in tumbling windows of event time."""
    return parsed.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bin"), *by, "n")


def finalize(records: DataFrame, emitted: DataFrame, order: Sequence[str], **options) -> DataFrame:
    """Traces of the records that no emitted trace holds, closed as a batch closes them at its end.

    Records with equal ids, equal lines of a split, are left as many as weren't emitted, the last of them.
    """
    done = emitted.select(F.explode("record_ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_done"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    left = records.withColumn("_place", place).join(done, "id", "left").where(F.col("_place") > F.coalesce("_done", F.lit(0)))
    return traces(left.drop("_place", "_done"), order, **options)


def run_batches(df: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None], interval: str | None = None, available_now: bool = False):
    """Starts a stream whose micro-batches go to handler, with a checkpoint folder for recovery."""
    writer = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()
