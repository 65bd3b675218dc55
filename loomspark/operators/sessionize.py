"""Traces: the events of a block in the order of their arrival, closed by a cap, a terminal event, idleness or the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events that end a block's life.
TERMINAL = ("E9", "E21")


def with_block(df: DataFrame) -> DataFrame:
    """Rows that belong to a block; others pass a sessionizer by."""
    return df.where("block_id is not null and block_id <> ''")


def traces(
    df: DataFrame, order: Sequence[str], max_records_per_trace: int | None = 1000, idle_window_s: float = 30.0, terminal: Sequence[str] = TERMINAL,
    janitor: str = "final", run_id: str | None = None, keep_records: bool = True, max_open_traces: int | None = None,
) -> DataFrame:
    """Traces of rows (block_id, event_id, timestamp, id): block_id, chunk, event_sequence, record_ids, first and last
    timestamp, record_count, pipeline_run_id, closed_reason.

    A trace closes as "evicted" with as many events as max_records_per_trace; the next row opens another (chunk).
    Rows without an event count as records only. Of the traces left at the end, janitor "final" closes those with a
    terminal event as "terminal", those idle for longer than idle_window_s before the latest time of all as "timeout",
    and the rest as "shutdown"; with "none" all are "shutdown".

    max_open_traces bounds how many blocks are open at once; the one that was longest without a row closes as "evicted".
    Where there are no more blocks than that, it changes nothing; else rows are read one after another by
    evict_least_recent(), and ids must be unique.

    One shuffle by block serves the numbering of chunks and the grouping. max_records_per_trace None groups whole
    blocks, and then rows are combined before the shuffle as far as lists can be.
    """
    if idle_window_s <= 0:
        raise ValueError("idle_window_s must be > 0")
    if max_records_per_trace is not None and max_records_per_trace <= 0:
        raise ValueError("max_records_per_trace must be > 0")
    if janitor not in ("final", "none"):
        raise ValueError("janitor must be final or none")
    rows, evicted = with_block(df), None
    if max_open_traces is not None and rows.select("block_id").distinct().limit(max_open_traces + 1).count() > max_open_traces:
        marks = evict_least_recent(rows, order, max_open_traces, max_records_per_trace).persist()
        rows = rows.join(marks.select("id", F.col("trace").alias("chunk")), "id")
        evicted = marks.where("evicted is not null").select(F.col("evicted").alias("block_id"), F.col("evicted_trace").alias("chunk"), F.lit(True).alias("_evicted"))
    elif max_records_per_trace is None:
        rows = rows.withColumn("chunk", F.lit(0).cast("long"))
    else:
        before = Window.partitionBy("block_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("chunk", F.floor(F.count("event_id").over(before) / max_records_per_trace))
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col("event_id").alias("event"), *([F.col("id")] if keep_records else []))
    out = rows.groupBy("block_id", "chunk").agg(
        F.array_sort(F.collect_list(place)).alias("_rows"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count(F.lit(1)).cast("int").alias("record_count"), F.coalesce(F.max(F.col("event_id").isin(list(terminal)).cast("int")), F.lit(0)).alias("_terminal"),
    )
    events = F.filter(F.transform("_rows", lambda r: r["event"]), lambda e: e.isNotNull())
    out = out.withColumn("event_sequence", events).withColumn("record_ids", F.transform("_rows", lambda r: r["id"]) if keep_records else F.array().cast("array<string>"))
    closed = F.lit("shutdown")
    if janitor == "final":
        latest = rows.agg(F.max("timestamp").alias("_latest"))
        out = out.crossJoin(F.broadcast(latest))  # one row
        idle = F.unix_micros("last_timestamp") < F.unix_micros("_latest") - F.lit(int(idle_window_s * 1_000_000))
        closed = F.when(F.col("_terminal") > 0, "terminal").when(idle, "timeout").otherwise(closed)
    if max_records_per_trace is not None:
        closed = F.when(F.size("event_sequence") >= max_records_per_trace, "evicted").otherwise(closed)
    if evicted is not None:
        out = out.join(evicted, ["block_id", "chunk"], "left")
        closed = F.when(F.col("_evicted"), "evicted").otherwise(closed)
    return out.select("block_id", "chunk", "event_sequence", "record_ids", "first_timestamp", "last_timestamp", "record_count", F.lit(run_id).cast("string").alias("pipeline_run_id"), closed.alias("closed_reason"))


def evict_least_recent(df: DataFrame, order: Sequence[str], max_open_traces: int, max_records_per_trace: int | None = 1000) -> DataFrame:
    """(block_id, id, trace, evicted, evicted_trace) of rows with a bounded number of open blocks, in one task.

    The exact order of evictions depends on how all blocks interleave, so this emulation reads the rows one after
    another; it holds max_open_traces counters and is for comparison, not for scale. Each row gets the number of its
    trace in the block; evicted and evicted_trace name the block and trace that was put out at the row, if any.
    """
    if max_open_traces <= 0:
        raise ValueError("max_open_traces must be > 0")

    def run(batches):
        from collections import Counter, OrderedDict

        import pandas as pd

        open_: OrderedDict[str, list] = OrderedDict()
        closed: Counter = Counter()
        for pdf in batches:
            out = []
            for block, event, own in zip(pdf["block_id"], pdf["event_id"], pdf["id"], strict=True):
                state = open_.setdefault(block, [0, closed[block]])
                open_.move_to_end(block)
                state[0] += event is not None and event == event
                out.append((block, own, state[1], None, None))
                if max_records_per_trace is not None and state[0] >= max_records_per_trace:
                    open_.pop(block)
                    closed[block] += 1
                    out[-1] = (block, own, state[1], block, state[1])
                elif len(open_) > max_open_traces:
                    gone, (_, trace) = open_.popitem(last=False)
                    closed[gone] += 1
                    out[-1] = (block, own, state[1], gone, trace)
            yield pd.DataFrame(out, columns=["block_id", "id", "trace", "evicted", "evicted_trace"]).astype({"evicted_trace": "Int64"})

    return with_block(df).coalesce(1).sortWithinPartitions(*order).select("block_id", "event_id", "id").mapInPandas(run, "block_id string, id string, trace long, evicted string, evicted_trace long")


def trace_records(traces: DataFrame, records: DataFrame) -> DataFrame:
    """The records of each trace: block_id, chunk, position and the record's columns."""
    ids = traces.select("block_id", "chunk", F.posexplode("record_ids").alias("position", "id"))
    return ids.join(records.drop("block_id", "chunk", "position"), "id")
