"""Evaluation: bins of time, confusion matrices, precision and recall, field agreement of two parsers."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_start(ts: Column, seconds: int) -> Column:
    """The bin that a time falls into: seconds within the minute below a minute, else whole minutes within the hour."""
    if seconds <= 0:
        raise ValueError("seconds must be > 0")
    if seconds < 60:
        size, base, part = seconds, F.date_trunc("minute", ts), F.second(ts)
    else:
        size, base, part = seconds // 60 * 60, F.date_trunc("hour", ts), F.minute(ts) * 60
    return F.timestamp_micros(F.unix_micros(base) + (part - part % size).cast("long") * 1_000_000)


def rates(df: DataFrame, seconds: int, alert: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """bin, n and alert (if any row of the bin has one), counted before the shuffle."""
    alert = alert if alert is not None else F.lit(False)
    return df.where("timestamp is not null").groupBy(*by, bin_start(F.col("timestamp"), seconds).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(alert, F.lit(False))).alias("alert"))


def bgl_alert() -> Column:
    return F.col("bgl_label") != "-"


def confusion(df: DataFrame, predicted: str | Column, actual: str | Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 (0 where undefined, rounded to 4)."""
    p, a = (F.col(c) if isinstance(c, str) else c for c in (predicted, actual))
    p, a = F.coalesce(p, F.lit(False)), F.coalesce(a, F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = df.agg(count(p & a).alias("tp"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"), count(~p & ~a).alias("tn"))
    return with_scores(out)


def with_scores(df: DataFrame) -> DataFrame:
    tp = F.col("tp").cast("double")
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    precision, recall = share(tp, F.col("tp") + F.col("fp")), share(tp, F.col("tp") + F.col("fn"))
    return df.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(share(2 * precision * recall, precision + recall), 4).alias("f1"))


def confusion_from_sets(universe: DataFrame, predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """A confusion matrix from sets of keys; keys outside of the universe don't count."""
    p = predicted.select(key).distinct().withColumn("_p", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    return confusion(universe.select(key).distinct().join(p, key, "left").join(a, key, "left"), "_p", "_a")


def agreement(left: DataFrame, right: DataFrame, on: str, fields: Sequence[str]) -> DataFrame:
    """For each field, how many rows with the same key agree in it; nulls agree with nulls."""
    l, r = left.select(on, *fields), right.select(on, *(F.col(f).alias(f"r_{f}") for f in fields))  # noqa: E741
    return l.join(r, on).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.col(f).eqNullSafe(F.col(f"r_{f}")).cast("long")).alias(f) for f in fields))


def save(result: dict, path: str) -> None:
    """Results as JSON, and beside it as a Markdown table of its rows."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, indent=2)


def markdown(rows: Sequence[dict]) -> str:
    """A Markdown table of rows with the same keys."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]) + "\n"
