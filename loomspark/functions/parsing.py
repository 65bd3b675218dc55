"""Parsers of log lines as Column builders: one struct for each line, with an error instead of an exception."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.registry import Registry

#: Level names and severities.
HDFS_LEVELS = {"DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARNING", "WARNING": "WARNING", "ERROR": "ERROR", "FATAL": "CRITICAL"}
BGL_LEVELS = {**HDFS_LEVELS, "SEVERE": "CRITICAL", "FAILURE": "CRITICAL"}

#: The fields of a parsed line, in order; a field that a format lacks is null.
FIELDS = {
    "parse_error": "string", "timestamp": "timestamp", "source": "string", "severity": "string", "message": "string", "raw": "string",
    "pid": "string", "level_raw": "string", "line_id": "string", "type": "string", "node_repeat": "string",
    "block_id": "string", "event_id": "string", "parse_warning": "string", "bgl_label": "string", "node": "string",
}


@dataclass(frozen=True)
class LineFormat:
    """A format: whether it claims a line, columns to compute first (in steps, each from those before), and its fields.

    Steps are columns of their own, named with the format's prefix, so that what several fields need is computed once
    and generated code stays small.
    """

    name: str
    claims: Callable[[Column], Column]
    steps: tuple[Callable[[Column], dict[str, Column]], ...]
    fields: Callable[[Column], dict[str, Column]]


def block_id(message: Column) -> Column:
    """The first block id in a message, or null."""
    return F.nullif(F.regexp_extract(message, r"blk_-?\d+", 0), F.lit(""))


def _known(level: Column, levels: dict[str, str]) -> Column:
    """The severity of a level name, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)), level)


def _severity(severity: Column, level: Column) -> tuple[Column, Column]:
    """Severity and warning: unknown names are INFO with a warning."""
    return F.coalesce(severity, F.lit("INFO")), F.when(severity.isNull(), F.concat(F.lit("unknown level: "), level))


def _time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A UTC time, null if there is none such; two-digit years from 69 on are of the last century."""
    year, second = year.cast("int"), second.cast("int")
    year = F.when(year >= 69, year + 1900).otherwise(year + 2000)
    return F.when(second < 60, F.try_make_timestamp(year, month.cast("int"), day.cast("int"), hour.cast("int"), minute.cast("int"), second.cast("decimal(16,6)")))


def _hdfs_split(raw: Column) -> dict[str, Column]:
    return {"_h_parts": F.split(raw, " ", 6), "_h_shaped": raw.rlike(r"^\d{6} \d{6} \d+ \w+ [\w$.]+: [^\n]*$")}


def _hdfs_values(raw: Column) -> dict[str, Column]:
    parts = F.col("_h_parts")
    stamp = F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    time = F.when(F.col("_h_shaped"), _time(*(F.substring(stamp, i, 2) for i in range(1, 12, 2))))
    return {"_h_time": time, "_h_message": F.get(parts, F.lit(5)), "_h_severity": _known(F.get(parts, F.lit(3)), HDFS_LEVELS)}


def _hdfs(raw: Column) -> dict[str, Column]:
    part = lambda i: F.get("_h_parts", F.lit(i))
    severity, warning = _severity(F.col("_h_severity"), part(3))
    return {
        "parse_error": F.when(~F.col("_h_shaped"), F.concat(F.lit("line does not match the HDFS format: "), F.substring(raw, 1, 80))).when(F.col("_h_time").isNull(), F.concat(F.lit("invalid HDFS timestamp "), F.substring(raw, 1, 13))),
        "timestamp": F.col("_h_time"), "source": F.substring(part(4), F.lit(1), F.length(part(4)) - 1), "severity": severity, "message": F.col("_h_message"), "raw": raw,
        "pid": part(2), "level_raw": part(3), "block_id": block_id(F.col("_h_message")), "parse_warning": warning,
    }


def _bgl_split(raw: Column) -> dict[str, Column]:
    return {"_b_parts": F.split(F.regexp_replace(raw, r"^\s+", ""), r"\s+", 10)}


def _bgl_values(raw: Column) -> dict[str, Column]:
    stamp = F.get("_b_parts", F.lit(4))
    shaped = stamp.rlike(r"^\d{4}-\d{1,2}-\d{1,2}-\d{1,2}\.\d{1,2}\.\d{1,2}\.\d{1,6}$")
    return {"_b_time": F.when(shaped, F.try_to_timestamp(stamp, F.lit("yyyy-M-d-H.m.s.SSSSSS"))), "_b_severity": _known(F.get("_b_parts", F.lit(8)), BGL_LEVELS)}


def _bgl(raw: Column) -> dict[str, Column]:
    part = lambda i: F.get("_b_parts", F.lit(i))
    whole = F.coalesce(part(9) != "", F.lit(False))
    severity, warning = _severity(F.col("_b_severity"), part(8))
    return {
        "parse_error": F.when(~whole, F.concat(F.lit("BGL line has too few fields: "), F.substring(raw, 1, 80))).when(F.col("_b_time").isNull(), F.concat(F.lit("invalid BGL timestamp "), part(4))),
        "timestamp": F.col("_b_time"), "source": part(7), "severity": severity, "message": part(9), "raw": raw, "level_raw": part(8), "type": part(6), "node_repeat": part(5),
        "parse_warning": warning, "bgl_label": part(0), "node": part(3),
    }


_CSV = ("line_id", "date", "time", "pid", "level", "component", "content", "event_id", "template")
#: Twelve digits, or fewer where a leading zero is missing, as year, month, day, hour, minute, second.
_LOOSE = r"^(\d\d)(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])(2[0-3]|[01]\d|\d)([0-5]\d|\d)(6[01]|[0-5]\d|\d)$"


def _csv_split(raw: Column) -> dict[str, Column]:
    return {"_c_row": F.from_csv(raw, ", ".join(f"{c} string" for c in _CSV), {"nullValue": "\u0000", "emptyValue": "", "escape": '"', "mode": "PERMISSIVE"})}


def _csv_values(raw: Column) -> dict[str, Column]:
    stamp = F.concat("_c_row.date", "_c_row.time")
    return {"_c_cut": F.when(stamp.rlike(_LOOSE), F.split(F.regexp_replace(stamp, _LOOSE, "$1-$2-$3-$4-$5-$6"), "-")), "_c_severity": _known(F.col("_c_row.level"), HDFS_LEVELS)}


def _csv_time(raw: Column) -> dict[str, Column]:
    return {"_c_time": _time(*(F.get("_c_cut", F.lit(i)) for i in range(6)))}


def _structured_csv(raw: Column) -> dict[str, Column]:
    field = lambda c: F.col(f"_c_row.{c}")
    whole = F.coalesce(field("template").isNotNull(), F.lit(False)) & (raw != "")
    severity, warning = _severity(F.col("_c_severity"), field("level"))
    rebuilt = F.concat(field("date"), F.lit(" "), field("time"), F.lit(" "), field("pid"), F.lit(" "), field("level"), F.lit(" "), field("component"), F.lit(": "), field("content"))
    return {
        "parse_error": F.when(~whole, F.concat(F.lit("expected 9 CSV fields or more: "), F.substring(raw, 1, 80))).when(F.col("_c_time").isNull(), F.concat(F.lit("invalid HDFS timestamp "), field("date"), field("time"))),
        "timestamp": F.col("_c_time"), "source": field("component"), "severity": severity, "message": field("content"), "raw": rebuilt, "pid": field("pid"), "level_raw": field("level"),
        "line_id": field("line_id"), "block_id": block_id(field("content")), "event_id": F.nullif(field("event_id"), F.lit("")), "parse_warning": warning,
    }


HDFS = LineFormat("hdfs", lambda raw: raw.rlike(r"^\d{6} \d{6} \d+ "), (_hdfs_split, _hdfs_values), _hdfs)
STRUCTURED_CSV = LineFormat("hdfs_structured_csv", lambda raw: raw.rlike(r"^\d+(,|$)"), (_csv_split, _csv_values, _csv_time), _structured_csv)
BGL = LineFormat("bgl", lambda raw: raw.rlike(r"^\s*(-|\p{Lu}+)(\s|$)"), (_bgl_split, _bgl_values), _bgl)


def default_parsers() -> Registry:
    """The built-in formats in the order in which they are asked about a line."""
    out = Registry("parser")
    for f in (HDFS, STRUCTURED_CSV, BGL):
        out.register(f.name, lambda f=f: f)
    return out


def detect(raw: Column, parsers: Registry | None = None) -> Column:
    """The name of the first format that claims a line, or null."""
    return F.coalesce(*(F.when(make().claims(raw), F.lit(name)) for name, make in (parsers or default_parsers()).items()))


def parse(df: DataFrame, kind: str = "hdfs", parsers: Registry | None = None, column: str = "raw") -> DataFrame:
    """df with FIELDS parsed from a column of lines; kind "auto" asks the formats for each line.

    A line that can't be parsed has parse_error and null fields, but for raw. Columns that df has already (enrichment
    from before) are kept where the parser gives null, and replaced where it gives a value.
    """
    parsers = parsers or default_parsers()
    raw = F.col(column)
    formats = [make() for _, make in parsers.items()] if kind == "auto" else [parsers.create(kind)]
    had = df.columns
    if kind == "auto":
        df = df.withColumn("_format", detect(raw, parsers))
    for f in formats:
        for step in f.steps:
            df = df.withColumns(step(raw))
    if kind == "auto":
        own = [(F.col("_format") == f.name, f.fields(raw)) for f in formats]

        def field(c: str) -> Column:
            out = F.when(F.col("_format").isNull(), F.concat(F.lit("no registered parser claims the line: "), F.substring(raw, 1, 80))) if c == "parse_error" else F.lit(None)
            for fits, fields in own:
                if c in fields:
                    out = F.when(fits, fields[c]).otherwise(out)
            return out
    else:
        fields = formats[0].fields(raw)
        field = lambda c: fields.get(c, F.lit(None))
    df = df.withColumn("_error", F.when(raw.isNull(), F.lit("no line")).otherwise(field("parse_error")))
    keep = [F.col(c) for c in had if c not in FIELDS]
    values = []
    for c, t in FIELDS.items():
        if c == "parse_error":
            continue
        value = F.when(F.col("_error").isNull(), field(c).cast(t))
        if c in had:
            value = F.coalesce(value, F.col(c).cast(t))
        values.append(value.alias(c))
    return df.select(*keep, F.col("_error").alias("parse_error"), *values)


def split_parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that could be parsed, and those that couldn't."""
    return df.where("parse_error is null").drop("parse_error"), df.where("parse_error is not null")
