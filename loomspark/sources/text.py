"""Lines from files, standard input and iterables; templates, labels and models from small files."""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.errors import ConfigurationError, SourceError
from loomspark.schema import record_id

#: The columns that put lines in the order of their arrival.
ORDER = ("file", "seq")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, path: str, keep_blank: bool = False, encoding: str = "utf-8", strict: bool = False) -> DataFrame:
    """raw, file, seq, id of the lines of text files; ".gz" is read as such.

    ids stand for a line's place in the scan, so they are the same for the same files and split size. Empty lines go,
    lines of white space stay. seq orders the lines of a file: it grows with a line's place in the
    scan. Bytes that are no UTF-8 are read as U+FFFD; with strict they fail the job. A path that isn't there fails now.
    """
    if not _exists(spark, path):
        raise SourceError(f"source path not found: {path}")
    if encoding.lower().replace("_", "-") not in ("utf-8", "utf8"):
        raw = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("mode", "PERMISSIVE").schema("value string").csv(path)
    else:
        raw = spark.read.text(path)
    out = raw.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("seq"))
    if not keep_blank:
        out = out.where("raw <> ''")
    if strict:
        out = out.withColumn("raw", F.when(F.col("raw").contains("�"), F.raise_error(F.concat(F.lit("a line is no UTF-8 in "), F.col("file")))).otherwise(F.col("raw")))
    return out.withColumn("id", record_id(F.col("file"), F.col("seq.start"), F.col("seq.row")))


def from_iterable(spark: SparkSession, items: Iterable[str]) -> DataFrame:
    """raw, file, seq, id of given lines; blank ones stay."""
    rows = [(x, "iterable", (0, i)) for i, x in enumerate(items)]
    out = spark.createDataFrame(rows, "raw string, file string, seq struct<start:long,row:long>")
    return out.withColumn("id", record_id(F.col("file"), F.col("seq.start"), F.col("seq.row")))


def from_stdin(spark: SparkSession, stream=None, folder: str | None = None) -> DataFrame:
    """Lines of standard input, spooled to a file that goes at the driver's end; blank ones stay.

    The file is in folder, else in spark.checkpoint.dir, which a cluster shares; a local session without either uses a
    temporary folder.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("standard input needs spark.checkpoint.dir on a cluster")
        folder = tempfile.mkdtemp(prefix="loomspark-stdin-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/stdin-{uuid.uuid4().hex}.log")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(path)
    out = system.create(path)
    try:
        for part in iter(lambda it=iter(stream or sys.stdin): "".join(islice(it, 10_000)), ""):
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()
    return lines(spark, path.toString(), keep_blank=True)


def cap(df: DataFrame, most: int, order=ORDER) -> DataFrame:
    """The first lines in order, as a top-k."""
    return df.orderBy(*order).limit(most)



def templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(EventId, EventTemplate) in file order, from a CSV file with a header; rows that lack one go. A small file."""
    if not _exists(spark, path):
        raise ConfigurationError(f"templates file not found: {path}")
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if not {"EventId", "EventTemplate"} <= set(rows.columns):
        return []
    return [(r[0], r[1]) for r in rows.select("EventId", "EventTemplate").collect() if r[0] and r[1]]


def labels(spark: SparkSession, path: str) -> DataFrame:
    """BlockId, Label from a CSV file with a header: blank ones go, of several for a block the last stays."""
    rows = spark.read.option("header", True).csv(path).select("BlockId", "Label", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    rows = rows.where("BlockId <> '' and Label <> ''")
    return rows.groupBy("BlockId").agg(F.max_by("Label", "_at").alias("Label"))


def read_json(path: str):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise SourceError(f"can't read {path}: {e}") from e


def jdbc(spark: SparkSession, dsn: str, table: str, **options: str) -> DataFrame:
    """A table of a database; filters and columns are pushed down by Spark."""
    return spark.read.format("jdbc").options(url=dsn, dbtable=table, **options).load()
