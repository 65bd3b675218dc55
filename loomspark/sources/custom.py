"""Sources of one's own: a function that yields lines of a part, as a Spark data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.schema import record_id

SCHEMA = "raw string, file string, seq struct<start:long,row:long>"


def register(spark: SparkSession, name: str, parts: Sequence, read: Callable[[object], Iterator[str]]) -> None:
    """Makes read(part) a source for spark.read.format(name): each part is a task that yields its lines in order."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition((i, part)) for i, part in enumerate(parts)]

        def read(self, partition):
            i, part = partition.value
            for row, line in enumerate(read(part)):
                yield line, str(part), (i, row)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)


def lines(spark: SparkSession, name: str) -> DataFrame:
    """raw, file, seq, id of a registered source."""
    return spark.read.format(name).load().withColumn("id", record_id(F.col("file"), F.col("seq.start"), F.col("seq.row")))
