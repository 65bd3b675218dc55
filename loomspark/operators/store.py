"""The repository: log records, traces and anomalies as Parquet tables or a database, with the read queries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.errors import ConfigurationError, RepositoryError
from loomspark.schema import ANOMALY_EVENTS, BLOCK_TRACES, LOG_RECORDS

TABLES = {"log_records": LOG_RECORDS, "block_traces": BLOCK_TRACES, "anomaly_events": ANOMALY_EVENTS}
GROUPS = ("severity", "source")


@dataclass(frozen=True)
class QueryFilters:
    """Conditions that all hold; times are inclusive."""

    severity: str | None = None
    source: str | None = None
    pipeline_run_id: str | None = None
    after: datetime | str | None = None
    before: datetime | str | None = None
    limit: int = 1000


def filtered(df: DataFrame, filters: QueryFilters) -> DataFrame:
    """The rows that meet the filters, without order or limit; all conditions can be pushed into a scan."""
    for name in ("severity", "source", "pipeline_run_id"):
        if (value := getattr(filters, name)) is not None:
            df = df.where(F.col(name) == value)
    if filters.after is not None:
        df = df.where(F.col("timestamp") >= F.lit(filters.after).cast("timestamp"))
    if filters.before is not None:
        df = df.where(F.col("timestamp") <= F.lit(filters.before).cast("timestamp"))
    return df


def query_logs(df: DataFrame, filters: QueryFilters = QueryFilters(), order=("timestamp", "id")) -> DataFrame:
    """The first rows by time that meet the filters: filters in the scan, order and limit as a top-k."""
    if filters.limit < 1:
        raise ValueError("limit must be >= 1")
    return filtered(df, filters).orderBy(*order).limit(filters.limit)


def aggregate_logs(df: DataFrame, group_by: str = "severity", metric: str = "count") -> DataFrame:
    """Counts by severity or source, the most first."""
    if metric != "count" or group_by not in GROUPS:
        raise NotImplementedError(f"aggregation {metric} by {group_by} is not supported")
    return df.groupBy(group_by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), group_by)


def list_anomalies(df: DataFrame, detector: str | None = None, limit: int = 100) -> DataFrame:
    """The latest anomalies, of one detector or all."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be between 1 and 10000")
    if detector is not None:
        df = df.where(F.col("detector_name") == detector)
    return df.orderBy(F.desc("detected_at"), "id").limit(limit)


def union_anomalies(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


class LogStore:
    """Tables under a path, appended as a whole or not at all; without a path they live in the session as views."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self._memory = spark, path.rstrip("/") if path else None, {}

    def save(self, table: str, df: DataFrame) -> None:
        if table not in TABLES:
            raise RepositoryError(f"unknown table: {table}")
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        if self.path:
            df = df.withColumn("date", F.to_date({"log_records": "timestamp", "block_traces": "last_timestamp", "anomaly_events": "detected_at"}[table]))
            self._append(df.write.partitionBy("date").format("parquet").option("path", f"{self.path}/{table}"), table)
        else:
            self._memory[table] = self._memory[table].unionByName(df) if table in self._memory else df
            self._memory[table].createOrReplaceTempView(f"loomspark_{table}")

    @staticmethod
    def _append(writer, table: str) -> None:
        """Spark tries a failed task again by itself; what fails for good is an error of the store."""
        try:
            writer.mode("append").save()
        except Exception as e:
            raise RepositoryError(f"writing {table} failed: {e}"[:2000]) from e

    def save_batch(self, records: DataFrame) -> None:
        self.save("log_records", records)

    def save_traces(self, traces: DataFrame) -> None:
        self.save("block_traces", traces)

    def save_anomalies(self, anomalies: DataFrame) -> None:
        self.save("anomaly_events", anomalies)

    def _written(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise RepositoryError(f"unknown table: {table}")
        if not self.path:
            return self._memory[table] if table in self._memory else self.spark.createDataFrame([], TABLES[table])
        if not self._written(table):
            return self.spark.createDataFrame([], TABLES[table])
        return self._table(table).drop("date")

    def _table(self, table: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[table]}, date date").parquet(f"{self.path}/{table}")

    def all_records(self) -> DataFrame:
        return self.read("log_records")

    def all_traces(self) -> DataFrame:
        return self.read("block_traces")

    def all_anomalies(self) -> DataFrame:
        return self.read("anomaly_events")

    def query(self, filters: QueryFilters = QueryFilters()) -> DataFrame:
        """The first records that meet the filters; bounds on time also choose the days whose files are read."""
        df = self.all_records()
        if self.path and self._written("log_records"):
            df = self._table("log_records")
            if filters.after is not None:
                df = df.where(F.col("date") >= F.to_date(F.lit(filters.after).cast("timestamp")))
            if filters.before is not None:
                df = df.where(F.col("date") <= F.to_date(F.lit(filters.before).cast("timestamp")))
            df = df.drop("date")
        return query_logs(df, filters)

    def aggregate(self, group_by: str = "severity", metric: str = "count") -> DataFrame:
        return aggregate_logs(self.all_records(), group_by, metric)

    def clear(self) -> None:
        self._memory.clear()
        if self.path:
            for table in TABLES:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class JdbcStore(LogStore):
    """The same tables in a database reached by JDBC; maps and arrays are stored as JSON text."""

    def __init__(self, spark: SparkSession, dsn: str, **options: str):
        super().__init__(spark)
        if not dsn:
            raise ConfigurationError("a database needs a dsn")
        self.options = {"url": dsn, **options}

    def save(self, table: str, df: DataFrame) -> None:
        if table not in TABLES:
            raise RepositoryError(f"unknown table: {table}")
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        out = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes))
        self._append(out.write.format("jdbc").options(**self.options, dbtable=table), table)

    def read(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise RepositoryError(f"unknown table: {table}")
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        df = self.spark.read.format("jdbc").options(**self.options, dbtable=table).load()
        text = {f.name: f.dataType for f in schema if f.dataType.simpleString().startswith(("map", "array"))}
        return df.select(*(F.from_json(f.name, text[f.name]).alias(f.name) if f.name in text else F.col(f.name).cast(f.dataType) for f in schema))

    def clear(self) -> None:
        for table in TABLES:
            self.read(table).limit(0).write.format("jdbc").options(**self.options, dbtable=table, truncate="true").mode("overwrite").save()
