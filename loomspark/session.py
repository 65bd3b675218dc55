"""Sessions as the engine expects them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "loomspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides, with "_" for "." in names."""
    builder = SparkSession.builder.appName(app)
    for name, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
