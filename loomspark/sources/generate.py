"""Synthetic log lines, by hashes of row numbers: the same seed gives the same lines at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The normal life of a block: (event, component, content).
LIFE = (
    ("allocate", "dfs.FSNamesystem", "BLOCK* NameSystem.allocateBlock: /user/data/part-{i}. {b}"),
    ("receiving", "dfs.DataNode$DataXceiver", "Receiving block {b} src: /10.0.0.{x}:{p} dest: /10.0.0.{y}:50010"),
    ("responder", "dfs.DataNode$PacketResponder", "PacketResponder {z} for block {b} terminating"),
    ("received", "dfs.DataNode$PacketResponder", "Received block {b} of size {i} from /10.0.0.{x}"),
    ("stored", "dfs.FSNamesystem", "BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.0.0.{x}:50010 is added to {b} size {i}"),
    ("deleting", "dfs.DataNode", "Deleting block {b} file /data/current/{b}"),
)
BROKEN = ("exception", "dfs.DataNode$DataXceiver", "writeBlock {b} received exception java.io.IOException: Connection reset by peer")


def _uniform(seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _number(seed: int, low: int, high: int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(high - low + 1)) + low).cast("long")


def hdfs_lines(spark: SparkSession, blocks: int, anomaly_rate: float = 0.05, seed: int = 0) -> DataFrame:
    """raw, block, anomaly, seq: the lives of blocks, mixed at random over a month.

    A part of the blocks is broken: cut short, two steps swapped, or an exception put in.
    """
    rows = spark.range(blocks).withColumn("anomaly", F.when(_uniform(seed, F.col("id")) < anomaly_rate, F.element_at(F.array(*map(F.lit, ("truncate", "reorder", "inject"))), _number(seed + 1, 1, 3, F.col("id")).cast("int"))))
    rows = rows.withColumn("cut", _number(seed + 2, 2, len(LIFE) - 1, F.col("id"))).withColumn("at", _number(seed + 3, 0, len(LIFE) - 2, F.col("id")))
    steps = F.sequence(F.lit(0), F.lit(len(LIFE) - 1))
    life = (
        F.when(F.col("anomaly") == "truncate", F.slice(steps, F.lit(1), F.col("cut").cast("int")))
        .when(F.col("anomaly") == "reorder", F.transform(steps, lambda s: F.when(s == F.col("at"), s + 1).when(s == F.col("at") + 1, s - 1).otherwise(s).cast("int")))
        .when(F.col("anomaly") == "inject", F.flatten(F.transform(steps, lambda s: F.when(s == F.col("at") + 1, F.array(F.lit(len(LIFE)), s)).otherwise(F.array(s)))))
        .otherwise(steps)
    )
    rows = rows.select("id", "anomaly", F.posexplode(life).alias("step", "event"))
    key = [F.col("id"), F.col("step")]
    block = F.concat(F.lit("blk_"), F.xxhash64(F.lit(seed), F.col("id")).cast("string"))
    components = F.element_at(F.array(*(F.lit(x[1]) for x in (*LIFE, BROKEN))), F.col("event") + 1)
    content = F.element_at(F.array(*(F.lit(x[2]) for x in (*LIFE, BROKEN))), F.col("event") + 1)
    for i, (mark, low, high) in enumerate((("i", 1, 100_000), ("x", 0, 255), ("y", 0, 255), ("z", 0, 3), ("p", 40_000, 60_000))):
        content = F.replace(content, F.lit("{" + mark + "}"), _number(seed + 10 + i, low, high, *key).cast("string"))
    content = F.replace(content, F.lit("{b}"), block)
    # a block's steps keep their order: each is at its own share of a random stretch
    second = F.floor(_uniform(seed + 20, F.col("id")) * (29 * 86_400)) + F.col("step") * 600 + _number(seed + 21, 0, 599, *key)
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + second)
    raw = F.concat(F.date_format(ts, "yyMMdd HHmmss"), F.lit(" "), _number(seed + 22, 1, 30_000, *key).cast("string"), F.lit(" INFO "), components, F.lit(": "), content)
    return rows.select(raw.alias("raw"), block.alias("block"), "anomaly", F.struct(second.alias("second"), F.xxhash64(*key).alias("tie")).alias("seq"))


def bgl_lines(spark: SparkSession, n: int, anomaly_rate: float = 0.05, seed: int = 0) -> DataFrame:
    """raw, alert, seq: machine events, some of them alerts."""
    key = F.col("id")
    ts = F.timestamp_micros(F.lit(1_117_756_800_000_000) + F.floor(_uniform(seed, key) * 30 * 86_400 * 1_000_000).cast("long"))
    alert = _uniform(seed + 1, key) < anomaly_rate
    code = F.element_at(F.array(*map(F.lit, ("KERNDTLB", "KERNSTOR", "APPSEV", "KERNMNTF"))), _number(seed + 2, 1, 4, key).cast("int"))
    node = F.format_string("R%02d-M%d-N%d-C:J%02d-U%02d", *(_number(seed + 3 + i, 0, high, key) for i, high in enumerate((31, 1, 9, 18, 11))))
    parts = (F.when(alert, code).otherwise("-"), F.unix_timestamp(ts).cast("string"), F.date_format(ts, "yyyy.MM.dd"), node, F.date_format(ts, "yyyy-MM-dd-HH.mm.ss.SSSSSS"), node, F.lit("RAS KERNEL"), F.when(alert, "FATAL").otherwise("INFO"), F.when(alert, "data TLB error interrupt").otherwise("instruction cache parity error corrected"))
    return spark.range(n).select(F.concat_ws(" ", *parts).alias("raw"), alert.alias("alert"), F.col("id").alias("seq"))


def bench_lines(spark: SparkSession, n: int) -> DataFrame:
    """raw, seq: lines at one time, for throughput."""
    return spark.range(n).select(F.format_string("081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_%d terminating", F.col("id")).alias("raw"), F.col("id").alias("seq"))
