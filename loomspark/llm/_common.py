"""Helpers that several operators share: written intermediate tables, components, distributed ranks."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: what separates words for the packing, mixing and n-gram operators.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder that goes at exit, and a cluster the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if local:
            root = tempfile.mkdtemp(prefix="loomspark-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            root = f"file://{root}"
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_loomspark"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: With it, the shuffle files of an execution go when it ends, here when the table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_PATHS: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    """At the driver's end its tables go, while its session still runs."""
    for spark, path in _PATHS:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has gone before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_loom_path", None)
        if path:
            _delete(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets no more than so many rows go to Python at once in this session: texts may be long, and workers are small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def lean(run):
    """run, a function of batches, after which its worker gives memory back that it has no use for."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
                trim(0)

    return trimmed


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, even if body uses it inside of other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_ranges(n: int) -> int:
    """How many ranges n rows are cut into, so that rows in a range and ranges of a group both grow as a square root."""
    return max(1, math.isqrt(max(0, n)))


def hash_range(key: Column, ranges: int) -> Column:
    """The number of the range that a 64-bit hash falls into; monotone in the key's upper 63 bits."""
    return F.floor(F.shiftrightunsigned(key, 1).cast("double") / F.lit(float(1 << 63)) * ranges).cast("int")


def _contract(batches):
    """Per task: edges become stars around the smallest node that the task's edges join them to."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:
            yield pd.DataFrame([(x, find(x)) for x in parent], columns=["u", "v"])
            parent.clear()
    if parent:
        yield pd.DataFrame([(x, find(x)) for x in parent], columns=["u", "v"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with an edge (u, v); component: the smallest node reached.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until all edges are stars. Each step is a
    minimum by node, combined before the shuffle, and a join that Spark may split where a node is hot; each round is
    a written table. The driver sees only counts.
    """
    edge = written(edges.select("u", "v").where("u <> v").mapInPandas(lean(_contract), "u long, v long").where("u <> v").distinct(), f"{name}-edges")
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, f"{name}-edges")
        # done when every node has one centre and no centre has one itself
        state = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        bad = state.where("n > 1").select("u").unionByName(new.select(F.col("v").alias("u")).distinct().join(state.select("u"), "u", "left_semi")).limit(1).count()
        dropped(edge)
        edge = new
        if not bad:
            break
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def ranked_within(df: DataFrame, group: list[str], key: Column, order: list, n: int, name: str = "rank") -> DataFrame:
    """df with a 0-based rank in each group by a uniform hash key, then order, without a task for a whole group.

    Rows are cut into ranges of the key, ranked in each, and moved on by the sizes of the ranges before. df is
    computed twice; give it a written table where that is dear.
    """
    df = df.withColumn("_key", key).withColumn("_range", hash_range(F.col("_key"), n_ranges(n)))
    cols = [*group, "_range"]
    sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inner = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*cols).orderBy("_key", *order)) - 1)
    return inner.join(before, cols).withColumn(name, F.col("_rank") + F.coalesce("_before", F.lit(0))).drop("_key", "_range", "_rank", "_before")
