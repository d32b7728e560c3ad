"""Helpers shared by the training-data operators: reading, checkpoints, hot keys and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many; so there are fewer hot keys than this, and they may be broadcast.
HOT_ONE_IN = 200
#: The most bytes of a measured side of a join that is broadcast.
BROADCAST = 32 << 20
#: Edges of a graph that a task gets, at least.
EDGES = 100_000
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back; the lineage is cut. Where no folder is set, one
    of our own serves if all runs on this machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns are left behind, so their names can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of a few MB, and memory given back when a task ends.

    The limits on batches are settings of the session, lowered here and left lowered: a worker and the JVM each hold a
    batch, and the defaults (10,000 rows or 64 MB) are too much where several tasks share a small executor."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or BATCH_ROWS)))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean(batches):
        cache = worker_cache()
        if cache.get("owner") != (owner := f"{run.__module__}.{run.__qualname__}"):
            cache.clear()
            cache["owner"] = owner
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def worker_cache() -> dict:
    """What the function at work keeps in this Python worker from task to task; another function finds it empty."""
    import sys
    import types

    return sys.modules.setdefault("_sitewarden_worker", types.SimpleNamespace(kept={})).kept


def release() -> None:
    """Give memory that is free but held back to the system: a worker lives on after its task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim(spark: SparkSession) -> None:
    """Have the executors collect their garbage, after which a JVM gives back heap that it doesn't need: a job of one
    short task for each core, so that an executor hardly goes without. It changes no result; it is for between two
    stages of which the first has grown the heaps and the second needs memory for its Python workers."""
    free(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).agg(F.count("done")).collect()


def free(spark: SparkSession) -> None:
    """Have the driver collect its garbage, after which Spark deletes the shuffle files and checkpoints that no plan
    names any more; left alone it does so at some later moment, or after the job. Then both of the driver's processes
    give memory that is free but held back to the system. It changes no result."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)
    release()


def trim_native(spark: SparkSession) -> str | None:
    """Have the driver's JVM give freed native memory back, of which compilers and network threads leave some hundred MB
    behind: the JVM's own command System.trim_native_heap. Returns what it says, None where a JVM has no such command."""
    from py4j.protocol import Py4JError

    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang

    def array(kind, *values):
        made = gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            made[i] = value
        return made

    try:
        kinds = [java.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
        commands = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, commands, "systemTrimNativeHeap", None, None))
    except Py4JError:
        return None


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if its rows are counted and found to take at most `limit` bytes, else to be shuffled."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of key that hold more than 1 in HOT_ONE_IN of df's rows: fewer than HOT_ONE_IN rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg((F.count("*") / HOT_ONE_IN).alias("_limit"))
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_limit")).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left joined (left outer) to right, which has one row a key. Rows of the hot keys meet a broadcast of fewer than
    HOT_ONE_IN rows of right; the others are shuffled."""
    hot = F.broadcast(hot.select(F.col(key).alias("_hot")))
    cold_left = left.join(hot, left[key].eqNullSafe(F.col("_hot")), "left_anti")
    hot_left = left.join(hot, left[key].eqNullSafe(F.col("_hot")), "left_semi")
    hot_right = right.join(hot, right[key].eqNullSafe(F.col("_hot")), "left_semi")
    return cold_left.join(right, key, "left").unionByName(hot_left.join(F.broadcast(hot_right), key, "left"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the connected components of edges (a, b), root being the least node of each; only nodes in edges.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each
    round every node links its larger neighbours, then its smaller ones, to the least node that it sees. Each is an
    aggregation to a minimum and a join on the node, so no neighbourhood is gathered. A round's edges are written to
    the checkpoint folder; the rounds end when no edge changes. Edges are dealt to one task for every EDGES of them, so
    that the many rounds of a small graph don't cost a task and a file for each shuffle partition. In a graph of more
    tasks the nodes with more than 1 in HOT_ONE_IN of the edges get their least node by broadcast, not by shuffle.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n = edges.count()
    parts = min(shuffle_partitions(edges.sparkSession), 1 + n // EDGES)
    edges, seen = edges.coalesce(parts), None

    def attach(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
        """rows with the column m of least (key, m, n), which has one row a key; n counts its rows."""
        if parts == 1:
            return rows.join(least.drop("n"), key)
        hot = F.broadcast(least.where(f"n > {2 * n // HOT_ONE_IN}").drop("n"))
        return rows.join(hot.select(key), key, "left_anti").join(least.drop("n"), key).unionByName(rows.join(hot, key))

    for _ in range(max_rounds):
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = attach(both.where("v > u"), least, "u").where("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).coalesce(parts).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
        small = attach(large, least, "x").select(F.explode(F.array(F.struct(F.col("x").alias("u"), "m"), F.struct(F.col("y").alias("u"), "m"))).alias("e"))
        small = small.select(F.greatest("e.u", "e.m").alias("a"), F.least("e.u", "e.m").alias("b")).where("a <> b").coalesce(parts)
        edges = checkpoint(small.distinct().coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    pairs = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    return edges.select(F.explode(pairs).alias("e")).select("e.node", "e.root").distinct().coalesce(parts)


def slices(batch, column: str, limit: int):
    """Runs of a record batch's rows with at most `limit` bytes in a string or binary column, one row at least; so
    that what a worker holds besides Spark's batch is bounded by a row or by the limit."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends, start, n = np.cumsum(sizes), 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
