"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, one of our own if all runs on this machine, else an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back; for rows that are read whole."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read back, and the folder, for drop() when no one reads the rows any more. For
    wide rows of which each reader wants a few columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: the place of a row in the order of the columns, from 0, by range partitions and not in one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpoint(placed.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    starts, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
