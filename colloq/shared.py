"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    A local folder is made only where driver and executors are one process;
    elsewhere a missing folder is an error, as executors would each write to
    their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="colloq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path below the folder of this application."""
    return f"{scratch_root(spark)}/colloq-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the running tasks only, and
    the table has exact sizes for the planner. Values that depend on where a
    row ran (generated row ids) are fixed from here on.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`durable` returned and that nothing reads any more."""
    root = f"{scratch_root(df.sparkSession)}/colloq-{df.sparkSession.sparkContext.applicationId}/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1].lstrip("/") in path:
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has left in the shared folder."""
    _delete(spark, f"{scratch_root(spark)}/colloq-{spark.sparkContext.applicationId}")


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no table refers to: Spark deletes them when the driver's garbage is collected, which may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered_in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` sorted, with ``name`` counting from 0; only one number for each partition comes to the driver."""
    spark = df.sparkSession
    own = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["p"], total))
        total += row["n"]
    table = spark.createDataFrame(starts, "_p long, _start long")
    return own.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_start") + place).drop("_p", "_start", "_at")  # a row a partition


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """Small rows from which each task makes much more: a partition for each ``rows`` of them, whatever their bytes, and one a core at least."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n)
