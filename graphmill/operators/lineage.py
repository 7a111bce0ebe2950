"""Cutting lineage in loops: checkpoints in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "graphmill-checkpoints"))


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder: lineage ends there, so a lost executor loses nothing.

    The estimated size of a checkpoint's plan, a product over its joins, would be handed on to what is built on it: over the rounds of a loop it grows
    to a number of millions of digits that fills the driver. So the kept rows are a new frame, without an estimate.
    """
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().logical().rdd(), kept.schema(), False), df.sparkSession)


def saved_by(df: DataFrame, *columns: str) -> DataFrame:
    """As saved, but as Parquet, a folder for each value of columns: who asks for a part reads its files and the columns it needs alone."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.partitionBy(*columns).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of saved frames that nothing will read again."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Files go to Python in batches of 8 MB at most (a larger file is one alone), set in the caller's session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def running(df: DataFrame, order: list[Column], value: Column, before: str) -> DataFrame:
    """df with `before`: the sum of value over all rows ahead in the order (a unique one). A range sort gives each task one range, and
    the ranges' sums (a number a task) give its start, so no task sees all rows."""
    rows = saved(df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_value": value}))
    starts, upto = [], 0
    for r in sorted(rows.groupBy("_range").agg(F.sum("_value").alias("s")).collect()):  # a row a task
        starts.append((r["_range"], upto))
        upto += r["s"]
    table = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    ahead = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(table), "_range").withColumn(before, (F.col("_start") + F.coalesce(F.sum("_value").over(ahead), F.lit(0))).cast("long")).drop("_range", "_start", "_value")
