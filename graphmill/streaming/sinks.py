"""Several tables from one stream, each row in each of them once, however often a batch is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry
from .error_index import PER_TRACE

Sink = Callable[[DataFrame], DataFrame]


def into_all(folder: str, sinks: dict[str, Sink]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what each sink makes of a batch goes to folder/name/batch=id, and once all are there, the batch to the log.

    A batch that is run again replaces its own rows, wherever it stopped. Readers (`committed`) see a batch in all tables or in none.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            for name, sink in sinks.items():
                sink(rows).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/_log/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return write


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table whose batch is in the log."""
    log = spark.read.parquet(f"{folder}/_log/*").select(F.col("batch").alias("_batch")).distinct()
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*").join(log, F.col("batch") == F.col("_batch"), "left_semi").drop("batch")


def span_sinks(methods: DataFrame) -> dict[str, Sink]:
    """The tables of a span stream (as spans.ingest gives it): spans as they are, silent catches, error spans (50 a trace of a batch), spans with the
    method they run in (methods: node, class_name, method_name), and a row a trace to push to its session."""
    m = methods.select("node", "class_name", "method_name")

    def located(rows: DataFrame) -> DataFrame:
        cut = rows.withColumns({"class_name": F.regexp_extract("operation", r"^(.*)[.#][^.#]+$", 1), "method_name": F.regexp_extract("operation", r"([^.#]+)$", 1)})
        return cut.join(m, ["class_name", "method_name"]).select("trace_id", "span_id", "node")

    failed = F.col("status").eqNullSafe("ERROR") | F.try_element_at("attributes", F.lit("exception.type")).isNotNull()
    return {
        "spans": lambda rows: rows,
        "silent": lambda rows: rows.where("silent_catch").select("trace_id", "span_id", "operation"),
        "errors": lambda rows: telemetry.capped_per_key(rows.where(failed), "trace_id", [F.col("start_nanos"), F.col("span_id")], PER_TRACE).select("trace_id", "span_id", "operation", "status"),
        "located": located,
        "push": lambda rows: rows.groupBy("session_id", "trace_id").agg(F.count("*").alias("spans"), F.sum(failed.cast("int")).alias("errors")),
    }
