"""Registered queries that run a stream over a table until it is used up; each call writes to a folder of its own under the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_dir
from ..streaming import error_index as X
from ..streaming import sinks
from . import projection as P


def _folder(spark: SparkSession) -> str:
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of files."""
    return spark.readStream.schema(P.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


def error_index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of error spans after the whole stream: a user is a trace. A session of its own has the state store's setting."""
    own, folder = spark.newSession(), _folder(spark)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    errors = _events(own, sf_dir).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.col("ts").cast("timestamp").alias("at"), F.col("props").alias("detail"))
    changes = X.error_index(errors, per_trace=5, traces=1_000_000, ttl_ms=10 * 365 * 86_400_000, shards=64)
    changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).start().awaitTermination()
    return X.indexed(spark.read.parquet(f"{folder}/out")).select("trace_id", "span_id", "detail")


def sinks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of one stream, each row once."""
    folder = _folder(spark)
    tables = {
        "errors": lambda rows: rows.where("event_type = 'error'").select("event_type", F.lit(1).alias("n")),
        "values": lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n")),
        "users": lambda rows: rows.select("user_id", "event_type").distinct().select("event_type", F.lit(1).alias("n")),
    }
    write = sinks.into_all(folder, tables)

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            write(batch, batch_id)

    _events(spark, sf_dir).writeStream.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    parts = [sinks.committed(spark, folder, name).groupBy(F.lit(name).alias("sink"), "event_type").agg(F.sum("n").alias("rows")) for name in tables]
    return parts[0].union(parts[1]).union(parts[2])


QUERIES = {f.__name__: f for f in (error_index_stream, sinks_stream)}

ORACLE_SQL = {
    "error_index_stream": """
SELECT user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, props AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id::VARCHAR) AS k FROM events WHERE event_type = 'error' AND user_id IS NOT NULL) WHERE k <= 5""",
    "sinks_stream": """
SELECT 'errors' AS sink, event_type, count(*) AS rows FROM events WHERE event_type = 'error' GROUP BY event_type
UNION ALL SELECT 'values', event_type, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'users', event_type, count(DISTINCT user_id) FROM events GROUP BY event_type""",
}
