"""Streaming forms of the telemetry operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import logs
from ..operators import telemetry

_VALUE = "struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean>>"
#: The payload of an OTLP trace export in JSON.
PAYLOAD = (
    f"resourceSpans array<struct<resource:struct<attributes:array<{_VALUE}>>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int,message:string>,attributes:array<{_VALUE}>,events:array<struct<name:string,timeUnixNano:string,attributes:array<{_VALUE}>>>>>>>>>"
)


def read_payloads(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """JSON payload files as they arrive."""
    return spark.readStream.schema(PAYLOAD).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(folder)


def ingest(payload: DataFrame, sessions: DataFrame) -> DataFrame:
    """Spans of services that have a registered session (service, session_id), silent catches marked. For batches and streams."""
    s = telemetry.flatten_spans(payload).join(sessions, "service")
    marked = telemetry.silent_catch(F.col("status"), F.col("attributes"), F.col("operation"), F.col("kind"))
    return s.withColumn("silent_catch", marked)


def rate_by_window(events: DataFrame, at: str, width: str = "10 minutes", late: str = "15 minutes") -> DataFrame:
    """Counts of each type in tumbling windows; rows later than `late` behind the newest are dropped with their window closed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def dedup_reports(reports: DataFrame, at: str, keys: list[str], within: str = "30 minutes") -> DataFrame:
    """The first report of its keys within the time."""
    return reports.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def count_fingerprints(lines: DataFrame, text: str = "text", ttl_ms: int | None = None) -> DataFrame:
    """(fingerprint, occurrences): running counts, a row for each fingerprint of a batch; with ttl_ms, state that isn't seen for so long is let go."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        n += sum(len(b) for b in batches)
        state.update((n,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"fingerprint": [key[0]], "occurrences": [n]})

    out = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("occurrences", T.LongType())])
    kept = T.StructType([T.StructField("n", T.LongType())])
    return lines.select(logs.fingerprint(F.col(text)).alias("fingerprint")).groupBy("fingerprint").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout)


# Where a report may go from each state.
TRANSITIONS = {"PENDING": ("RUNNING", "FAILED"), "RUNNING": ("DONE", "FAILED"), "FAILED": ("PENDING",), "DONE": ()}


def follow_reports(changes: DataFrame) -> DataFrame:
    """(report_id, state, rejected) of a stream (report_id, seq, state): legal changes are taken in seq order, others counted."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rejected = state.get if state.exists else ("PENDING", 0)
        for to in pd.concat(list(batches)).sort_values("seq")["state"]:
            if to in TRANSITIONS.get(now, ()):
                now = to
            else:
                rejected += 1
        state.update((now, rejected))
        yield pd.DataFrame({"report_id": [key[0]], "state": [now], "rejected": [rejected]})

    kind = changes.schema["report_id"].dataType
    out = T.StructType([T.StructField("report_id", kind), T.StructField("state", T.StringType()), T.StructField("rejected", T.LongType())])
    kept = T.StructType([T.StructField("state", T.StringType()), T.StructField("rejected", T.LongType())])
    return changes.groupBy("report_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def append_once(target: str, key: str, session: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds rows whose key the log at target lacks, numbered without gaps in each session. A batch that is run again
    adds nothing, as its keys are there."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            log = spark.read.parquet(target)
        except Exception as e:  # noqa: BLE001  no log yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            log = None
        fresh = batch.dropDuplicates([key])
        if log is not None:
            fresh = fresh.join(log.select(key), key, "left_anti")
        telemetry.sequenced(fresh, session, order, log).write.mode("append").parquet(target)

    return write
