"""A bounded index of error spans as a stream with state: so many spans a trace, so many traces, each for so long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Spans of a trace, traces, and milliseconds since a trace's last span.
PER_TRACE, TRACES, TTL_MS = 50, 10_000, 2 * 60 * 60 * 1000
_OUT = "trace_id string, span_id string, at timestamp, detail string, change string"


class _Index(StatefulProcessor):
    """One shard: its traces as trace -> (turn of its last span, at, spans), and their spans as (trace, place) -> (span_id, at, detail)."""

    def __init__(self, per_trace: int, traces: int, ttl_ms: int):
        self.per_trace, self.most, self.ttl_ms = per_trace, traces, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.traces = handle.getMapState("traces", "trace_id string", "turn long, at long, n int")
        self.spans = handle.getMapState("spans", "trace_id string, place int", "span_id string, at long, detail string")
        self.turn = handle.getValueState("turn", "turn long")

    def _dropped(self, trace: str, n: int, change: str) -> list[tuple]:
        out = []
        for place in range(n):
            span_id, at, detail = self.spans.getValue((trace, place))
            self.spans.removeKey((trace, place))
            out.append((trace, span_id, at, detail, change))
        self.traces.removeKey((trace,))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new.assign(at=new["at"].astype("datetime64[ms]").astype("int64")).sort_values(["at", "trace_id", "span_id"])
        known = {k[0]: v for k, v in self.traces.iterator()}  # at most the shard's share of traces
        turn = self.turn.get()[0] if self.turn.exists() else 0
        held: dict[str, set] = {}
        out = []
        for trace, span_id, at, detail in zip(new["trace_id"], new["span_id"], new["at"].tolist(), new["detail"], strict=True):
            _, last, n = known.get(trace, (0, at, 0))
            if trace not in held:
                held[trace] = {self.spans.getValue((trace, p))[0] for p in range(n)}
            if span_id in held[trace]:
                continue
            turn += 1
            if n < self.per_trace:
                self.spans.updateValue((trace, n), (span_id, at, detail))
                held[trace].add(span_id)
                out.append((trace, span_id, at, detail, "ADD"))
                n += 1
            known[trace] = (turn, max(last, at), n)
            while len(known) > self.most:
                oldest = min(known, key=lambda t: known[t][0])
                out += self._dropped(oldest, known.pop(oldest)[2], "EVICT")
                held.pop(oldest, None)
        for trace, (t, last, n) in known.items():
            if trace in held:
                self.traces.updateValue((trace,), (t, last, n))
                self.handle.registerTimer(last + self.ttl_ms)
        self.turn.update((turn,))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (trace,), (_, last, n) in list(self.traces.iterator()):
            if last + self.ttl_ms <= due:
                out += self._dropped(trace, n, "EXPIRE")
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["trace_id", "span_id", "at", "detail", "change"])
        return out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    def close(self) -> None:
        pass


def error_index(spans: DataFrame, per_trace: int = PER_TRACE, traces: int = TRACES, ttl_ms: int = TTL_MS, late: str = "10 minutes", shards: int = 1) -> DataFrame:
    """Changes (trace_id, span_id, at, detail, change) of an index of the error spans of a stream (trace_id, span_id, at, detail).

    ADD: one of the first per_trace spans of a trace (a span_id once). EVICT: of the trace whose last span is longest ago, in order of arrival, when
    there are more than traces. EXPIRE: the watermark is ttl_ms past a trace's last span; later spans than `late` are dropped. Rows
    without a trace or span id are left out.

    Traces are dealt to shards by hash, each with its share of the traces, so that state and work are split; 1 shard has one exact order over
    all traces and holds at most traces * per_trace spans. Needs the RocksDB state store.
    """
    rows = spans.where("trace_id is not null and span_id is not null").select("trace_id", "span_id", "at", F.col("detail").cast("string").alias("detail"), F.pmod(F.xxhash64("trace_id"), F.lit(shards)).alias("shard"))
    watched = rows.withWatermark("at", late).groupBy("shard")
    return watched.transformWithStateInPandas(statefulProcessor=_Index(per_trace, max(1, traces // shards), ttl_ms), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")


def indexed(changes: DataFrame) -> DataFrame:
    """(trace_id, span_id, at, detail) now in the index, of all changes so far (a span that went may come again: the later state counts)."""
    sign = F.when(F.col("change") == "ADD", 1).otherwise(-1)
    return changes.groupBy("trace_id", "span_id", "at", "detail").agg(F.sum(sign).alias("_n")).where("_n > 0").drop("_n")
