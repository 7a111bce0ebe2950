"""Logs and spans in batches: search, parsing, dedup, reports, retention. The streaming forms are in graphmill.streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logs

# Codes of span kinds and statuses.
SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUS_CODES = ("UNSET", "OK", "ERROR")
SILENT_PREFIXES = ("HTTP ", "SELECT", "INSERT", "UPDATE", "DELETE")


def search_logs(rows: DataFrame, start: str | None = None, end: str | None = None, levels: list[str] | None = None, message: str | None = None, wildcard: str | None = None, trace_id: str | None = None, size: int = 100) -> DataFrame:
    """Filters that are all optional, newest first, at most size rows (a page). rows: (at, level, message, trace_id, ...)."""
    out = rows
    if start:
        out = out.where(F.col("at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("at") <= F.lit(end).cast("timestamp"))
    if levels:
        out = out.where(F.col("level").isin(levels))
    if message:
        out = out.where(F.contains(F.col("message"), F.lit(message)))
    if wildcard:
        out = out.where(F.col("message").like(wildcard.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")))
    if trace_id:
        out = out.where(F.col("trace_id") == trace_id)
    return out.orderBy(F.desc("at"), "message").limit(size)


def dedup_messages(rows: DataFrame, key: str = "message", order: str = "id") -> DataFrame:
    """The first row of each message."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def fingerprint_groups(rows: DataFrame, text: str = "text", order: str = "id") -> DataFrame:
    """(fingerprint, occurrences, first_id)."""
    return rows.select(logs.fingerprint(F.col(text)).alias("fingerprint"), F.col(order).alias("_id")).groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.min("_id").alias("first_id"))


def merge_occurrences(history: DataFrame, groups: DataFrame) -> DataFrame:
    """history (fingerprint, occurrences) with new groups added."""
    return history.select("fingerprint", "occurrences").union(groups.select("fingerprint", "occurrences")).groupBy("fingerprint").agg(F.sum("occurrences").alias("occurrences"))


def flatten_spans(payload: DataFrame) -> DataFrame:
    """OTLP rows (resourceSpans nested) to a row a span with its service name and attributes as a map."""
    def attributes(c: Column) -> Column:
        """The list as a map; of a repeated key the last value."""
        entries = F.transform(F.filter(c, lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value")))
        later = lambda e, k: F.exists(F.slice(entries, k + 2, F.size(entries)), lambda f: f["key"] == e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, k: ~later(e, k)))

    nanos = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    resource = payload.select(F.explode("resourceSpans").alias("r"))
    scope = resource.select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    span = scope.select(F.try_element_at("resource", F.lit("service.name")).alias("service"), F.explode("s.spans").alias("x"))
    events = F.filter(F.coalesce(F.col("x.events"), F.array()), lambda e: e["name"] == "exception")
    own = F.coalesce(attributes(F.col("x.attributes")), F.create_map().cast("map<string,string>"))
    last = F.coalesce(attributes(F.try_element_at(events, F.lit(-1))["attributes"]), F.create_map().cast("map<string,string>"))
    promoted = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(last), k)), last)
    return span.select(
        "service", F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("x.name").alias("operation"),
        F.coalesce(F.try_element_at(F.array(*map(F.lit, SPAN_KINDS)), F.col("x.kind") + 1), F.lit("UNSPECIFIED")).alias("kind"),
        F.coalesce(F.try_element_at(F.array(*map(F.lit, STATUS_CODES)), F.col("x.status.code") + 1), F.lit("UNSET")).alias("status"),
        nanos(F.col("x.startTimeUnixNano")).alias("start_nanos"), F.greatest(F.lit(0), F.floor((nanos(F.col("x.endTimeUnixNano")) - nanos(F.col("x.startTimeUnixNano"))) / 1000000)).cast("long").alias("duration_ms"), promoted.alias("attributes"),
    )


def silent_catch(status: Column, attributes: Column, operation: Column, kind: Column) -> Column:
    """A span that carries an exception and didn't fail, unless it is an HTTP or SQL operation, a client's, a database's or a queue's."""
    has = lambda k: F.coalesce(F.map_contains_key(attributes, k), F.lit(False))
    exempt = F.exists(F.array(*map(F.lit, SILENT_PREFIXES)), lambda p: F.startswith(F.coalesce(operation, F.lit("")), p))
    return ~status.eqNullSafe("ERROR") & has("exception.type") & ~exempt & ~kind.eqNullSafe("CLIENT") & ~has("db.system") & ~has("messaging.system")


def root_spans(spans: DataFrame) -> DataFrame:
    """The root of each trace: of spans (trace_id, span_id, parent_span_id, start, ...) without a parent in their trace the first by start, span_id;
    where all have one (a cycle), of all spans."""
    own = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_has")).distinct()
    rows = spans.join(own, ["trace_id", "parent_span_id"], "left")
    first = F.min_by(F.struct(*spans.columns), F.struct(F.coalesce("_has", F.lit(False)), "start", "span_id"))
    return rows.groupBy("trace_id").agg(first.alias("r")).select("r.*")


def trace_top_spans(spans: DataFrame, most: int = 5) -> DataFrame:
    """(trace_id, place, span_id, duration, percent): the longest spans of each trace with their share of its root's duration (at least 1)."""
    w = Window.partitionBy("trace_id").orderBy(F.desc("duration"), "span_id")
    top = spans.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    root = root_spans(spans).select("trace_id", F.greatest("duration", F.lit(1.0)).alias("_root"))
    return top.join(root, "trace_id", "left").select("trace_id", "place", "span_id", "duration", F.round(100 * F.col("duration") / F.col("_root"), 4).alias("percent"))


def trace_reports(spans: DataFrame) -> DataFrame:
    """(trace_id, operation, success, duration, n_spans, matched, errors): the root's name, state and duration, spans with a node, and
    the ids of failed spans in order. spans also has operation, status and node."""
    root = root_spans(spans).select("trace_id", "operation", (~F.col("status").eqNullSafe("ERROR")).alias("success"), "duration")
    failed = F.when(F.col("status") == "ERROR", F.struct("start", "span_id"))
    n = spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.count("node").alias("matched"), F.array_sort(F.collect_list(failed)).alias("_failed"))
    return n.join(root, "trace_id", "left").select("trace_id", "operation", "success", "duration", "n_spans", "matched", F.concat_ws(",", F.transform("_failed", lambda x: x["span_id"].cast("string"))).alias("errors"))


def chosen_trace(spans: DataFrame) -> DataFrame:
    """(session, trace_id): of each session the trace that a SERVER span roots, else any, that started last. spans also has session, kind."""
    own = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
    entry = spans.join(own, ["trace_id", "parent_span_id"], "left_anti").where("upper(kind) = 'SERVER'").select("trace_id").distinct().withColumn("_entry", F.lit(1))
    per = spans.groupBy("session", "trace_id").agg(F.min("start").alias("_start")).join(entry, "trace_id", "left")
    return per.groupBy("session").agg(F.max_by("trace_id", F.struct(F.coalesce("_entry", F.lit(0)), "_start", "trace_id")).alias("trace_id"))


def poll_logs(rows: DataFrame, now: Column, minutes: int = 15, level: str = "ERROR", size: int = 100) -> DataFrame:
    """What one poll takes: rows (at, level, message, ...) of the last minutes, newest first, at most size of them, equal messages once."""
    recent = rows.where((F.col("at") > now - F.expr(f"interval {int(minutes)} minutes")) & (F.col("at") <= now) & (F.col("level") == level))
    page = recent.orderBy(F.desc("at"), "message").limit(size)
    return page.groupBy("message").agg(F.max("at").alias("at"), F.count("*").alias("n"))


def replayed_batch_sizes(batches: DataFrame, key: str, order: str, start: int = 20, least: int = 3, most: int = 50) -> DataFrame:
    """batches (key, order, error_rate, millis_per_item) with batch_size after each check: halved above 2 % errors or 200 ms an item; after
    five checks without halving times 1.5 at the second good check in a row (below 1 % and 140 ms). A key is one sequence, so one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, since, good, out = start, 5, 0, []
        pdf = pdf.sort_values(order)
        for errors, millis in zip(pdf["error_rate"].fillna(0.0), pdf["millis_per_item"].fillna(0.0), strict=True):
            since += 1
            if errors > 0.02 or millis > 200:
                size, since, good = max(least, size // 2), 0, 0
            elif since >= 5:
                good = good + 1 if errors < 0.01 and millis < 140 else 0
                if good >= 2 and min(most, int(size * 1.5)) != size:
                    size, good = min(most, int(size * 1.5)), 0
            out.append(size)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "batch_size": out})

    kinds = {c: batches.schema[c].dataType.simpleString() for c in (key, order)}
    return batches.select(key, order, "error_rate", "millis_per_item").groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, batch_size int")


# Seconds before each retry of a stage.
RETRY_AFTER = (5, 15, 60)


def stage_states(attempts: DataFrame) -> DataFrame:
    """(run, stage, state, retry_after) of attempts (run, stage, attempt, state): the latest attempt's state, and for a failed one the
    seconds until the next, null once the retries are used up."""
    latest = attempts.groupBy("run", "stage").agg(F.max_by(F.struct("attempt", "state"), "attempt").alias("x"))
    wait = F.try_element_at(F.array(*map(F.lit, RETRY_AFTER)), F.col("x.attempt").cast("int"))
    return latest.select("run", "stage", F.col("x.state").alias("state"), F.when(F.col("x.state") == "FAILED", wait).alias("retry_after"))


def capped_per_key(rows: DataFrame, key: str, order: list[Column], most: int = 50) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order (null lowest); combined before the shuffle, so no key's rows meet in one task."""
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(order))
    return rows.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """A page by a unique order."""
    return rows.orderBy(*order).offset(offset).limit(size)


def retained(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"interval {int(hours)} hours"))


def sequenced(rows: DataFrame, session: str, order: list[str], history: DataFrame | None = None) -> DataFrame:
    """rows with seq, gap-free in each session after the history's (session, seq) highest."""
    out = rows.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))
    if history is None:
        return out
    last = history.groupBy(session).agg(F.max("seq").alias("_last"))
    return out.join(last, session, "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")


def batch_window(batches: DataFrame, key: str, order: str, size: int = 50) -> DataFrame:
    """Error rate and latency an item over the last `size` batches of (key, order, items, errors, millis)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - size, 0)
    ratio = lambda a: F.round(F.sum(a).over(w) / F.nullif(F.sum("items").over(w), F.lit(0)), 6)
    return batches.withColumns({"error_rate": ratio("errors"), "millis_per_item": ratio("millis")})
