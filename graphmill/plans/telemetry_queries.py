"""Registered queries: logs, spans, retention, sequences, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import logs, scores
from ..operators import telemetry as T
from . import projection as P


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.upper("event_type").alias("level"), F.concat_ws(" ", "event_type", F.lpad(F.col("event_id").cast("string"), 9, "0"), "props").alias("message"), F.col("user_id").cast("string").alias("trace_id"), "event_id")
    return T.search_logs(e, "2024-01-05", "2024-01-25", ["ERROR", "CLICK"], message="k", wildcard="*k*7*").select("event_id")


def fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), "text")
    return T.fingerprint_groups(d)


def fingerprint_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up stack traces, so that types and frames are found."""
    e = P.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("java.lang.E"), F.col("user_id") % 5, F.lit("Exception: at 1\n\tat org.apache.x.Y.run(Y.java:1)\n\tat a.b.C"), F.col("event_id") % 3, F.lit(".m(C.java:7)")).alias("text"))
    return T.fingerprint_groups(e)


def message_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("message"))
    return T.dedup_messages(c).select("id")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events")
    k = P.json_number(F.col("props"))
    attributes = F.map_filter(F.create_map(F.lit("exception.type"), F.when(k % 2 == 0, "X"), F.lit("db.system"), F.when(k % 5 == 0, "pg")), lambda _, v: v.isNotNull())
    parent = F.when(F.col("event_id") % 4 > 0, F.col("event_id") - F.col("event_id") % 4)
    return e.select(parent.alias("parent_span_id"), F.col("ts").alias("start"), F.when(k % 3 == 0, k).alias("node"), (F.col("user_id") % 10).alias("session"), F.col("event_id").alias("span_id"), F.col("user_id").alias("trace_id"), F.col("value").alias("duration"), F.col("event_type").alias("operation"), F.when(k % 7 == 0, "CLIENT").otherwise("SERVER").alias("kind"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"), attributes.alias("attributes"), "ts")


def silent_catch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    return s.select("span_id", T.silent_catch(F.col("status"), F.col("attributes"), F.col("operation"), F.col("kind")).alias("suspected"))


def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trace_top_spans(_spans(spark, sf_dir))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trace_reports(_spans(spark, sf_dir))


def trace_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chosen_trace(_spans(spark, sf_dir))


def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a minute are a trace, so that parents are found."""
    from ..operators.graph import span_tree as tree

    e = P.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("trace_id"), F.col("event_id").alias("span_id"), F.when(F.col("event_id") % 20 > 0, F.floor((F.col("event_id") - 1) / 2)).alias("parent_span_id"))
    return tree(e)


def log_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.upper("event_type").alias("level"), F.concat_ws(":", "event_type", "props").alias("message"))
    return T.poll_logs(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 24 * 60)


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", 0.03).otherwise(0.0).alias("error_rate"), (F.col("event_id") % 150).cast("double").alias("millis_per_item"))
    return T.replayed_batch_sizes(b, "user_id", "event_id")


def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("stage"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "SUCCESS").otherwise("RUNNING").alias("state"))
    return T.stage_states(T.sequenced(a, "run", ["stage", "o_orderkey"]).select("run", "stage", F.col("seq").alias("attempt"), "state"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of stored fingerprints with those of a new batch added."""
    e = P.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("user_id") % 7).alias("text"), "ts")
    old, new = (T.fingerprint_groups(e.where(f"ts {x} '2024-01-20'")) for x in ("<", ">="))
    return T.merge_occurrences(old, new)


def rate_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming counts run over the table as a file stream to its end; what they wrote is read again."""
    import uuid

    from ..operators.lineage import checkpoint_dir
    from ..streaming import spans

    checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rate-{uuid.uuid4().hex}"
    P.table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(f"{top}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{top}/in")
    rates = spans.rate_by_window(stream, "ts", "1 day", "400 days")
    last = lambda batch, k: batch.write.mode("overwrite").parquet(f"{top}/out")
    rates.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out")


def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy("trace_id").agg(F.min("ts").alias("first_at"), F.count("*").alias("spans"), F.sum((F.col("status") == "ERROR").cast("int")).alias("errors")).orderBy("first_at", "trace_id")


def error_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.capped_per_key(_spans(spark, sf_dir).where("status = 'ERROR'"), "trace_id", [F.desc("ts"), F.col("span_id")], 5).select("trace_id", "span_id")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_per_key(P.table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.retained(P.table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 72).select("event_id")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 40, 20)


def seq_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return T.sequenced(c.where("turn > 1"), "conv_id", ["turn"], c.where("turn <= 1").select("conv_id", (F.col("turn") + 1).alias("seq")))


def batch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 9 + 1).alias("items"), (F.col("event_type") == "error").cast("long").alias("errors"), (F.col("event_id") % 300).alias("millis"))
    return T.batch_window(b, "user_id", "event_id").select("event_id", "error_rate", "millis_per_item")


def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return T.sequenced(o, "o_custkey", ["o_orderkey"]).select("o_orderkey", (F.col("seq") - 1).alias("ahead"))


def snowflake(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey") * 123456789
    return P.table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in scores.snowflake_parts(x).items()])


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "events").select("event_id", logs.first_field(F.col("props"), ["missing", "k"]).cast("long").alias("k"))


QUERIES = {f.__name__: f for f in (log_search, fingerprint_dedup, fingerprint_traces, message_dedup, silent_catch, trace_report, trace_summary, trace_choice, span_tree, log_poll, batch_sizes, stage_states, occurrences, rate_by_window, trace_order, error_index, latest_per_key, retention, page, seq_per_session, batch_window, queue_position, snowflake, json_fields)}

_SPANS = """spans AS (SELECT event_id AS span_id, user_id AS trace_id, value AS duration, event_type, ts, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 4 > 0 THEN event_id - event_id % 4 END AS parent FROM events),
free AS (SELECT s.* FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent)), roots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS r FROM free) WHERE r = 1)"""
ORACLE_SQL = {
    "log_search": "SELECT event_id FROM (SELECT *, event_type || ' ' || lpad(event_id::VARCHAR, 9, '0') || ' ' || props AS m FROM events) WHERE ts >= '2024-01-05' AND ts <= '2024-01-25' AND event_type IN ('error', 'click') AND contains(m, 'k') AND m LIKE '%k%7%' ORDER BY ts DESC, m LIMIT 100",
    "fingerprint_dedup": r"""WITH f AS (SELECT doc_id, text, regexp_extract(text, '(?:Caused by:\s*)?([\w.]+(?:Exception|Error|Throwable))[:\s]', 1) AS e, len(regexp_extract_all(text, 'at\s+([\w.]+)\.([\w]+|<[\w]+>)\([\w.]+:\d+\)')) AS n FROM documents WHERE text <> '')
SELECT CASE WHEN e = '' THEN md5(text) ELSE md5(e || '|') END AS fingerprint, count(*) AS occurrences, min(doc_id) AS first_id FROM f GROUP BY 1""",
    "fingerprint_traces": "SELECT md5('java.lang.E' || (user_id % 5) || 'Exception|a.b.C' || (event_id % 3) || '.m|') AS fingerprint, count(*) AS occurrences, min(event_id) AS first_id FROM events GROUP BY 1",
    "message_dedup": "SELECT min(conv_id * 1000 + turn) AS id FROM conversations GROUP BY text",
    "silent_catch": f"WITH {_SPANS} SELECT span_id, event_type <> 'error' AND k % 2 = 0 AND k % 5 <> 0 AND k % 7 <> 0 AS suspected FROM spans",
    "trace_report": f"WITH {_SPANS}, t AS (SELECT trace_id, span_id, duration, row_number() OVER (PARTITION BY trace_id ORDER BY duration DESC, span_id) AS place FROM spans) SELECT t.trace_id, place, t.span_id, t.duration, round(100 * t.duration / greatest(roots.duration, 1.0::DOUBLE), 4) AS percent FROM t JOIN roots USING (trace_id) WHERE place <= 5",
    "trace_summary": f"""WITH {_SPANS} SELECT s.trace_id, any_value(r.event_type) AS operation, any_value(r.event_type) <> 'error' AS success, any_value(r.duration) AS duration, count(*) AS n_spans, count(*) FILTER (s.k % 3 = 0) AS matched,
coalesce(string_agg(s.span_id::VARCHAR, ',' ORDER BY s.ts, s.span_id) FILTER (s.event_type = 'error'), '') AS errors FROM spans s JOIN roots r ON r.trace_id = s.trace_id GROUP BY 1""",
    "trace_choice": f"""WITH {_SPANS}, per AS (SELECT trace_id % 10 AS session, trace_id, min(ts) AS t, trace_id IN (SELECT trace_id FROM free WHERE k % 7 <> 0) AS e FROM spans GROUP BY 1, 2)
SELECT session, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY e DESC, t DESC, trace_id DESC) AS n FROM per) WHERE n = 1""",
    "span_tree": """WITH RECURSIVE e AS (SELECT event_id // 20 AS trace_id, event_id AS span_id, CASE WHEN event_id % 20 > 0 THEN (event_id - 1) // 2 END AS p FROM events), l AS (SELECT a.trace_id, a.span_id, b.span_id AS parent FROM e a LEFT JOIN e b ON a.trace_id = b.trace_id AND a.p = b.span_id),
t AS (SELECT *, 0 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.*, depth + 1 FROM l JOIN t ON l.trace_id = t.trace_id AND l.parent = t.span_id) SELECT trace_id, span_id, parent, depth FROM t""",
    "log_poll": "WITH p AS (SELECT ts, event_type || ':' || props AS message FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-19 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, message LIMIT 100) SELECT message, max(ts) AS at, count(*) AS n FROM p GROUP BY 1",
    "stage_states": """WITH a AS (SELECT o_custkey AS run, o_orderpriority AS stage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS k, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'RUNNING' END AS state FROM orders)
SELECT run, stage, state, CASE WHEN state = 'FAILED' THEN list_extract([5, 15, 60], k) END AS retry_after FROM (SELECT *, max(k) OVER (PARTITION BY run, stage) AS m FROM a) WHERE k = m""",
    "occurrences": "SELECT md5(event_type || ' ' || (user_id % 7)) AS fingerprint, count(*) AS occurrences FROM events GROUP BY 1",
    "rate_by_window": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "trace_order": "SELECT user_id AS trace_id, min(ts) AS first_at, count(*) AS spans, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "error_index": "SELECT trace_id, span_id FROM (SELECT user_id AS trace_id, event_id AS span_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE event_type = 'error') WHERE k <= 5",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "retention": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 72 HOUR",
    "page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "seq_per_session": "WITH l AS (SELECT conv_id, max(turn + 1) AS m FROM conversations WHERE turn <= 1 GROUP BY 1) SELECT c.conv_id, turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) + coalesce(m, 0) AS seq FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id WHERE turn > 1",
    "batch_window": "SELECT event_id, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / sum(event_id % 9 + 1) OVER w, 6) AS error_rate, round(sum(event_id % 300) OVER w / sum(event_id % 9 + 1) OVER w, 6) AS millis_per_item FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
    "queue_position": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ahead FROM orders WHERE o_orderstatus = 'P'",
    "snowflake": "SELECT o_orderkey, (x >> 22) + 1704067200000 AS millis, (x >> 17) & 31 AS centre, (x >> 12) & 31 AS worker, x & 4095 AS sequence FROM (SELECT o_orderkey, o_orderkey * 123456789 AS x FROM orders)",
    "json_fields": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
}
