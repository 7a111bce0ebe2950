"""Streams with state, several sinks of one stream, binary payloads."""

import json
import struct

import pytest
from graphmill.operators import telemetry
from graphmill.streaming import binary, error_index, sinks, spans
from pyspark.sql import functions as F
from test_operators import payload

SPAN = "trace_id string, span_id string, at timestamp, detail string"


def fed(spark, folder, batches):
    """Files that a stream takes one a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(t, s, f"2024-01-01 {at}", d) for t, s, at, d in rows], "trace_id string, span_id string, at string, detail string").coalesce(1).write.mode("append").json(f"{folder}/{k}")
    return lambda n: spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).json(f"{folder}/{{{','.join(map(str, range(n)))}}}" if n > 1 else f"{folder}/0")


def run(spark, frame, out, checkpoint):
    q = frame.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_error_index(spark, rocks, tmp_path):
    """Caps a trace and the traces, repeats, a late span, expiry; stopped after two batches and gone on with."""
    batches = [
        [("a", f"s{k}", f"00:00:{k:02d}", "x") for k in range(5)] + [("a", "s0", "00:00:09", "again"), ("b", "s1", "00:00:20", None), (None, "s", "00:00:21", "no trace"), ("b", None, "00:00:21", "no span")],
        [("c", "s1", "00:01:00", "c1"), ("a", "s9", "00:01:01", "over the cap"), ("d", "s1", "00:02:00", "evicts b, the trace seen longest ago")],
        [("e", "s1", "05:00:00", "much later")],
        [("f", "s1", "00:00:01", "too late"), ("e", "s2", "05:01:00", "more")],
        [("g", "s1", "05:02:00", "last")],
    ]
    source = fed(spark, tmp_path / "in", batches)
    index = lambda n: error_index.error_index(source(n), per_trace=3, traces=3, ttl_ms=3_600_000, late="1 minute")
    for n in (2, 5):
        run(spark, index(n), f"{tmp_path}/out", f"{tmp_path}/check")
    changes = spark.read.parquet(f"{tmp_path}/out")
    events = {(r["trace_id"], r["span_id"], r["change"]) for r in changes.collect()}
    added = {("a", "s0"), ("a", "s1"), ("a", "s2"), ("b", "s1"), ("c", "s1"), ("d", "s1"), ("e", "s1"), ("e", "s2"), ("g", "s1")}
    assert {e[:2] for e in events if e[2] == "ADD"} == added
    gone = {e for e in events if e[2] != "ADD"}
    assert ("b", "s1", "EVICT") in gone and {e[0] for e in gone} == {"a", "b", "c", "d"} and len(gone) == 6
    assert {(r["trace_id"], r["span_id"]) for r in error_index.indexed(changes).collect()} == {("e", "s1"), ("e", "s2"), ("g", "s1")}


def test_sinks_after_a_kill(spark, tmp_path):
    """The second sink fails in the first run; the same batch is run again, and every table has each row once."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(payload([None, "X", None])))
    sessions = spark.createDataFrame([("svc", "s1")], "service string, session_id string")
    methods = spark.createDataFrame([(7, "", "op1")], "node int, class_name string, method_name string")
    tables, fail = sinks.span_sinks(methods), [True]

    def errors(rows, own=tables["errors"]):
        if fail:
            fail.clear()
            raise RuntimeError("killed")
        return own(rows)

    tables["errors"] = errors
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")

    def stream():
        out = spans.ingest(spans.read_payloads(spark, str(tmp_path / "in")), sessions)
        return out.writeStream.foreachBatch(sinks.into_all(folder, tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        stream().awaitTermination()
    assert spark.read.parquet(f"{folder}/spans").count() == 3  # written, but no batch is committed
    assert not (tmp_path / "out/_log").exists()
    stream().awaitTermination()
    (tmp_path / "in/b.json").write_text(json.dumps(payload(["Y"])))
    stream().awaitTermination()
    stream().awaitTermination()
    count = {name: sinks.committed(spark, folder, name).count() for name in tables}
    assert count == {"spans": 4, "silent": 2, "errors": 2, "located": 1, "push": 2}
    assert sinks.committed(spark, folder, "spans").where("span_id = '1'").count() == 1
    sinks.into_all(folder, tables)(sinks.committed(spark, folder, "spans").where("span_id = '1'"), 0)  # a batch run again replaces its rows
    assert sinks.committed(spark, folder, "spans").count() == 2


def _varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(n, value):
    if isinstance(value, bytes):
        return _varint(n << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):  # eight bytes
        return _varint(n << 3 | 1) + struct.pack("<Q", int(value))
    return _varint(n << 3) + _varint(value)


def _encoded(request):
    def attribute(a):
        v = a["value"]
        x = _field(1, v["stringValue"].encode()) if "stringValue" in v else _field(3, int(v["intValue"])) if "intValue" in v else _field(2, int(v["boolValue"]))
        return _field(1, a["key"].encode()) + _field(2, x)

    def span(s):
        out = _field(1, bytes.fromhex(s["traceId"])) + _field(2, bytes.fromhex(s["spanId"])) + _field(5, s["name"].encode()) + _field(6, s["kind"]) + _field(7, float(s["startTimeUnixNano"])) + _field(8, float(s["endTimeUnixNano"]))
        out += _field(4, bytes.fromhex(s["parentSpanId"])) if s["parentSpanId"] else b""
        out += b"".join(_field(9, attribute(a)) for a in s["attributes"]) + _field(99, b"unknown")
        out += b"".join(_field(11, _field(1, float(e["timeUnixNano"])) + _field(2, e["name"].encode()) + b"".join(_field(3, attribute(a)) for a in e["attributes"])) for e in s["events"])
        return out + _field(15, _field(2, s["status"]["message"].encode()) + _field(3, s["status"]["code"]))

    return b"".join(
        _field(1, _field(1, b"".join(_field(1, attribute(a)) for a in r["resource"]["attributes"])) + b"".join(_field(2, _field(1, _field(1, x["scope"]["name"].encode())) + b"".join(_field(2, span(s)) for s in x["spans"])) for x in r["scopeSpans"])) for r in request["resourceSpans"]
    )


def test_binary_payloads(spark):
    """The same spans as their JSON form; malformed content to the side."""
    request = payload([None, "X", "Y"])
    for k, s in enumerate(request["resourceSpans"][0]["scopeSpans"][0]["spans"]):
        s.update(traceId="0a" * 16, spanId=f"{k:016x}", parentSpanId=f"{k - 1:016x}" if k else "", endTimeUnixNano=str(10**18 + k))
        s["attributes"] = [{"key": "n", "value": {"intValue": str(-(2**62) + k)}}, {"key": "ok", "value": {"boolValue": k == 1}}, {"key": "ü", "value": {"stringValue": "日"}}]
        s["status"] = {"code": k, "message": "m"}
    data = _encoded(request)
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-3]),), (bytearray(b"\xff" * 20),), (bytearray(b"\x0b"),), (bytearray(b""),), (None,)], "content binary").repartition(2)
    got = binary.decode_payloads(rows).cache()
    assert got.where("error is not null").count() == 3 and got.where("error is null").count() == 3
    plain = spark.read.schema(spans.PAYLOAD).json(spark.sparkContext.parallelize([json.dumps(request)]))
    text = lambda df: sorted(r[0] for r in telemetry.flatten_spans(df).select(F.to_json(F.struct("*"))).collect())
    assert text(got.where("error is null")) == text(plain) and len(text(plain)) == 3
