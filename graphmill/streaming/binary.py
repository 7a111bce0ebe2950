"""Trace exports in the binary wire format, decoded to the same nested rows as the JSON ones."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .spans import PAYLOAD

# The numbers of the fields of the public trace protocol that are read.
_REQUEST, _RESOURCE_SPANS, _SCOPE_SPANS, _RESOURCE, _SCOPE = {1: "resourceSpans"}, {1: "resource", 2: "scopeSpans"}, {1: "scope", 2: "spans"}, {1: "attributes"}, {1: "name", 2: "version"}
_SPAN = {1: "traceId", 2: "spanId", 4: "parentSpanId", 5: "name", 6: "kind", 7: "startTimeUnixNano", 8: "endTimeUnixNano", 9: "attributes", 11: "events", 15: "status"}
_EVENT, _STATUS, _KEY_VALUE, _ANY = {1: "timeUnixNano", 2: "name", 3: "attributes"}, {2: "message", 3: "code"}, {1: "key", 2: "value"}, {1: "stringValue", 2: "boolValue", 3: "intValue"}


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than ten bytes")


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value): a number, eight or four bytes as a number, or a stretch of bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                raise ValueError("cut short")
            value, at = struct.unpack_from("<Q" if kind == 1 else "<I", data, at)[0], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("cut short")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _text(value: memoryview) -> str:
    return bytes(value).decode("utf-8", "replace")


def _attribute(data: memoryview) -> dict:
    out = {"key": "", "value": None}
    for n, value in _fields(data):
        if n == 1:
            out["key"] = _text(value)
        elif n == 2:
            out["value"] = dict.fromkeys(_ANY.values())
            for m, x in _fields(value):
                if m in _ANY:
                    out["value"][_ANY[m]] = _text(x) if m == 1 else bool(x) if m == 2 else str(x - (1 << 64) if x >> 63 else x)
    return out


def _message(data: memoryview, names: dict[int, str], lists: dict, one: dict) -> dict:
    """A message: fields of lists gathered, of one read by their function, others left out."""
    out = {name: [] for name in lists} | dict.fromkeys(set(names.values()) - set(lists))
    for n, value in _fields(data):
        name = names.get(n)
        if name in lists:
            out[name].append(lists[name](value))
        elif name:
            out[name] = one[name](value)
    return out


def _span(data: memoryview) -> dict:
    event = lambda d: _message(d, _EVENT, {"attributes": _attribute}, {"timeUnixNano": str, "name": _text})
    status = lambda d: _message(d, _STATUS, {}, {"message": _text, "code": int})
    ids = lambda v: bytes(v).hex()
    return _message(data, _SPAN, {"attributes": _attribute, "events": event}, {"traceId": ids, "spanId": ids, "parentSpanId": ids, "name": _text, "kind": int, "startTimeUnixNano": str, "endTimeUnixNano": str, "status": status})


def decoded(data: bytes) -> dict:
    """A trace export request as the JSON form's nested rows. Malformed bytes are a ValueError."""
    scope = lambda d: _message(d, _SCOPE, {}, {"name": _text, "version": _text})
    scope_spans = lambda d: _message(d, _SCOPE_SPANS, {"spans": _span}, {"scope": scope})
    resource = lambda d: _message(d, _RESOURCE, {"attributes": _attribute}, {})
    try:
        return _message(memoryview(data), _REQUEST, {"resourceSpans": lambda d: _message(d, _RESOURCE_SPANS, {"scopeSpans": scope_spans}, {"resource": resource})}, {})
    except (IndexError, TypeError, struct.error) as e:
        raise ValueError(f"malformed: {e}") from e


def decode_payloads(rows: DataFrame) -> DataFrame:
    """resourceSpans (as spans.PAYLOAD) and error of rows (content binary), for batches and streams: malformed content has an error and no spans, null none of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                try:
                    out.append((decoded(bytes(content))["resourceSpans"] if content is not None else None, None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["resourceSpans", "error"])

    return rows.select("content").mapInPandas(run, f"{PAYLOAD}, error string")
