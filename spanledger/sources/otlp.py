"""Trace export requests in protobuf's wire format, brought into OTLP's JSON form, which ingest.decode_otlp() takes apart in columns."""

from __future__ import annotations

import base64
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.operators import ingest

#: Field numbers of each message: JSON name, kind (a message's name, or a scalar), repeated.
MESSAGES = {
    "Request": {1: ("resourceSpans", "ResourceSpans", True)},
    "ResourceSpans": {1: ("resource", "Resource", False), 2: ("scopeSpans", "ScopeSpans", True)},
    "Resource": {1: ("attributes", "KeyValue", True)},
    "ScopeSpans": {1: ("scope", "Scope", False), 2: ("spans", "Span", True)},
    "Scope": {1: ("name", "text", False)},
    "Span": {
        1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 4: ("parentSpanId", "hex", False), 5: ("name", "text", False), 7: ("startTimeUnixNano", "fixed64", False), 8: ("endTimeUnixNano", "fixed64", False),
        9: ("attributes", "KeyValue", True), 11: ("events", "Event", True), 15: ("status", "Status", False),
    },
    "Event": {1: ("timeUnixNano", "fixed64", False), 2: ("name", "text", False), 3: ("attributes", "KeyValue", True)},
    "Status": {2: ("message", "text", False), 3: ("code", "enum", False)},
    "KeyValue": {1: ("key", "text", False), 2: ("value", "AnyValue", False)},
    "AnyValue": {1: ("stringValue", "text", False), 2: ("boolValue", "bool", False), 3: ("intValue", "int64", False), 4: ("doubleValue", "double", False), 5: ("arrayValue", "ArrayValue", False), 6: ("kvlistValue", "KvList", False), 7: ("bytesValue", "base64", False)},
    "ArrayValue": {1: ("values", "AnyValue", True)},
    "KvList": {1: ("values", "KeyValue", True)},
}
#: Wire types by kind; messages and all others have a length.
_WIRE = {"fixed64": 1, "double": 1, "enum": 0, "bool": 0, "int64": 0}
#: Values may hold values; what is deeper than this is torn or hostile.
MAX_NESTING = 32


class WireError(ValueError):
    pass


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("a number ends too late")
        out |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return out & (1 << 64) - 1, at


def _take(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    if at + size > len(data):
        raise WireError("a field is longer than what is left")
    return data[at : at + size], at + size


def _value(kind: str, raw: bytes | int, nesting: int):
    if kind in MESSAGES:
        return message(raw, kind, nesting + 1)
    if kind == "text":
        return raw.decode("utf-8")
    if kind == "hex":
        return raw.hex()
    if kind == "base64":
        return base64.b64encode(raw).decode()
    if kind == "fixed64":
        return str(int.from_bytes(raw, "little"))
    if kind == "double":
        return struct.unpack("<d", raw)[0]
    if kind == "bool":
        return bool(raw)
    if kind == "enum":
        return raw
    return str(raw - (1 << 64) if raw >> 63 else raw)


def message(data: bytes, kind: str = "Request", nesting: int = 0) -> dict:
    """A message as its JSON form. Fields that are not known are skipped; a field's last value counts."""
    if nesting > MAX_NESTING:
        raise WireError("too deeply nested")
    fields, out, at = MESSAGES[kind], {}, 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire == 1:
            raw, at = _take(data, at, 8)
        elif wire == 2:
            size, at = _varint(data, at)
            raw, at = _take(data, at, size)
        elif wire == 5:
            raw, at = _take(data, at, 4)
        else:
            raise WireError(f"unknown wire type {wire}")
        if number in fields:
            name, what, repeated = fields[number]
            if _WIRE.get(what, 2) != wire:
                raise WireError(f"{kind}.{name} has wire type {wire}")
            value = _value(what, raw, nesting)
            if repeated:
                out.setdefault(name, []).append(value)
            else:
                out[name] = value
    return out


def as_json(body: Column) -> Column:
    """A protobuf request as (json, error): a torn body has an error and no JSON; null gives nulls.

    A filter on what a function of Python tells would be moved below it, and each request be read by two workers of a task, but for asNondeterministic().
    """

    @F.pandas_udf("json string, error string")
    def decoded(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for data in bodies:
            try:
                rows.append((None if data is None else json.dumps(message(bytes(data)), ensure_ascii=False), None))
            except ValueError as error:  # WireError, or a text that isn't UTF-8
                rows.append((None, str(error) or type(error).__name__))
        return pd.DataFrame(rows, columns=["json", "error"])

    return decoded.asNondeterministic()(body)


def decode_protobuf(requests: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(spans as ingest.decode_otlp gives them; the requests that can't be read, with all their columns and `error`)."""
    read = requests.withColumn("_read", as_json(F.col(column)))
    spans = ingest.decode_otlp(read.where("_read.error is null").select(F.col("_read.json").alias("body")))
    return spans, read.where("_read.error is not null").select(*requests.columns, F.col("_read.error").alias("error"))


def encoded(value: dict, kind: str = "Request") -> bytes:
    """A JSON form as a message; the inverse of message() for what it knows."""
    out = bytearray()

    def varint(n: int) -> bytes:
        n, made = n & (1 << 64) - 1, bytearray()
        while n > 0x7F:
            made.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*made, n])

    for number, (name, what, repeated) in MESSAGES[kind].items():
        for one in (value.get(name) or []) if repeated else [value[name]] if value.get(name) is not None else []:
            out += varint(number << 3 | _WIRE.get(what, 2))
            if what in ("enum", "bool", "int64"):
                out += varint(int(one))
            elif what == "fixed64":
                out += int(one).to_bytes(8, "little")
            elif what == "double":
                out += struct.pack("<d", one)
            else:
                raw = encoded(one, what) if what in MESSAGES else {"text": lambda v: v.encode(), "hex": bytes.fromhex, "base64": base64.b64decode}[what](one)
                out += varint(len(raw)) + raw
    return bytes(out)
