"""Canal's binary packets: changes as entries of the public protocol, written and read field by field.

A packet holds messages, a message is an entry with a header and a row change, whose columns carry their values as texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions.codecs import SQL_TYPES

#: Numbers of event types, and of the fields of the protocol's messages that are written.
EVENTS = {"I": 1, "U": 2, "D": 3}
PACKET = {"magic": 1, "version": 2, "type": 3, "body": 5}
MESSAGES, PACKET_TYPE, MAGIC, VERSION = 2, 7, 17, 1
ENTRY = {"header": 1, "type": 2, "value": 3}
HEADER = {"version": 1, "encoding": 5, "time": 6, "source": 7, "schema": 8, "table": 9, "event": 11}
ROW_CHANGE = {"event": 2, "ddl": 10, "sql": 11, "rows": 12}
ROW = {"before": 1, "after": 2}
COLUMN = {"index": 1, "sql_type": 2, "name": 3, "key": 4, "updated": 5, "null": 6, "value": 8, "mysql_type": 10}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | bool | str | bytes) -> bytes:
    """A field: numbers as variable-length integers, texts and bytes with their length."""
    if isinstance(value, (bool, int)):
        return _varint(number << 3) + _varint(int(value))
    raw = value.encode() if isinstance(value, str) else bytes(value)
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return out, at


def fields(data: bytes) -> dict[int, list]:
    """The fields of a message by number, each as often as it occurs."""
    out, at = {}, 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        elif tag & 7 == 2:
            n, at = _number(data, at)
            value, at = data[at : at + n], at + n
        elif tag & 7 in (1, 5):
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("no such wire type")
        out.setdefault(tag >> 3, []).append(value)
    return out


def _column(index: int, name: str, kind: str, key: bool, value: str | None, updated: bool) -> bytes:
    number, mysql = SQL_TYPES.get(kind, (12, "varchar"))
    parts = [(COLUMN["index"], index), (COLUMN["sql_type"], number), (COLUMN["name"], name), (COLUMN["key"], key), (COLUMN["updated"], updated), (COLUMN["null"], value is None), (COLUMN["value"], value or ""), (COLUMN["mysql_type"], mysql)]
    return b"".join(field(n, v) for n, v in parts)


def _image(row: dict[str, str | None] | None, number: int, kinds: Sequence[tuple[str, str]], keys: Sequence[str], other: dict | None) -> bytes:
    if row is None:
        return b""
    return b"".join(field(number, _column(k, n, t, n in keys, row[n], other is None or other[n] != row[n])) for k, (n, t) in enumerate(kinds))


def canal_packets(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """log with value: each change as a packet of one message."""
    kinds = [(f.name, f.dataType.simpleString()) for f in log.schema["after"].dataType.fields]

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            event = EVENTS[r["op"]]
            row = _image(r["before"], ROW["before"], kinds, keys, None) + _image(r["after"], ROW["after"], kinds, keys, r["before"])
            change = field(ROW_CHANGE["event"], event) + field(ROW_CHANGE["ddl"], False) + field(ROW_CHANGE["rows"], row)
            header = [("version", VERSION), ("encoding", "UTF-8"), ("time", r["commit_ts"] >> 18), ("source", 1), ("schema", r["schema_name"]), ("table", r["table_name"]), ("event", event)]
            entry = field(ENTRY["header"], b"".join(field(HEADER[n], v) for n, v in header)) + field(ENTRY["type"], 2) + field(ENTRY["value"], change)
            body = field(MESSAGES, entry)
            out.append(field(PACKET["magic"], MAGIC) + field(PACKET["version"], VERSION) + field(PACKET["type"], PACKET_TYPE) + field(PACKET["body"], body))
        return pa.array(out, pa.binary())

    def texts(side: str):
        return F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.{n}").cast("string").alias(n) for n, _ in kinds))).alias(side)

    return log.withColumn("value", encode(F.struct("op", "commit_ts", "schema_name", "table_name", texts("before"), texts("after"))))


def from_canal_packets(packets: DataFrame, columns: T.StructType, value: str = "value") -> DataFrame:
    """schema_name, table_name, op, execute_ms, before, after of all rows of all packets; values are cast to the columns' types."""
    names, ops = [f.name for f in columns.fields], {v: k for k, v in EVENTS.items()}
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])
    schema = T.StructType().add("schema_name", "string").add("table_name", "string").add("op", "string").add("execute_ms", "long").add("before", strings).add("after", strings)

    def image(cells: list[bytes]) -> dict | None:
        out = dict.fromkeys(names)
        for cell in cells:
            f = fields(cell)
            name = f[COLUMN["name"]][0].decode()
            if name in out:
                out[name] = None if f[COLUMN["null"]][0] else f[COLUMN["value"]][0].decode()
        return out if cells else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for cell in batch.column(0).to_pylist():
                for message in fields(fields(cell)[PACKET["body"]][0])[MESSAGES] if cell else ():
                    entry = fields(message)
                    header, change = fields(entry[ENTRY["header"]][0]), fields(entry[ENTRY["value"]][0])
                    for row in change.get(ROW_CHANGE["rows"], []):
                        own = fields(row)
                        rows.append((header[HEADER["schema"]][0].decode(), header[HEADER["table"]][0].decode(), ops[change[ROW_CHANGE["event"]][0]], header[HEADER["time"]][0], image(own.get(ROW["before"], [])), image(own.get(ROW["after"], []))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow_schema(schema))

    def typed(side: str):
        return F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.{f.name}").try_cast(f.dataType).alias(f.name) for f in columns.fields))).alias(side)

    return packets.select(value).mapInArrow(run, schema).select("schema_name", "table_name", "op", "execute_ms", typed("before"), typed("after"))
