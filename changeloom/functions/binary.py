"""Binary forms of rows: Avro records with a schema id, row checksums, compressed payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long(n: int) -> bytes:
    """Avro's variable-length zig-zag integer."""
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_long(data: bytes, at: int) -> tuple[int, int]:
    shift = total = 0
    while True:
        b = data[at]
        at += 1
        total |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return (total >> 1) ^ -(total & 1), at


def _encode(value, kind: str) -> bytes:
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return _long(int(value))
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "boolean":
        return b"\1" if value else b"\0"
    raw = bytes(value) if kind == "binary" else str(value).encode()
    return _long(len(raw)) + raw


def _decode(data: bytes, at: int, kind: str):
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return _read_long(data, at)
    if kind == "double":
        return struct.unpack_from("<d", data, at)[0], at + 8
    if kind == "float":
        return struct.unpack_from("<f", data, at)[0], at + 4
    if kind == "boolean":
        return data[at] == 1, at + 1
    n, at = _read_long(data, at)
    raw = data[at : at + n]
    return (raw if kind == "binary" else raw.decode()), at + n


def to_avro(columns: T.StructType, schema_id: int):
    """A function of an image column: a zero byte, the schema's id and the record, every nullable field a union with null; a null image stays null."""
    kinds = [(f.name, f.dataType.simpleString(), f.nullable) for f in columns.fields]

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            parts = [b"\0", struct.pack(">i", schema_id)]
            for name, kind, nullable in kinds if row is not None else ():
                value = row[name]
                if nullable:
                    parts.append(_long(0) if value is None else _long(1))
                if value is not None:
                    parts.append(_encode(value, kind))
                elif not nullable:
                    raise ValueError(f"null in {name}")
            out.append(b"".join(parts) if row is not None else None)
        return pa.array(out, pa.binary())

    return encode


def from_avro(messages: DataFrame, columns: T.StructType, value: str = "value") -> DataFrame:
    """messages with schema_id and row, the record of each value; null stays null."""
    kinds = [(f.dataType.simpleString(), f.nullable) for f in columns.fields]
    kept, at = messages.columns, messages.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for cell in batch.column(at):
                data = cell.as_py()
                if data is None:
                    rows.append(None)
                    ids.append(None)
                    continue
                ids.append(struct.unpack_from(">i", data, 1)[0])
                place, row = 5, {}
                for f, (kind, nullable) in zip(columns.fields, kinds, strict=True):
                    there = 1
                    if nullable:
                        there, place = _read_long(data, place)
                    row[f.name] = None
                    if there:
                        row[f.name], place = _decode(data, place, kind)
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32()), pa.array(rows, arrow)], [*kept, "schema_id", "row"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(columns)
    schema = T.StructType([*messages.schema.fields, T.StructField("schema_id", T.IntegerType()), T.StructField("row", columns)])
    return messages.mapInArrow(run, schema)


def _little(value: Column) -> Column:
    """A long's eight bytes, the lowest first."""
    h = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2))))


@F.pandas_udf(T.LongType())
def _bits(value: pd.Series) -> pd.Series:
    """The bits of doubles; what isn't finite counts as zero."""
    return value.map(lambda x: struct.unpack("<q", struct.pack("<d", x if x - x == 0 else 0.0))[0])


def checksum_bytes(value: Column, kind: T.DataType) -> Column:
    """What a value adds to its row's checksum: eight bytes of numbers, texts with their length before them, nothing for null."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = _little(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = _little(_bits(F.coalesce(value.cast("double"), F.lit(0.0))))
    else:
        raw = value if isinstance(kind, T.BinaryType) else value.cast("string").cast("binary")
        size = F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")
        out = F.concat(F.unhex(F.concat(*(F.substring(size, k, 2) for k in (7, 5, 3, 1)))), raw)
    return F.when(value.isNull(), F.unhex(F.lit(""))).otherwise(out)


def row_checksum(values: Sequence[tuple[Column, T.DataType]]) -> Column:
    """CRC-32 over the bytes of a row's columns, which come in the order of their ids."""
    return F.crc32(F.concat(*(checksum_bytes(v, kind) for v, kind in values)))


def corrupted(actual: Column, expected: Column, extra: Column | None = None) -> Column:
    """Whether a row's checksum is neither the expected nor the extra one; an expected checksum of 0 isn't checked."""
    other = F.lit(False) if extra is None else F.coalesce(actual == extra, F.lit(False))
    return (expected != 0) & (actual != expected) & ~other


#: Names of codecs for payloads, and those of the library that does them.
COMPRESSIONS = {"gzip": "gzip", "zstd": "zstd", "lz4": "lz4", "bz2": "bz2"}


def compress(kind: str):
    """A function of a text or binary column; "none" leaves it as bytes."""
    if kind == "none":
        return lambda c: F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary")
    name = COMPRESSIONS[kind]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _packed(v, name) if v is not None else None)

    return lambda c: run((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _packed(value: bytes, name: str) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, name) as out:
        out.write(bytes(value))
    return sink.getvalue().to_pybytes()


def decompress(kind: str):
    """The inverse of compress, as bytes."""
    if kind == "none":
        return lambda c: F.col(c) if isinstance(c, str) else c
    name = COMPRESSIONS[kind]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: pa.CompressedInputStream(pa.BufferReader(bytes(v)), name).read() if v is not None else None)

    return run

