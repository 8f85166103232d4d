"""The object-store layout of a change feed: schema files, numbered data files, index files, and reading them back."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators.changelog import number_by_commit

#: Names in a feed's folders.
INDEX = "meta/CDC.index"
SCHEMA_FILE = re.compile(r"(?:^|/)schema_(\d+)_(\d{10})\.json$")
_DATES = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def folder(date_separator: str = "none") -> Column:
    """schema/table/version[/date] of a change; the date is that of its commit."""
    parts = [F.col("schema_name"), F.col("table_name"), F.col("table_version").cast("string")]
    if date_separator != "none":
        parts.append(F.date_format(F.timestamp_millis(F.shiftright("commit_ts", 18)), _DATES[date_separator]))
    return F.concat_ws("/", *parts)


def numbered(lines: DataFrame, rows_per_file: int, date_separator: str = "none", extension: str = "csv", first: int = 1) -> DataFrame:
    """lines with folder, place (within its folder, in commit order) and path: files of at most rows_per_file changes, numbered from `first`."""
    placed = number_by_commit(lines.withColumn("folder", folder(date_separator)), ["folder"], "place")
    number = F.lpad((F.floor((F.col("place") - 1) / rows_per_file) + first).cast("string"), 6, "0")
    return placed.withColumn("path", F.concat(F.col("folder"), F.lit("/CDC"), number, F.lit(f".{extension}")))


def definition(schema: str, table: str, columns: Sequence[tuple[str, str, bool]], keys: Sequence[str]) -> str:
    """The part of a schema file that its checksum is taken of: all but the version."""
    cells = [{"ColumnName": n, "ColumnType": t.upper(), "ColumnNullable": str(nullable).lower()} | ({"ColumnIsPk": "true"} if n in keys else {}) for n, t, nullable in columns]
    return json.dumps({"Table": table, "Schema": schema, "Version": 1, "TableColumns": cells, "TableColumnsTotal": len(cells)})


def schema_path(schema: str, table: str, version: int, text: str) -> str:
    return f"{schema}/{table}/meta/schema_{version}_{zlib.crc32(text.encode()):010d}.json"


def data_version(existing: Sequence[str], version: int, text: str) -> tuple[int, bool]:
    """(version of the data path, whether a schema file is to be written): the highest version with the same definition is used again."""
    same = [int(m[1]) for x in existing if (m := SCHEMA_FILE.search(x)) and int(m[2]) == zlib.crc32(text.encode())]
    return (max(same), False) if same else (version, True)


def data_versions(definitions: DataFrame) -> DataFrame:
    """data_version of every (schema_name, table_name, version, definition): the lowest version of a run of equal definitions names the folder.

    A version is written only if no earlier one of the table has its definition.
    """
    earlier = "PARTITION BY schema_name, table_name, sum ORDER BY version"
    marked = definitions.withColumn("sum", F.crc32(F.col("definition").cast("binary")))
    return marked.withColumn("data_version", F.expr(f"first(version) OVER ({earlier})")).withColumn("written", F.col("data_version") == F.col("version")).drop("sum")


def _target(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(lines: DataFrame, uri: str, schemas: Sequence[tuple[str, str, int, str]], rows_per_file: int = 10_000, date_separator: str = "none", extension: str = "csv") -> DataFrame:
    """Writes schema files, then index files, then data files under a URI; gives path and n of the data files.

    schemas: schema, table, version and definition.  Files are written by the tasks, each sorted and as a stream, so a file is never gathered.
    A task that runs again writes the same files.
    """
    fs, base = _target(uri)

    def put(name: str, text: str) -> None:
        path = f"{base}/{name}"
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(text.encode())

    for schema, table, version, text in schemas:
        from pyarrow.fs import FileSelector

        have = [x.path for x in fs.get_file_info(FileSelector(f"{base}/{schema}/{table}/meta", allow_not_found=True))]
        if data_version(have, version, text)[1]:
            put(schema_path(schema, table, version, text), json.dumps(json.loads(text) | {"TableVersion": version}))
    placed = numbered(lines, rows_per_file, date_separator, extension)
    last = placed.groupBy("folder").agg(F.max("path").alias("path"))  # a row for each folder
    for r in last.toLocalIterator():
        put(f"{r['folder']}/{INDEX}", r["path"].rsplit("/", 1)[1] + "\n")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _target(uri)
        now, out, done = None, None, []
        for batch in batches:
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if out:
                        out.close()
                    fs.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    now, out = path, fs.open_output_stream(f"{base}/{path}")
                    done.append([path, 0])
                out.write(line.encode() + b"\n")
                done[-1][1] += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n"])

    order = [c for c in ("path", "place", "line_no") if c in placed.columns]
    return placed.repartition("path").sortWithinPartitions(*order).select("path", "line").mapInArrow(store, "path string, n long")


def read(spark: SparkSession, uri: str, tables: Sequence[str] = ("*/*",), extension: str = "csv") -> DataFrame:
    """line, folder and number of all data files."""
    paths = [f"{uri}/{t}/*/CDC*.{extension}" for t in tables]
    out = spark.read.text(paths).select(F.col("value").alias("line"), F.input_file_name().alias("_file"))
    return out.select("line", F.regexp_extract("_file", r"([^/]+/[^/]+/[^/]+)/CDC\d+\.", 1).alias("folder"), F.regexp_extract("_file", r"CDC(\d+)\.", 1).cast("int").alias("number"))
