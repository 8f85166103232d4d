"""Files in and out: dumps, change folders of object stores, and sinks by scheme."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_dump(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """A dump with a known schema; nothing is inferred, so files are read once."""
    return spark.read.schema(schema).format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in parallel ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def schema_document(schema: str, table: str, version: int, columns: T.StructType, keys: Sequence[str]) -> str:
    """The schema file of a table version."""
    cells = [{"ColumnName": f.name, "ColumnType": f.dataType.simpleString().upper(), "ColumnNullable": str(f.nullable).lower()} | ({"ColumnIsPk": "true"} if f.name in keys else {}) for f in columns.fields]
    return json.dumps({"Table": table, "Schema": schema, "Version": 1, "TableVersion": version, "TableColumns": cells, "TableColumnsTotal": len(cells)})


def write_change_files(lines: DataFrame, path: str, date_separator: str = "none", rows_per_file: int = 0) -> None:
    """Lines in folders by schema, table and version (and date), in commit order within a file; a large table version is dealt by ranges of commit_ts."""
    parts = ["schema_name", "table_name", "table_version"]
    out = lines
    if date_separator != "none":
        form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[date_separator]
        out = out.withColumn("date", F.date_format(F.timestamp_millis(F.shiftright("commit_ts", 18)), form))
        parts.append("date")
    writer = out.repartitionByRange(*parts, "commit_ts").sortWithinPartitions(*parts, "commit_ts", "seq", "line_no").select(*parts, "line").write.mode("append").partitionBy(*parts)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).text(path)


def read_change_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def expired(paths: Sequence[str], checkpoint_date: str, days: int) -> list[str]:
    """Those paths with a date=yyyy-MM-dd part that is more than days before the checkpoint's date."""
    import datetime
    import re

    last = datetime.date.fromisoformat(checkpoint_date) - datetime.timedelta(days=days)
    return [p for p in paths if (m := re.search(r"(?:date=|/)(\d{4}-\d\d-\d\d)(?:/|$)", p)) and datetime.date.fromisoformat(m[1]) < last]


def remove_expired(spark: SparkSession, root: str, checkpoint_date: str, days: int) -> list[str]:
    """Deletes what is expired under a folder of any store, and folders that are left empty; gives the paths deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, found = fs.listFiles(path, True), []
    while listed.hasNext():
        found.append(listed.next().getPath().toString())
    gone = expired(found, checkpoint_date, days)
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(name), False)
    for name in sorted({x.rsplit("/", 1)[0] for x in gone}, key=len, reverse=True):
        parent = spark._jvm.org.apache.hadoop.fs.Path(name)
        if fs.exists(parent) and not len(fs.listStatus(parent)):
            fs.delete(parent, False)
    return gone


def write_repairs(statements: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Repair statements in a folder for each chunk, sorted within it."""
    statements.repartitionByRange(chunk, "statement").sortWithinPartitions(chunk, "statement").select(chunk, "statement").write.mode("overwrite").partitionBy(chunk).text(path)


def _to(kind: str) -> Callable[..., None]:
    def write(frame: DataFrame, target: str, **options: str) -> None:
        frame.write.mode("append").format(kind).options(**options).save(target)

    return write


#: Writers by scheme: brokers and databases need their connector on the class path.
SINKS: dict[str, Callable[..., None]] = {
    **dict.fromkeys(("file", "s3", "gcs", "gs", "azblob", "azure"), _to("parquet")),
    **dict.fromkeys(("blackhole", "noop"), lambda frame, target="", **_: frame.write.mode("overwrite").format("noop").save()),
    **dict.fromkeys(("kafka", "kafka+ssl"), lambda frame, target, **o: frame.select("topic", "partition", "key", "value").write.format("kafka").options(**{"kafka.bootstrap.servers": target} | o).save()),
    **dict.fromkeys(("pulsar", "pulsar+ssl", "pulsar+http", "pulsar+https"), lambda frame, target, **o: frame.select("topic", "key", "value").write.format("pulsar").options(**{"service.url": target} | o).save()),
    **dict.fromkeys(("mysql", "mysql+ssl", "tidb", "tidb+ssl"), lambda frame, target, **o: frame.write.mode("append").format("jdbc").options(url=target, **o).save()),
}


def sink(uri: str) -> Callable[..., None]:
    """The writer for a URI's scheme."""
    scheme = uri.partition("://")[0].lower()
    if scheme not in SINKS:
        raise ValueError(f"no sink for {scheme}")
    return SINKS[scheme]
