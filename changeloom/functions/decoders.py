"""Decoders: message columns back to changes.  What can't be read as a column's type is null; malformed messages give null images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions.codecs import from_canal_json

TERMINATOR = "\r\n"


def _image(side: Column, columns: T.StructType) -> Column:
    return F.when(side.isNotNull(), F.struct(*(side[f.name].try_cast(f.dataType).alias(f.name) for f in columns.fields)))


def _texts(columns: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in columns.fields])


def from_open_protocol(messages: DataFrame, columns: T.StructType, key: str = "key", value: str = "value") -> DataFrame:
    """Changes of open-protocol records: an update has u and p, an insert u alone, a delete d.  Watermark records (t 3) are left out."""
    cells = T.StructType([T.StructField(f.name, T.StructType().add("t", "integer").add("h", "boolean").add("v", f.dataType)) for f in columns.fields])
    head = F.from_json(key, T.StructType().add("ts", "long").add("scm", "string").add("tbl", "string").add("t", "integer"))
    body = F.from_json(value, T.StructType().add("u", cells).add("p", cells).add("d", cells))
    m = messages.withColumns({"_k": head, "_v": body}).where("_k.t = 1")

    def side(name: str) -> Column:
        whole = F.col(f"_v.{name}")
        return F.when(whole.isNotNull(), F.struct(*(whole[f.name]["v"].alias(f.name) for f in columns.fields)))

    op = F.when(F.col("_v.d").isNotNull(), "D").when(F.col("_v.p").isNotNull(), "U").otherwise("I")
    return m.select(F.col("_k.scm").alias("schema_name"), F.col("_k.tbl").alias("table_name"), op.alias("op"), F.col("_k.ts").alias("commit_ts"), F.coalesce(side("p"), side("d")).alias("before"), side("u").alias("after"))


def from_csv_lines(lines: DataFrame, columns: T.StructType, delimiter: str = ",", quote: str = '"', null: str = "\\N", include_commit_ts: bool = True, old_value: bool = False, line: str = "line") -> DataFrame:
    """Changes of csv lines; without old values U has its after image only, with them an update is a D and an I with is_update set."""
    head = T.StructType().add("_op", "string").add("_table", "string").add("_schema", "string")
    if include_commit_ts:
        head = head.add("_commit_ts", "long")
    if old_value:
        head = head.add("_is_update", "boolean")
    options = {"sep": delimiter, "quote": quote, "escape": quote or "\\", "nullValue": null, "emptyValue": ""}
    parsed = lines.withColumn("_r", F.from_csv(line, T.StructType(head.fields + columns.fields).simpleString()[7:-1].replace(":", " "), options))
    whole = F.struct(*(F.col(f"_r.{f.name}").alias(f.name) for f in columns.fields))
    op = F.col("_r._op")
    out = [F.col("_r._schema").alias("schema_name"), F.col("_r._table").alias("table_name"), op.alias("op")]
    out.append((F.col("_r._commit_ts") if include_commit_ts else F.lit(None).cast("long")).alias("commit_ts"))
    if old_value:
        out.append(F.col("_r._is_update").alias("is_update"))
    return parsed.select(*out, F.when(op == "D", whole).alias("before"), F.when(op != "D", whole).alias("after"))


def from_simple(messages: DataFrame, columns: T.StructType, known: DataFrame | None = None, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """Changes of simple messages, and messages that wait because their schema isn't in known (schema_name, table_name, table_version)."""
    shape = T.StructType().add("database", "string").add("table", "string").add("tableID", "long").add("type", "string").add("commitTs", "long").add("schemaVersion", "long").add("data", _texts(columns)).add("old", _texts(columns))
    m = messages.withColumn("_m", F.from_json(message, shape)).where("_m.type IN ('INSERT', 'UPDATE', 'DELETE')")
    waiting = m.limit(0).select(*messages.columns)
    if known is not None:
        s = known.select(F.struct("schema_name", "table_name", "table_version").alias("_known")).distinct()
        match = F.struct(F.col("_m.database"), F.col("_m.table"), F.col("_m.schemaVersion"))
        joined = m.join(s, match == F.col("_known"), "left")
        waiting, m = joined.where("_known IS NULL").select(*messages.columns), joined.where("_known IS NOT NULL")
    out = m.select(
        F.col("_m.database").alias("schema_name"), F.col("_m.table").alias("table_name"), F.col("_m.tableID").alias("table_id"), F.substring("_m.type", 1, 1).alias("op"), F.col("_m.commitTs").alias("commit_ts"),
        F.col("_m.schemaVersion").alias("table_version"), _image(F.col("_m.old"), columns).alias("before"), _image(F.col("_m.data"), columns).alias("after"),
    )
    return out, waiting


def from_maxwell(messages: DataFrame, columns: T.StructType, message: str = "message") -> DataFrame:
    """Changes of maxwell messages: old names what an update changed, the rest of its before image is that of data."""
    shape = T.StructType().add("database", "string").add("table", "string").add("type", "string").add("ts", "long").add("data", columns).add("old", columns)
    m = messages.withColumns({"_m": F.from_json(message, shape), "_changed": F.coalesce(F.json_object_keys(F.get_json_object(message, "$.old")), F.array().cast("array<string>"))})
    data = F.col("_m.data")
    old = F.struct(*(F.when(F.array_contains("_changed", f.name), F.col("_m.old")[f.name]).otherwise(data[f.name]).alias(f.name) for f in columns.fields))
    op = F.upper(F.substring("_m.type", 1, 1))
    return m.select(F.col("_m.database").alias("schema_name"), F.col("_m.table").alias("table_name"), op.alias("op"), F.col("_m.ts").alias("ts"), F.when(op == "D", data).when(op == "U", old).alias("before"), F.when(op != "D", data).alias("after"))


def canal_json_files(messages: DataFrame, rows: int, order: Sequence[Column], message: str = "message") -> DataFrame:
    """file, n, content: messages in order, each with the terminator, `rows` in a file at most, as object stores get them.

    order starts with what numbers the messages (position from 1), so a file is found without sorting them all in a task.
    """
    cells = F.array_sort(F.collect_list(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), F.col(message).alias("m"))))
    files = messages.groupBy(F.floor((order[0] - 1) / rows).alias("file")).agg(cells.alias("c"))
    return files.select("file", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: F.concat(x["m"], F.lit(TERMINATOR))), "").alias("content"))


def from_canal_json_files(files: DataFrame, columns: T.StructType, content: str = "content") -> DataFrame:
    """Changes of all messages of files."""
    parts = files.select(F.explode(F.split(content, TERMINATOR)).alias("message")).where("message <> ''")
    return from_canal_json(parts, columns)
