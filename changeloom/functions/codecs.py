"""Change-event formats as columns: encoders give a message text for each change, decoders give changes back."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_NULLS = {"ignoreNullFields": "false"}
#: JDBC type numbers and MySQL names by type.
SQL_TYPES = {"int": (4, "int"), "bigint": (-5, "bigint"), "double": (8, "double"), "float": (7, "float"), "string": (12, "varchar"), "timestamp": (93, "timestamp"), "date": (91, "date"), "boolean": (-6, "tinyint"), "binary": (2004, "blob")}
#: Column types of the open protocol by type.
OPEN_TYPES = {"int": 3, "bigint": 8, "double": 5, "float": 4, "string": 15, "timestamp": 7, "date": 10, "boolean": 1, "binary": 252}

#: The extension field of canal-json and the type of its watermark record.
EXTENSION, WATERMARK_TYPE = "_tidb", "TIDB_WATERMARK"


def _types(log: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in log.schema["after"].dataType.fields}


def texts(side: str, columns: dict[str, str]) -> Column:
    """An image as a struct of texts, null where the image is."""
    return F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.{c}").cast("string").alias(c) for c in columns)))


def canal_json(log: DataFrame, keys: Sequence[str], extension: bool = True, keys_only: bool = False) -> Column:
    """canal-json: data and old hold texts only; a delete carries its before image in data.

    keys_only: only handle keys are sent, as the whole message was too large, and the extension says so.
    """
    columns = {c: t for c, t in _types(log).items() if not keys_only or c in keys}
    data = F.coalesce(texts("after", columns), texts("before", columns))
    fields = [
        F.lit(0).alias("id"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), F.array(*map(F.lit, keys)).alias("pkNames"), F.lit(False).alias("isDdl"),
        F.when(F.col("op") == "I", "INSERT").when(F.col("op") == "U", "UPDATE").otherwise("DELETE").alias("type"), F.shiftright("commit_ts", 18).alias("es"), F.lit("").alias("sql"),
        F.struct(*(F.lit(SQL_TYPES.get(t, (12, ""))[0]).alias(c) for c, t in columns.items())).alias("sqlType"), F.struct(*(F.lit(SQL_TYPES.get(t, (12, "varchar"))[1]).alias(c) for c, t in columns.items())).alias("mysqlType"),
        F.array(data).alias("data"), F.when(F.col("op") == "U", F.array(texts("before", columns))).alias("old"),
    ]
    if extension:
        own = [F.col("commit_ts").alias("commitTs"), *([F.lit(True).alias("onlyHandleKey")] if keys_only else [])]
        fields.append(F.struct(*own).alias(EXTENSION))
    return F.to_json(F.struct(*fields), KEEP_NULLS)


def canal_json_within(log: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """log without images, with message: canal-json, cut to handle keys where it is over `most` bytes; an error if even that is."""
    whole, slim = canal_json(log, keys), canal_json(log, keys, keys_only=True)
    fits = F.when(F.octet_length(whole) <= most, whole).when(F.octet_length(slim) <= most, slim).otherwise(F.raise_error(F.lit("a message is too large even with its keys alone")).cast("string"))
    return log.withColumn("message", fits).drop("before", "after")


def from_canal_json(messages: DataFrame, columns: T.StructType, message: str = "message") -> DataFrame:
    """Changes of canal-json messages; texts are cast to the columns' types, what can't be cast is null."""
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in columns.fields])
    shape = T.StructType().add("database", "string").add("table", "string").add("type", "string").add("isDdl", "boolean").add("data", T.ArrayType(strings)).add("old", T.ArrayType(strings)).add(EXTENSION, T.StructType().add("commitTs", "long").add("watermarkTs", "long"))
    m = messages.withColumn("_m", F.from_json(message, shape)).where("NOT _m.isDdl AND _m.data IS NOT NULL")

    def typed(side: Column) -> Column:
        return F.when(side.isNotNull(), F.struct(*(side[f.name].try_cast(f.dataType).alias(f.name) for f in columns.fields)))

    data, old = typed(F.col("_m.data")[0]), typed(F.col("_m.old")[0])
    op = F.substring("_m.type", 1, 1)
    return m.select(F.col("_m.database").alias("schema_name"), F.col("_m.table").alias("table_name"), op.alias("op"), F.col(f"_m.{EXTENSION}.commitTs").alias("commit_ts"), F.when(op == "D", data).when(op == "U", old).alias("before"), F.when(op != "D", data).alias("after"))


def canal_json_ddl(type_name: Column | None = None) -> Column:
    """canal-json of DDLs (schema_name, table_name, query, commit_ts): the type is the statement's first word unless given."""
    kind = F.upper(F.split(F.trim("query"), r"\s+")[0]) if type_name is None else type_name
    none = F.lit(None).cast("string")
    fields = [F.lit(0).alias("id"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), none.alias("pkNames"), F.lit(True).alias("isDdl"), kind.alias("type"), F.shiftright("commit_ts", 18).alias("es"), F.col("query").alias("sql")]
    fields += [none.alias(x) for x in ("sqlType", "mysqlType", "data", "old")]
    return F.to_json(F.struct(*fields, F.struct(F.col("commit_ts").alias("commitTs")).alias(EXTENSION)), KEEP_NULLS)


def open_protocol_ddl() -> tuple[Column, Column]:
    """Key {ts, scm, tbl, t: 2} and value {q, t} of DDLs with the number of their type."""
    key = F.to_json(F.struct(F.col("commit_ts").alias("ts"), F.col("schema_name").alias("scm"), F.col("table_name").alias("tbl"), F.lit(2).alias("t")))
    return key, F.to_json(F.struct(F.col("query").alias("q"), F.col("type_number").alias("t")))


def vector_text(value: Column) -> Column:
    """A vector as [a,b,...]."""
    return F.concat(F.lit("["), F.array_join(value.cast("array<string>"), ",", "null"), F.lit("]"))


def vector_from_text(text: Column, kind: T.DataType) -> Column:
    """The vector of a text; null if it is none."""
    return F.when(text.rlike(r"^\[.*\]$"), F.transform(F.filter(F.split(F.substr(text, F.lit(2), F.length(text) - 2), ","), lambda x: x != ""), lambda x: x.try_cast(kind)))


def open_protocol(log: DataFrame, keys: Sequence[str]) -> tuple[Column, Column]:
    """Key and value of the open protocol: {ts, scm, tbl, t} and {u} with {p} for updates, or {d}; columns as {t, h, f, v}, in name order."""
    columns = dict(sorted(_types(log).items()))

    def side(name: str) -> Column:
        cells = [F.struct(F.lit(OPEN_TYPES.get(t, 15)).alias("t"), F.lit(True if c in keys else None).cast("boolean").alias("h"), F.lit(11 if c in keys else 0).alias("f"), F.col(f"{name}.{c}").alias("v")).alias(c) for c, t in columns.items()]
        return F.when(F.col(name).isNotNull(), F.struct(*cells))

    key = F.to_json(F.struct(F.col("commit_ts").alias("ts"), F.col("schema_name").alias("scm"), F.col("table_name").alias("tbl"), F.lit(1).alias("t")))
    value = F.to_json(F.struct(side("after").alias("u"), F.when(F.col("op") == "U", side("before")).alias("p"), F.when(F.col("op") == "D", side("before")).alias("d")))
    return key, value


def _csv_cell(value: Column, kind: str, quote: str, delimiter: str, null: str, binary: str = "base64") -> Column:
    if kind == "binary":
        return F.coalesce(F.base64(value) if binary == "base64" else F.lower(F.hex(value)), F.lit(null))
    text = value.cast("string")
    if kind in ("string", "timestamp", "date"):
        if quote:
            text = F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
        else:
            for plain, escaped in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), (delimiter, "\\" + delimiter)):
                text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(text, F.lit(null))


def csv_lines(log: DataFrame, delimiter: str = ",", quote: str = '"', null: str = "\\N", include_commit_ts: bool = True, old_value: bool = False, binary: str = "base64") -> DataFrame:
    """One line for each change: op, table, schema, commit_ts, (is_update,) columns; with old_value an update is a D and an I line.

    binary: bytes as base64 or hex.
    """
    columns = _types(log)
    own = log
    if old_value:
        parts = F.array(F.struct(F.lit("D").alias("k"), F.col("before").alias("image"), F.lit(0).alias("n")), F.struct(F.lit("I").alias("k"), F.col("after").alias("image"), F.lit(1).alias("n")))
        one = F.array(F.struct(F.col("op").alias("k"), F.coalesce("after", "before").alias("image"), F.lit(0).alias("n")))
        own = own.withColumn("_p", F.explode(F.when(F.col("op") == "U", parts).otherwise(one)))
    else:
        own = own.withColumn("_p", F.struct(F.col("op").alias("k"), F.coalesce("after", "before").alias("image"), F.lit(0).alias("n")))
    head = [_csv_cell(F.col(c), "string", quote, delimiter, null) for c in ("_p.k", "table_name", "schema_name")]
    if include_commit_ts:
        head.append(F.col("commit_ts").cast("string"))
    if old_value:
        head.append((F.col("op") == "U").cast("string"))
    cells = [_csv_cell(F.col(f"_p.image.{c}"), t, quote, delimiter, null, binary) for c, t in columns.items()]
    return own.withColumn("line_no", F.col("_p.n")).withColumn("line", F.concat_ws(delimiter, *head, *cells)).drop("_p")


#: Names of types in debezium's schema blocks.
_CONNECT = {"int": "int32", "bigint": "int64", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "binary": "bytes"}


def debezium_schema(columns: T.StructType, cluster: str = "default", schema: str = "", table: str = "") -> str:
    """The schema block of a table's messages: before and after have the table's fields."""
    cells = [{"type": _CONNECT.get(f.dataType.simpleString(), "string"), "optional": f.nullable, "field": f.name} for f in columns.fields]
    name = ".".join([cluster, schema, table])
    images = [{"type": "struct", "optional": True, "name": f"{name}.Value", "field": side, "fields": cells} for side in ("before", "after")]
    rest = [{"type": "string", "optional": False, "field": "op"}, {"type": "int64", "optional": True, "field": "ts_ms"}]
    return json.dumps({"type": "struct", "optional": False, "name": f"{name}.Envelope", "version": 1, "fields": images + rest}, separators=(",", ":"))


def debezium(log: DataFrame, cluster: str = "default", schema: str | None = None) -> Column:
    """payload {source, ts_ms, transaction, op, before, after} with op c, u or d, after the schema block if one is given."""
    op = F.when(F.col("op") == "I", "c").when(F.col("op") == "U", "u").otherwise("d")
    ms = F.shiftright("commit_ts", 18)
    source = F.struct(F.lit("2.4.0").alias("version"), F.lit("change_feed").alias("connector"), F.lit(cluster).alias("name"), ms.alias("ts_ms"), F.lit("false").alias("snapshot"), F.col("schema_name").alias("db"), F.col("table_name").alias("table"), F.col("commit_ts").alias("commit_ts"), F.lit(cluster).alias("cluster_id"))
    payload = F.struct(source.alias("source"), ms.alias("ts_ms"), F.lit(None).cast("string").alias("transaction"), op.alias("op"), F.when(F.col("op") != "I", F.col("before")).alias("before"), F.when(F.col("op") != "D", F.col("after")).alias("after"))
    text = F.to_json(F.struct(payload.alias("payload")), KEEP_NULLS)
    return text if schema is None else F.concat(F.lit('{"schema":' + schema + ","), F.substr(text, F.lit(2)))


def from_debezium(messages: DataFrame, columns: T.StructType, message: str = "message") -> DataFrame:
    source = T.StructType().add("db", "string").add("table", "string").add("commit_ts", "long")
    shape = T.StructType().add("payload", T.StructType().add("source", source).add("op", "string").add("before", columns).add("after", columns))
    m = messages.withColumn("_p", F.from_json(message, shape)["payload"])
    op = F.when(F.col("_p.op") == "c", "I").when(F.col("_p.op") == "u", "U").otherwise("D")
    return m.select(F.col("_p.source.db").alias("schema_name"), F.col("_p.source.table").alias("table_name"), op.alias("op"), F.col("_p.source.commit_ts").alias("commit_ts"), F.col("_p.before").alias("before"), F.col("_p.after").alias("after"))


def simple(log: DataFrame) -> Column:
    """{version, database, table, tableID, type, commitTs, schemaVersion, data, old}; the schema travels in messages of its own."""
    columns = _types(log)
    kind = F.when(F.col("op") == "I", "INSERT").when(F.col("op") == "U", "UPDATE").otherwise("DELETE")
    fields = [F.lit(1).alias("version"), F.col("schema_name").alias("database"), F.col("table_name").alias("table"), F.col("table_id").alias("tableID"), kind.alias("type"), F.col("commit_ts").alias("commitTs"), F.col("table_version").alias("schemaVersion"), texts("after", columns).alias("data"), texts("before", columns).alias("old")]
    return F.to_json(F.struct(*fields))


def simple_schema(schemas: DataFrame) -> Column:
    """The schema message of (schema_name, table_name, table_id, table_version, columns array of name and type)."""
    table = F.struct(F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), F.col("table_id").alias("tableID"), F.col("table_version").alias("version"), F.col("columns"))
    return F.to_json(F.struct(F.lit(1).alias("version"), F.lit("BOOTSTRAP").alias("type"), table.alias("tableSchema")))


def maxwell(log: DataFrame) -> Column:
    """{database, table, type, ts, data, old}; old names what an update changed, also where that was null."""
    names = list(_types(log))
    cells = [F.to_json(F.struct(F.col(f"before.{c}").alias(c)), KEEP_NULLS) for c in names]
    changed = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.substr(j, F.lit(2), F.length(j) - 2)) for c, j in zip(names, cells, strict=True)]
    kind = F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete")
    head = F.to_json(F.struct(F.col("schema_name").alias("database"), F.col("table_name").alias("table"), kind.alias("type"), F.floor(F.shiftright("commit_ts", 18) / 1000).alias("ts"), F.coalesce("after", "before").alias("data")), KEEP_NULLS)
    return F.when(F.col("op") == "U", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"old":{'), F.concat_ws(",", *changed), F.lit("}}"))).otherwise(head)


def avro_schema(name: str, columns: T.StructType, keys: Sequence[str] | None = None) -> dict:
    """The record schema of a table's value (or, with keys, of its key) as the registry stores it."""
    kinds = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytes", "string": "string"}
    fields = []
    for f in columns.fields:
        if keys is None or f.name in keys:
            kind = kinds.get(f.dataType.simpleString(), "string")
            fields.append({"name": f.name, "type": kind if keys is not None or not f.nullable else ["null", kind]} | ({} if keys is not None or not f.nullable else {"default": None}))
    return {"type": "record", "name": name, "fields": fields}


def watermark_message(ts: Column, protocol: str) -> Column:
    """The record by which a protocol tells that everything up to ts has been sent."""
    if protocol == "canal-json":
        return F.to_json(F.struct(F.lit(0).alias("id"), F.lit(WATERMARK_TYPE).alias("type"), F.lit(False).alias("isDdl"), F.struct(ts.alias("watermarkTs")).alias(EXTENSION)))
    if protocol == "open":
        return F.to_json(F.struct(ts.alias("ts"), F.lit(3).alias("t")))
    if protocol == "simple":
        return F.to_json(F.struct(F.lit(1).alias("version"), F.lit("WATERMARK").alias("type"), ts.alias("commitTs")))
    raise ValueError(f"no watermark message in {protocol}")


def claim_check(messages: DataFrame, most: int, folder: str, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """Messages with oversize values replaced by a pointer, and the payloads (location, message) to be stored."""
    name = F.concat(F.lit(folder.rstrip("/") + "/"), F.sha2(F.col(message).cast("binary"), 256), F.lit(".json"))
    large = F.octet_length(message) > most
    pointer = F.to_json(F.struct(name.alias("claimCheckLocation")))
    return messages.withColumn(message, F.when(large, pointer).otherwise(F.col(message))), messages.where(large).select(name.alias("location"), message).distinct()
