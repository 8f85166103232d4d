"""Changes as SQL text: single-row and multi-row statements, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.operators.changelog import op_rank
from changeloom.operators.diff import literal


def _fields(log: DataFrame, generated: Sequence[str]) -> list[T.StructField]:
    return [f for f in log.schema["after"].dataType.fields if f.name not in generated]


def _values(side: str, fields: Sequence[T.StructField]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *(literal(F.col(f"{side}.{f.name}"), f.dataType) for f in fields)), F.lit(")"))


def _where(side: str, fields: Sequence[T.StructField]) -> Column:
    """Values as conditions; null by IS."""
    parts = [F.concat(F.lit(f"`{f.name}`"), F.when(F.col(f"{side}.{f.name}").isNull(), F.lit(" IS NULL")).otherwise(F.concat(F.lit(" = "), literal(F.col(f"{side}.{f.name}"), f.dataType)))) for f in fields]
    return F.concat_ws(" AND ", *parts)


def _named(fields: Sequence[T.StructField]) -> str:
    return ",".join(f"`{f.name}`" for f in fields)


def _key_fields(log: DataFrame, keys: Sequence[str], force_replicate: bool) -> list[T.StructField]:
    fields = log.schema["after"].dataType.fields
    return [f for f in fields if f.name in keys] or (fields if force_replicate else [])


def single_row(log: DataFrame, keys: Sequence[str], generated: Sequence[str] = (), replace: Column | bool = False, force_replicate: bool = False) -> DataFrame:
    """statement of each change: generated columns aren't written, rows are found by key (by all columns under force_replicate), LIMIT 1.

    Updates and deletes of a table without key columns have no statement otherwise and are left out.
    """
    fields, by = _fields(log, generated), _key_fields(log, keys, force_replicate)
    table = F.concat(F.lit("`"), F.col("schema_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    verb = F.when(replace if isinstance(replace, Column) else F.lit(replace), "REPLACE").otherwise("INSERT")
    insert = F.concat(verb, F.lit(" INTO "), table, F.lit(f" ({_named(fields)}) VALUES "), _values("after", fields))
    if by:
        sets = F.concat_ws(", ", *(F.concat(F.lit(f"`{f.name}` = "), literal(F.col(f"after.{f.name}"), f.dataType)) for f in fields))
        update = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), sets, F.lit(" WHERE "), _where("before", by), F.lit(" LIMIT 1"))
        delete = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), _where("before", by), F.lit(" LIMIT 1"))
    else:
        update = delete = F.lit(None).cast("string")
    text = F.when(F.col("op") == "I", insert).when(F.col("op") == "U", update).otherwise(delete)
    return log.withColumn("statement", text).where("statement IS NOT NULL")


def multi_row(log: DataFrame, batch: Sequence[str], keys: Sequence[str], generated: Sequence[str] = (), replace: bool = False) -> DataFrame:
    """One statement for each batch (columns that tell schema, table, operation and number of the batch): rows in order of seq.

    Inserts share VALUES, deletes are joined by OR, and an update picks each column's value by CASE.  A batch is as large as
    the column that numbers it makes it, so what is gathered for one is bounded.
    """
    fields, by = _fields(log, generated), _key_fields(log, keys, True)
    rows = log.groupBy("schema_name", "table_name", "op", *batch).agg(
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce(_values("after", fields), F.lit("")).alias("v"), F.coalesce(_where("before", by), F.lit("")).alias("w"), F.struct(*(literal(F.col(f"after.{f.name}"), f.dataType).alias(f.name) for f in fields)).alias("x")))).alias("r")
    )
    table = F.concat(F.lit("`"), F.col("schema_name"), F.lit("`.`"), F.col("table_name"), F.lit("`"))
    verb = "REPLACE" if replace else "INSERT"
    insert = F.concat(F.lit(f"{verb} INTO "), table, F.lit(f" ({_named(fields)}) VALUES "), F.array_join(F.transform("r", lambda x: x["v"]), ","))
    found = F.concat(F.lit("("), F.array_join(F.transform("r", lambda x: x["w"]), ") OR ("), F.lit(")"))

    def chosen(name: str) -> Column:
        return F.concat(F.lit(f"`{name}`=CASE"), F.array_join(F.transform("r", lambda x: F.concat(F.lit(" WHEN "), x["w"], F.lit(" THEN "), x["x"][name])), ""), F.lit(" END"))

    update = F.concat(F.lit("UPDATE "), table, F.lit(" SET "), F.concat_ws(", ", *(chosen(f.name) for f in fields)), F.lit(" WHERE "), found)
    delete = F.concat(F.lit("DELETE FROM "), table, F.lit(" WHERE "), found)
    text = F.when(F.col("op") == "I", insert).when(F.col("op") == "U", update).otherwise(delete)
    return rows.select("schema_name", "table_name", "op", *batch, F.size("r").alias("n"), text.alias("statement"), op_rank().alias("batch_rank"))


def mergeable_updates(log: DataFrame, most: int = 1024) -> DataFrame:
    """Whether the updates of each table may share statements: the mean size of their rows is below the limit."""
    size = F.octet_length(F.to_json("after")) + F.octet_length(F.to_json("before"))
    return log.where("op = 'U'").groupBy("schema_name", "table_name").agg((F.avg(size) < most).alias("mergeable"))


def redo_order(log: DataFrame, keys_changed: Column) -> DataFrame:
    """phase and rank of what a redo log applies: within a transaction all deletes first, then updates in place, and inserts at its end.

    Updates for which keys_changed holds become a delete and an insert, which so can't meet rows that the transaction has yet to remove.
    """
    parts = F.when((F.col("op") == "U") & keys_changed, F.array(F.lit("D"), F.lit("I"))).otherwise(F.array("op"))
    out = log.withColumn("phase", F.explode(parts))
    return out.withColumn("phase_rank", F.when(F.col("phase") == "D", 0).when(F.col("phase") == "U", 1).otherwise(2))
