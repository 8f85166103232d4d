"""Key spans [start, end) of tables: intersection, hashing to shards, and cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """What spans (table_id, start_key, end_key) of both sides have in common; a null end is unbounded, disjoint spans have no row."""
    x, y = (s.select("table_id", F.col("start_key").alias(f"{n}_start"), F.col("end_key").alias(f"{n}_end")) for s, n in ((a, "a"), (b, "b")))
    low, high = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    overlap = (F.col("a_end").isNull() | (F.col("b_start") < F.col("a_end"))) & (F.col("b_end").isNull() | (F.col("a_start") < F.col("b_end")))
    return x.join(y, "table_id").where(overlap).select("table_id", low.alias("start_key"), high.alias("end_key"))


def clip(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The common part of two spans as a struct; an error if there is none."""
    a, b = F.greatest(start, low), F.least(end, high)
    return F.when(b.isNull() | (a < b), F.struct(a.alias("start_key"), b.alias("end_key"))).otherwise(F.raise_error(F.lit("spans are disjoint")).cast("struct<start_key:string,end_key:string>"))


def slot(start_key: Column, slots: int) -> Column:
    """The shard of a span: the first 32 bits of the MD5 of its start."""
    return F.pmod(F.conv(F.substring(F.md5(start_key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def gaps(spans: DataFrame) -> DataFrame:
    """Parts of a table between its first and last span that no span covers."""
    order = "PARTITION BY table_id ORDER BY start_key"
    ends = spans.withColumn("_seen", F.expr(f"max(coalesce(end_key, '￿')) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    return ends.where("_seen < start_key").select("table_id", F.col("_seen").alias("start_key"), F.col("start_key").alias("end_key"))
