"""The redo log: append changes, read back a range in commit order, replay them into a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.operators.changelog import apply_log, commit_order


def write(log: DataFrame, path: str, span: int = 1 << 20) -> None:
    """Appends changes in folders by a range of commit_ts, sorted within files, so that reads prune both."""
    ranged = log.withColumn("ts_range", F.floor(F.col("commit_ts") / span))
    ranged.repartitionByRange("ts_range", "commit_ts").sortWithinPartitions("ts_range", *commit_order()).write.mode("append").partitionBy("ts_range").parquet(path)


def read(spark: SparkSession, path: str, checkpoint_ts: int, resolved_ts: int, span: int = 1 << 20) -> DataFrame:
    """Changes with checkpoint_ts < commit_ts <= resolved_ts; folders and row groups outside are skipped."""
    rows = spark.read.parquet(path).where(F.col("ts_range").between(checkpoint_ts // span, resolved_ts // span))
    return rows.where((F.col("commit_ts") > checkpoint_ts) & (F.col("commit_ts") <= resolved_ts)).drop("ts_range")


def write_meta(spark: SparkSession, path: str, checkpoint_ts: int, resolved_ts: int) -> None:
    spark.createDataFrame([(checkpoint_ts, resolved_ts)], "checkpoint_ts long, resolved_ts long").coalesce(1).write.mode("append").parquet(path)


def read_meta(spark: SparkSession, path: str) -> tuple[int, int]:
    """The largest checkpoint and resolved timestamps that were flushed."""
    row = spark.read.parquet(path).agg(F.max("checkpoint_ts").alias("a"), F.max("resolved_ts").alias("b")).first()
    return row["a"], row["b"]


def replay(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after a redo range; the log is compacted by key, so it needs no global order."""
    return apply_log(base, log, keys)


def segments(log: DataFrame, ddl_ts: Sequence[int]) -> DataFrame:
    """segment of each change: how many of the DDLs are before it; a change at a DDL's own timestamp comes before the DDL."""
    out = F.lit(0)
    for ts in ddl_ts:
        out = out + (F.col("commit_ts") > ts).cast("int")
    return log.withColumn("segment", out)


def write_ddl(ddl: DataFrame, path: str) -> None:
    """Appends DDL events to the log; they are few."""
    ddl.coalesce(1).sortWithinPartitions("commit_ts", "seq").write.mode("append").parquet(path)


def read_ddl(spark: SparkSession, path: str, checkpoint_ts: int, resolved_ts: int, supported: Sequence[str]) -> DataFrame:
    """DDL events that a replay runs: those after the checkpoint, and those at it if their type is supported there; each once."""
    rows = spark.read.parquet(path).where((F.col("commit_ts") <= resolved_ts) & ((F.col("commit_ts") > checkpoint_ts) | ((F.col("commit_ts") == checkpoint_ts) & F.lower("type").isin([x.lower() for x in supported]))))
    return rows.dropDuplicates(["commit_ts", "seq"])


def flushed(spans: DataFrame) -> DataFrame:
    """One row: the timestamps up to which all spans (checkpoint_ts, resolved_ts of each flush by span) are in the log; neither goes back."""
    each = spans.groupBy("span").agg(F.max("checkpoint_ts").alias("checkpoint_ts"), F.max("resolved_ts").alias("resolved_ts"))
    return each.agg(F.min("checkpoint_ts").alias("checkpoint_ts"), F.min("resolved_ts").alias("resolved_ts"))


def replay_with_ddl(base: DataFrame, log: DataFrame, ddl_ts: Sequence[int], keys: Sequence[str], run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The table after a range with DDLs: each segment of changes is applied, then the DDL that ends it (run gets the table and its timestamp)."""
    numbered = segments(log, sorted(ddl_ts))
    table = base
    for k, ts in enumerate([*sorted(ddl_ts), None]):
        table = apply_log(table, numbered.where(F.col("segment") == k).drop("segment"), keys)
        table = table if ts is None else run(table, ts)
    return table
