"""What a consumer of change messages does: drop replays, group by table, release what every partition has resolved."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_replays(messages: DataFrame, by_group: bool = True) -> DataFrame:
    """Row messages of (partition, offset, kind, table_name, commit_ts) that aren't sent again.

    A row below the largest resolved timestamp that its partition had told before is dropped; by_group also one below the largest
    commit_ts that its table had in that partition before (for protocols whose rows come in order).  A row at that timestamp stays.
    """
    before = Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    marked = messages.withColumn("_mark", F.max(F.when(F.col("kind") == "resolved", F.col("commit_ts"))).over(before))
    rows = marked.where("kind = 'row' AND (_mark IS NULL OR commit_ts >= _mark)")
    if by_group:
        own = Window.partitionBy("partition", "table_name").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_high", F.max("commit_ts").over(own)).where("_high IS NULL OR commit_ts >= _high").drop("_high")
    return rows.drop("_mark")


def global_watermark(messages: DataFrame, partitions: int) -> DataFrame:
    """One row: the least of the partitions' largest resolved timestamps; 0 while a partition has none."""
    marks = messages.where("kind = 'resolved'").groupBy("partition").agg(F.max("commit_ts").alias("ts"))
    return marks.agg(F.when(F.count("*") < partitions, F.lit(0)).otherwise(F.coalesce(F.min("ts"), F.lit(0))).cast("long").alias("watermark"))


def released(messages: DataFrame, partitions: int, by_group: bool = True) -> DataFrame:
    """Rows up to the global watermark, without replays."""
    mark = F.broadcast(global_watermark(messages, partitions))  # one row
    return without_replays(messages, by_group).join(mark, F.col("commit_ts") <= F.col("watermark")).drop("watermark")


def ddl_once(ddl: DataFrame) -> DataFrame:
    """DDL messages in order of offset without those sent again: known (start_ts, commit_ts, query, seq), or below the largest commit_ts seen before."""
    first = ddl.groupBy("start_ts", "commit_ts", "query", "seq").agg(F.min_by(F.struct(*ddl.columns), "offset").alias("_r")).select("_r.*")
    high = Window.orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)  # DDLs are few
    return first.withColumn("_high", F.max("commit_ts").over(high)).where("_high IS NULL OR commit_ts >= _high").drop("_high")


def batches(messages: DataFrame, group: Sequence[str], rows: int, size: Column, most_bytes: int) -> DataFrame:
    """batch_no of messages (position within their group from 1): at most `rows` rows, and a new batch when `most_bytes` more bytes were sent."""
    over = Window.partitionBy(*group, F.floor((F.col("position") - 1) / rows)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor((F.col("position") - 1) / rows)
    return messages.withColumn("block_no", block).withColumn("batch_no", F.floor(F.coalesce(F.sum(size).over(over), F.lit(0)) / most_bytes))


def new_files(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """(folder, low, high): file numbers that were added to each folder since the last walk; numbers only grow."""
    now = listed.groupBy("folder").agg(F.max("number").alias("high"))
    old = seen.groupBy("folder").agg(F.max("number").alias("_old"))
    return now.join(old, "folder", "left").select("folder", (F.coalesce("_old", F.lit(0)) + 1).alias("low"), "high").where("low <= high")


def newer_rows(rows: DataFrame, done: DataFrame, table: Sequence[str]) -> DataFrame:
    """Rows that a table hasn't had: commit_ts not below the last one that was applied (table columns, last_ts)."""
    return rows.join(done, list(table), "left").where("last_ts IS NULL OR commit_ts >= last_ts").drop("last_ts")


def bootstrap_points(log: DataFrame, position: str, every: int) -> Column:
    """Whether a table's schema is sent again before this change: at the first one and after each `every` changes."""
    return (F.col(position) - 1) % every == 0


def validation_step(pending: DataFrame, failing: DataFrame, now: int, delay: int, keys: Sequence[str], marking: bool = True) -> tuple[DataFrame, DataFrame]:
    """What still waits and what has become an error, from rows that were pending (keys, first_failed) and the keys that fail now.

    A key stays pending while it fails; it is an error once it has failed for `delay` from its first failure, when marking has begun.
    """
    found = failing.join(pending.select(*keys, F.col("first_failed").alias("_first")), list(keys), "left").withColumn("first_failed", F.coalesce("_first", F.lit(now))).drop("_first")
    late = F.lit(marking) & (F.lit(now) - F.col("first_failed") >= delay)
    return found.where(~late), found.where(late)


def over_limit(pending: DataFrame, size: Column, rows: int, most_bytes: int) -> DataFrame:
    """One row: whether a validator must stop, as too many or too large rows wait."""
    return pending.agg(((F.count("*") > rows) | (F.coalesce(F.sum(size), F.lit(0)) > most_bytes)).alias("stop"))


def error_counts(errors: DataFrame, statuses: Mapping[int, str]) -> DataFrame:
    """Errors by status, with the statuses' names."""
    names = F.create_map(*(F.lit(x) for kv in statuses.items() for x in kv)) if statuses else F.lit(None)
    return errors.groupBy("status").count().withColumn("name", F.element_at(names, F.col("status")))
