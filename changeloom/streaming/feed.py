"""The change feed as a stream: watermarks, duplicates, barriers and continuous validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from changeloom.operators.changelog import apply_log, commit_key, commit_order


def read_files(spark: SparkSession, path: str, schema: T.StructType, files: int = 16, kind: str = "parquet") -> DataFrame:
    """New files of a folder as they come, a bounded number in each batch; the checkpoint is the list of files seen."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams in RocksDB on the executors' disks, checkpointed as changes, instead of in their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def without_repeats(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """At-least-once input without repeats; state is kept for the watermark's delay only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def counts_by_window(stream: DataFrame, ts: str, late: str, width: str, group: Sequence[str]) -> DataFrame:
    """Counts and sums by window; late rows are dropped once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *group).agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete tables name-<number> of a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(x.getPath().getName()) for x in fs.listStatus(path)]
    return sorted(int(x.removeprefix(f"{name}-")) for x in found if x.startswith(f"{name}-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def ddl_jobs(jobs: DataFrame, resolved: int) -> DataFrame:
    """DDL jobs that are still to come: finished after the resolved timestamp, with a schema version, each once."""
    return jobs.where((F.col("finished_ts") > resolved) & (F.col("schema_version") != 0)).distinct().orderBy("finished_ts")


class ResolvedEmitter:
    """Holds changes until every span is resolved up to them, then emits them in commit order; a span's mark never goes back.

    All state is in the folder: marks-n has the largest resolved timestamp of each span after batch n, held-n the rows
    that wait.  Batch n starts from the state of the batch before it, so it can run again after a failure, in this or
    another process, and gives the same rows.  A span that has sent rows but no mark holds everything back.
    For use in foreachBatch.
    """

    def __init__(self, folder: str, emit: Callable[[DataFrame, int], None], spans: Sequence[str] = ("table_id",)) -> None:
        self.folder, self.emit, self.spans = folder, emit, list(spans)

    def _state(self, spark: SparkSession, name: str, before: int) -> DataFrame | None:
        known = [k for k in _versions(spark, self.folder, name) if k < before]
        return spark.read.parquet(f"{self.folder}/{name}-{known[-1]}") if known else None

    def resolved(self, spark: SparkSession, before: int) -> int:
        """What all spans had been resolved to when batch `before` began."""
        marks = self._state(spark, "marks", before)
        return (marks.agg(F.min("ts").alias("ts")).first()["ts"] or 0) if marks is not None else 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = batch.select(*self.spans, F.when(F.col("kind") == "resolved", F.col("commit_ts")).otherwise(F.lit(0)).cast("long").alias("ts"))
        marks, rows = self._state(spark, "marks", number), batch.where("kind = 'row'")
        told = told if marks is None else told.unionByName(marks.select(*self.spans, "ts"))
        told.groupBy(*self.spans).agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.folder}/marks-{number}")
        held = self._state(spark, "held", number)
        if held is not None:
            rows = rows.unionByName(held)
        resolved = self.resolved(spark, number + 1)
        rows.where(F.col("commit_ts") > resolved).write.mode("overwrite").parquet(f"{self.folder}/held-{number}")
        self.emit(rows.where(F.col("commit_ts") <= resolved).orderBy(*commit_order()), number)
        for name in ("marks", "held"):
            for old in _versions(spark, self.folder, name):
                if old < number - 2:
                    _delete(spark, f"{self.folder}/{name}-{old}")


class Progress:
    """What of a table has been flushed: rows have positions, resolved marks come between them.

    The checkpoint is the largest mark all of whose earlier rows are flushed; flushes may be told in any order.
    """

    def __init__(self) -> None:
        self.open: dict[int, None] = {}  # rows not flushed, in order
        self.marks: list[tuple[int, int]] = []  # (rows added before it, resolved ts)
        self.added, self.checkpoint = 0, 0

    def add(self) -> int:
        self.open[self.added] = None
        self.added += 1
        return self.added - 1

    def resolve(self, ts: int) -> None:
        if not self.marks or ts > self.marks[-1][1]:
            self.marks.append((self.added, ts))

    def flushed(self, position: int) -> None:
        self.open.pop(position, None)

    def advance(self) -> int:
        first = next(iter(self.open), self.added)
        while self.marks and self.marks[0][0] <= first:
            self.checkpoint = max(self.checkpoint, self.marks.pop(0)[1])
        return self.checkpoint


def checkpoints(marks: DataFrame, rows: DataFrame, partition: Sequence[str]) -> DataFrame:
    """checkpoint of each partition: its largest resolved mark (partition, ts) below every row (partition, commit_ts, flushed) that isn't flushed.

    Both sides are aggregates, so no partition is gathered in a task.
    """
    own = list(partition)
    least = rows.where("NOT flushed").groupBy(*own).agg(F.min("commit_ts").alias("_open"))
    fine = marks.join(least, own, "left").where("_open IS NULL OR ts < _open")
    known = marks.select(*own).distinct()
    return known.join(fine.groupBy(*own).agg(F.max("ts").alias("checkpoint")), own, "left").fillna({"checkpoint": 0})


def current_version(spark: SparkSession, table: str) -> int:
    """The newest complete version of a table kept as folders v-n."""
    found = _versions(spark, table, "v")
    if not found:
        raise ValueError(f"{table} has no complete version")
    return found[-1]


def apply_stream(stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Applies each batch of changes to a table kept as versions in a folder.

    Batch n makes version v-(n + 1) from v-n and is complete with its _SUCCESS file, which makes it current; running it again
    writes the same version.  The newest `keep` versions stay.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.schema(batch.schema["after"].dataType).parquet(f"{table}/v-{number}")
        apply_log(base, batch, keys).write.mode("overwrite").parquet(f"{table}/v-{number + 1}")
        for old in _versions(spark, table, "v"):
            if old <= number + 1 - keep:
                _delete(spark, f"{table}/v-{old}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs what is there now to its end."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def until(stream: DataFrame, target_ts: int) -> DataFrame:
    """Finish barrier: nothing after the target timestamp."""
    return stream.where(F.col("commit_ts") <= target_ts)


def syncpoints(progress: DataFrame, interval: int) -> DataFrame:
    """One (primary_ts, secondary_ts) for each interval that the resolved timestamp has passed."""
    cut = F.floor(F.col("resolved_ts") / interval) * interval
    return progress.withColumn("primary_ts", cut).where("primary_ts > 0").groupBy("changefeed", "primary_ts").agg(F.min("resolved_ts").alias("secondary_ts"))


def syncpoint_store(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Syncpoints (cluster, changefeed, primary_ts, secondary_ts, created_at): of those with one primary_ts of a feed the stored one stays, else the first created."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("cluster", "changefeed", "primary_ts").agg(F.min_by(F.struct("secondary_ts", "created_at"), F.struct("_new", "created_at", "secondary_ts")).alias("r")).select("cluster", "changefeed", "primary_ts", "r.*")


def expired_syncpoints(stored: DataFrame, now: int, retention: int) -> DataFrame:
    """Syncpoints that were created longer than the retention ago."""
    return stored.where(F.col("created_at") < F.lit(now - retention))


class ChangeFeed(DataSource):
    """The source "changes": a folder with a JSON-lines file for each span, read in parallel by span.

    Options: path, start_ts (rows at or below it are left out).  Register with spark.dataSource.register(ChangeFeed).
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return "span string, kind string, table_id long, op string, commit_ts long, start_ts long, value string, old_value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ChangeReader(self.options, schema.names)


class _ChangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.path, self.start, self.names = options["path"], int(options.get("start_ts", 0)), names

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(x) for x in sorted(os.listdir(self.path)) if x.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json

        with open(f"{self.path}/{partition.value}", encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line) | {"span": partition.value.removesuffix(".jsonl")}
                if row["commit_ts"] > self.start:
                    yield tuple(row.get(n) for n in self.names)


class Relay:
    """A landing folder between a source and its readers: batches are written once, in numbered folders, and purged when they are old."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def land(self, batch: DataFrame, number: int) -> None:
        """Writes a batch; one that is complete is left as it is."""
        if number not in _versions(batch.sparkSession, self.folder, "batch"):
            batch.sortWithinPartitions(*commit_order()).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")

    def read(self, spark: SparkSession, after: int = -1) -> DataFrame:
        """All complete batches with a number above `after`."""
        found = [f"{self.folder}/batch-{n}" for n in _versions(spark, self.folder, "batch") if n > after]
        if not found:
            raise ValueError("the relay has no such batch")
        return spark.read.parquet(*found)

    def purge(self, spark: SparkSession, done_ts: int) -> list[int]:
        """Deletes the oldest batches all of whose changes are at or below a timestamp; the newest always stays."""
        gone = []
        for n in _versions(spark, self.folder, "batch")[:-1]:
            high = spark.read.parquet(f"{self.folder}/batch-{n}").agg(F.max("commit_ts").alias("x")).first()["x"]
            if high is not None and high > done_ts:
                break
            _delete(spark, f"{self.folder}/batch-{n}")
            gone.append(n)
        return gone


def validate(pending: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], full: bool = True) -> DataFrame:
    """The newest pending change of each key that the target doesn't show: row missing, row not deleted, or (full) values differ."""
    image = F.coalesce("after", "before")
    newest = pending.select(*(image[k].alias(k) for k in keys), "op", "after", "commit_ts", "start_ts", "seq").groupBy(*keys).agg(F.max_by(F.struct("op", "after", "seq"), commit_key()).alias("c"))
    there = target.select(*keys, F.struct(*values).alias("_t"))
    joined = newest.join(there, list(keys), "left")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"c.after.{c}").eqNullSafe(F.col(f"_t.{c}"))
    fault = F.when((F.col("c.op") == "D") & F.col("_t").isNotNull(), "not deleted").when((F.col("c.op") != "D") & F.col("_t").isNull(), "missing")
    if full:
        fault = fault.when((F.col("c.op") != "D") & differs, "different")
    return joined.withColumn("fault", fault).where("fault IS NOT NULL").select(*keys, F.col("c.seq").alias("seq"), "fault")
