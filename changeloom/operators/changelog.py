"""Operators over a change log.

A change log is a frame with op (I, U, D), commit_ts, start_ts, a unique seq, and the images
before and after as structs (null where absent).  All orders are explicit; no operator relies on
the order of its input rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind(before: str = "before", after: str = "after") -> Column:
    """I, U or D from which images are there."""
    return F.when(F.col(before).isNull(), "I").when(F.col(after).isNull(), "D").otherwise("U")


def op_rank(op: str = "op") -> Column:
    """Deletes come first in a transaction, then updates, then inserts."""
    return F.when(F.col(op) == "D", 0).when(F.col(op) == "U", 1).otherwise(2)


def image(name: str) -> Column:
    """A field of the after image, or of the before image of a delete."""
    return F.coalesce(F.col(f"after.{name}"), F.col(f"before.{name}"))


def commit_order() -> list[Column]:
    return [F.col("commit_ts"), F.col("start_ts"), op_rank(), F.col("seq")]


def sort_by_commit(log: DataFrame) -> DataFrame:
    """The log in commit order; a range-partitioned sort, so it scales with the cluster."""
    return log.orderBy(*commit_order())


#: Ranges of commit_ts into which an ordered pass over a table is cut, so that a hot table is many tasks.
RANGES = 64
_RANGE = "_commit_range"


def commit_key() -> Column:
    """What commit_order() orders by, as one value."""
    return F.struct(F.col("commit_ts"), F.col("start_ts"), op_rank().alias("op_rank"), F.col("seq"))


def cut_by_commit(log: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The log with the number of a commit_ts range; the bounds are quantiles, a few numbers, and equal commit_ts share a range."""
    found = log.select(F.percentile_approx("commit_ts", [k / ranges for k in range(1, ranges)], 2000).alias("q")).first()["q"] if ranges > 1 else None
    bounds = sorted(set(found or ()))
    return log.withColumn(_RANGE, F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("commit_ts"))) if bounds else F.lit(0))


def _before(parts: DataFrame, partition: Sequence[str], amount: Column) -> DataFrame:
    """parts (a row for each partition and range) with the sum of the amount over the earlier ranges, as _offset."""
    over = Window.partitionBy(*partition).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_offset", F.coalesce(F.sum(amount).over(over), F.lit(0)))


def number_by_commit(log: DataFrame, partition: Sequence[str], name: str = "position", ranges: int = RANGES) -> DataFrame:
    """Position of each change within its partition (a table or span), from 1: numbered within ranges, after the counts of earlier ones."""
    cut = cut_by_commit(log, ranges)
    own = [*partition, _RANGE]
    offsets = _before(cut.groupBy(*own).count(), partition, F.col("count")).drop("count")
    inner = F.row_number().over(Window.partitionBy(*own).orderBy(*commit_order()))
    return cut.withColumn(name, inner).join(offsets, own).withColumn(name, F.col(name) + F.col("_offset")).select(*log.columns, name)


def fetch_range(log: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Changes with low <= (commit_ts, start_ts) <= high; the comparison of commit_ts alone reaches the scan."""
    at = F.struct("commit_ts", "start_ts")
    ends = [F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in (low, high)]
    return log.where(F.col("commit_ts").between(low[0], high[0])).where((at >= ends[0]) & (at <= ends[1]))


def mark_txn_ends(log: DataFrame, partition: Sequence[str]) -> DataFrame:
    """txn_finished on the last change of each (commit_ts, start_ts) of a partition; a window holds one transaction."""
    follows = F.lead("seq").over(Window.partitionBy(*partition, "commit_ts", "start_ts").orderBy(*commit_order()))
    return log.withColumn("txn_finished", follows.isNull())


def _halves(log: DataFrame, split: Column) -> DataFrame:
    """Updates for which split holds become a delete and an insert; everything else stays one row."""
    whole = F.struct("op", "before", "after")
    none_b, none_a = (F.lit(None).cast(log.schema[c].dataType) for c in ("before", "after"))
    parts = F.array(F.struct(F.lit("D").alias("op"), F.col("before"), none_a.alias("after")), F.struct(F.lit("I").alias("op"), none_b.alias("before"), F.col("after")))
    rest = [c for c in log.columns if c not in ("op", "before", "after")]
    out = log.select(*rest, F.explode(F.when((F.col("op") == "U") & split, parts).otherwise(F.array(whole))).alias("_part"))
    return out.select(*rest, "_part.op", "_part.before", "_part.after")


def key_changed(keys: Sequence[str]) -> Column:
    return F.lit(False) if not keys else ~F.array(*(F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}")) for k in keys)).eqNullSafe(F.array(*[F.lit(True)] * len(keys)))


def split_key_updates(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates that touch a key column become a delete and an insert."""
    return _halves(log, key_changed(keys))


def split_updates(log: DataFrame, mode: str = "always", replicate_ts: int | None = None) -> DataFrame:
    """Source-side split of every update: none, those committed before replicate_ts (start), or always."""
    split = {"none": F.lit(False), "start": F.col("commit_ts") < F.lit(replicate_ts), "always": F.lit(True)}[mode]
    return _halves(log, F.coalesce(split, F.lit(False)))


def identity(keys: Sequence[str], columns: Sequence[str]) -> Column:
    """Key values, or all values of a table without a key, joined by a dot."""
    return F.concat_ws(".", *(image(c).cast("string") for c in (keys or columns)))


def compact(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One change for each key: I+U is I, U+U is U, anything then D is D (an I then D as well), D then I is a safe-mode I.

    First and last are by the whole commit key, deletes before updates before inserts within a transaction, so
    neither the order of seq nor keys that are swapped in one transaction matter.  Partial aggregates of each task
    shrink the log before it is shuffled.  Updates that change the key must be split first.  Without keys the log
    passes as it is.
    """
    if not keys:
        return log.withColumn("safe_mode", F.lit(False))
    own = [image(k).alias(k) for k in keys]
    found = log.select(*own, "op", "before", "after", "commit_ts", "start_ts", "seq").groupBy(*keys).agg(
        F.min_by(F.struct("op", "before"), commit_key()).alias("first"), F.max_by(F.struct("op", "before", "after", "commit_ts", "start_ts", "seq"), commit_key()).alias("last"),
        F.max(F.col("op") == "D").alias("deleted"), F.count("*").alias("merged"),
    )
    gone = F.col("last.op") == "D"
    op = F.when(gone, "D").when(F.col("deleted") | (F.col("first.op") == "I"), "I").otherwise("U")
    before = F.when(gone, F.col("last.before")).when(op == "U", F.col("first.before"))
    return found.select(*keys, op.alias("op"), (F.col("deleted") & ~gone).alias("safe_mode"), before.alias("before"), F.col("last.after").alias("after"), F.col("last.commit_ts").alias("commit_ts"), F.col("last.start_ts").alias("start_ts"), F.col("last.seq").alias("seq"), "merged")


def apply_log(base: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the log: compacted, then one full outer join on the key."""
    columns = base.columns
    last = compact(split_key_updates(log, keys), keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("op").alias("_op"), F.col("after").alias("_after"))
    match = [base[k].eqNullSafe(last[f"_{k}"]) for k in keys]
    joined = base.join(last, match, "full_outer").where("_op IS NULL OR _op <> 'D'")
    return joined.select(*(F.when(F.col("_op").isNull(), F.col(c)).otherwise(F.col(f"_after.{c}")).alias(c) for c in columns))


def snapshot(base: DataFrame, log: DataFrame, keys: Sequence[str], ts: int) -> DataFrame:
    """The table as it was at a timestamp, changes of that timestamp included."""
    return apply_log(base, log.where(F.col("commit_ts") <= ts), keys)


def insert_or_replace(log: DataFrame, safe_mode: bool, replicating_ts: Column) -> DataFrame:
    """statement for inserts: INSERT outside safe mode when committed after replicating began, else REPLACE."""
    plain = F.lit(not safe_mode) & (F.col("commit_ts") > replicating_ts)
    return log.withColumn("statement", F.when(F.col("op") == "D", "DELETE").when(F.col("op") == "U", "UPDATE").when(plain, "INSERT").otherwise("REPLACE"))


def safe_mode(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inserts become REPLACE; updates REPLACE, after a DELETE of the before image only if a key value changed."""
    out = split_key_updates(log, keys)
    return out.withColumn("statement", F.when(F.col("op") == "D", "DELETE").otherwise("REPLACE"))


def where_columns(primary: Sequence[str], unique: Sequence[tuple[Sequence[str], bool]], columns: Sequence[str], source: str = "before") -> Column:
    """Columns that identify a row: primary key, else the first not-null unique key, else a unique key without null here, else all."""
    if primary:
        return F.array(*map(F.lit, primary))
    for names, not_null in unique:
        if not_null:
            return F.array(*map(F.lit, names))
    out = None
    for names, _ in unique:
        full = F.lit(True)
        for c in names:
            full = full & F.col(f"{source}.{c}").isNotNull()
        found = F.array(*map(F.lit, names))
        out = F.when(full, found) if out is None else out.when(full, found)
    every = F.array(*map(F.lit, columns))
    return every if out is None else out.otherwise(every)


@dataclass(frozen=True)
class ForeignKey:
    """Columns of a child row that hold the key of a row of the parent table."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def causality_keys(
    table: Column, indexes: Sequence[Sequence[str]], columns: Sequence[str], any_null: bool, folded: Sequence[str] = (), prefixes: Mapping[str, int] | None = None, foreign: Sequence[ForeignKey] = ()
) -> Column:
    """Conflict keys of both images: a key for each unique index, and one under the parent table for each foreign key.

    any_null: an index is skipped if any of its columns is null; otherwise null columns are left out and it is skipped
    only if all are.  A foreign key with a null column is always skipped.  Columns in folded compare without case, those in prefixes
    by their first characters.  Without a key, the whole row counts.
    """

    def value(side: str, name: str) -> Column:
        out = F.col(f"{side}.{name}").cast("string")
        out = F.lower(out) if name in folded else out
        return F.substring(out, 1, prefixes[name]) if prefixes and name in prefixes else out

    def of(side: str, names: Sequence[str], as_table: Column, as_names: Sequence[str], strict: bool) -> Column:
        values = [value(side, c) for c in names]
        parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{c}="), v)) for c, v in zip(as_names, values, strict=True)]
        skip = reduce(or_, (v.isNull() for v in values)) if strict else F.coalesce(*values).isNull()
        return F.when(F.col(side).isNotNull() & ~skip, F.concat_ws("|", as_table, *parts))

    sides = ("before", "after")
    found = [of(s, names, table, names, any_null) for s in sides for names in indexes]
    found += [of(s, f.columns, F.lit(f.parent), f.parent_columns, True) for s in sides for f in foreign]
    keys = F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
    whole = F.array_compact(F.array(*(of(s, columns, table, columns, any_null) for s in sides)))
    return F.when(F.size(keys) > 0, keys).otherwise(whole)


def batch_order(log: DataFrame, rows: int, within: Sequence[str] = ()) -> DataFrame:
    """Statement batches of a transaction (and columns within it): deletes, then updates, then inserts, rows at most in each."""
    per = Window.partitionBy(*within, "commit_ts", "start_ts", "op").orderBy("seq")
    return log.withColumn("statement_no", F.floor((F.row_number().over(per) - 1) / rows).cast("long")).withColumn("batch_rank", op_rank())


def statement_groups(log: DataFrame, partition: Sequence[str], same: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """group_no: changes that follow each other in commit order and agree in the columns of same share a statement.

    Groups are counted within commit ranges; the first of a range goes on with the last of the one before if they agree.
    """
    cut = cut_by_commit(log, ranges)
    own = [*partition, _RANGE]
    over = Window.partitionBy(*own).orderBy(*commit_order())
    marked = cut.withColumn("_new", (~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(over))).cast("long"))
    marked = marked.withColumn("group_no", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut.groupBy(*own).agg(F.min_by(F.struct(*same), commit_key()).alias("_first"), F.max_by(F.struct(*same), commit_key()).alias("_last"))
    parts = parts.join(marked.groupBy(*own).agg(F.sum("_new").alias("_n")), own)
    goes_on = F.col("_first").eqNullSafe(F.lag("_last").over(Window.partitionBy(*partition).orderBy(_RANGE))) & F.lag("_n").over(Window.partitionBy(*partition).orderBy(_RANGE)).isNotNull()
    parts = _before(parts.withColumn("_joins", goes_on.cast("long")).withColumn("_net", F.col("_n") - F.col("_joins")), partition, F.col("_net"))
    out = marked.join(parts.select(*own, "_offset", "_joins"), own)
    return out.withColumn("group_no", F.col("group_no") + F.col("_offset") - F.col("_joins")).select(*log.columns, "group_no")


def as_of(events: DataFrame, versions: DataFrame, key: str, event_ts: str = "commit_ts", version_ts: str = "ts", missing: str = "error") -> DataFrame:
    """Each event with the newest version older than it: a change at a version's own timestamp still sees the one before.

    Versions become intervals, and the join is on the key and the interval: versions are few, so Spark broadcasts them where their
    size allows, and else splits a key with very many events.  Events before any version raise an error, or with missing="null" have a null version.
    """
    payload = [c for c in versions.columns if c != key]
    ends = versions.select(F.col(key).alias("_key"), F.col(version_ts).alias("_from"), F.lead(version_ts).over(Window.partitionBy(key).orderBy(version_ts)).alias("_to"), *(F.col(c).alias(f"_v_{c}") for c in payload))
    at = events[event_ts]
    joined = events.join(ends, (events[key] == ends["_key"]) & (ends["_from"] < at) & (ends["_to"].isNull() | (at <= ends["_to"])), "left")
    if missing == "error":
        fault = F.raise_error(F.concat(F.lit("no version before "), at.cast("string")))
        joined = joined.withColumn("_from", F.when(F.col("_from").isNull(), fault.cast(versions.schema[version_ts].dataType)).otherwise(F.col("_from"))).where("_from IS NOT NULL")
    return joined.select(*(events[c] for c in events.columns), *(F.col(f"_v_{c}").alias(c if c not in events.columns else f"version_{c}") for c in payload))


def latest_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group by an aggregate, which combines before the shuffle."""
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def drop_replayed(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """At-least-once input without repeats: one change for each key."""
    return log.dropDuplicates(list(key))


def frontier(progress: DataFrame, spans: Sequence[str], ts: str = "resolved_ts", group: Sequence[str] = ()) -> DataFrame:
    """The watermark: the smallest of the spans' largest resolved timestamps."""
    return progress.groupBy(*group, *spans).agg(F.max(ts).alias("_span")).groupBy(*group).agg(F.min("_span").alias("watermark"))
