"""Comparison of two tables: checksums by bucket first, rows only where they differ, then repair statements."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 50_000


def chunk_size(rows: int) -> int:
    """50,000 rows, or a ten-thousandth of more than half a billion."""
    return CHUNK if rows <= 500_000_000 else rows // 10_000


def rounded(value: Column, kind: T.DataType) -> Column:
    """Floats to 6 and doubles to 15 significant digits; zero gives null, as its logarithm does."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return value
    digits = 5 if isinstance(kind, T.FloatType) else 14
    scale = F.when(value != 0, F.lit(digits) - F.floor(F.log10(F.abs(value))))
    return F.when(scale.isNotNull(), F.floor(value * F.pow(F.lit(10.0), scale) + 0.5) / F.pow(F.lit(10.0), scale))


def row_text(columns: Sequence[tuple[Column, Column]]) -> Column:
    """Values as text, joined by commas without nulls, and the null flags of all."""
    flags = F.concat(*(F.when(raw.isNull(), "1").otherwise("0") for raw, _ in columns))
    return F.concat_ws(",", *(text for _, text in columns), flags)


def row_hash(text: Column) -> Column:
    """XOR of the two halves of the MD5 of a row, as a signed 64-bit number."""
    digest = F.md5(text.cast("binary"))
    low, high = (F.conv(F.substring(digest, at, 16), 16, -10).cast("decimal(20,0)").cast("long") for at in (1, 17))
    return low.bitwiseXOR(high)


def unsigned(value: Column) -> Column:
    return (value.cast("decimal(20,0)") + F.when(value < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)")


def checksums(rows: DataFrame, text: Column, group: Sequence[Column] = ()) -> DataFrame:
    """Count and XOR checksum (unsigned) of each group; both combine before the shuffle, and over shards."""
    return rows.groupBy(*group).agg(F.count("*").alias("row_count"), unsigned(F.bit_xor(row_hash(text))).alias("checksum"))


def combine_checksums(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum of counts and XOR of checksums (signed halves) over shards, in any order."""
    signed = F.when(F.col("checksum") > F.lit("9223372036854775807").cast("decimal(20,0)"), F.col("checksum") - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("checksum")).cast("long")
    return parts.groupBy(*group).agg(F.sum("row_count").alias("row_count"), unsigned(F.bit_xor(signed)).alias("checksum"))


def chunk_bounds(rows: DataFrame, keys: Sequence[str], size: int, ranges: int = 256) -> DataFrame:
    """Chunks of size rows in key order: chunk number, inclusive upper bound, exclusive lower bound.

    Rows are cut into ranges of the first key by quantiles (a few numbers) and numbered within them, after the counts of
    the ranges before, so no task sees all keys and no rank depends on how partitions came about.
    """
    first, order = keys[0], ", ".join(keys)
    numeric = isinstance(rows.schema[first].dataType, T.NumericType)
    found = rows.select(F.percentile_approx(first, [k / ranges for k in range(1, ranges)], 5000).alias("q")).first()["q"] if numeric else None
    bounds = sorted(set(found or ()))
    own = rows.select(*keys).withColumn("_part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(first))) if bounds else F.lit(0))
    counts = own.groupBy("_part").count()
    before = counts.select("_part", F.expr("sum(count) OVER (ORDER BY _part) - count").alias("_before"))  # one row for each range
    rank = F.col("_before") + F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY {order})")
    ranked = own.join(F.broadcast(before), "_part").withColumn("_rank", rank)
    found = ranked.groupBy(F.floor((F.col("_rank") - 1) / size).alias("chunk")).agg(F.max(F.struct(*keys)).alias("upper"), F.count("*").alias("n"))
    return found.withColumn("lower", F.expr("lag(upper) OVER (ORDER BY chunk)"))


def range_predicate(keys: Sequence[str], lower: Sequence[object] | None, upper: Sequence[object] | None) -> Column:
    """lower < keys <= upper in lexicographic order, written out by column so that it reaches the scan."""

    def beyond(values: Sequence[object], more: bool, closed: bool) -> Column:
        out = None
        for k in reversed(range(len(keys))):
            own = F.col(keys[k])
            strict = own > F.lit(values[k]) if more else own < F.lit(values[k])
            last = k == len(keys) - 1
            step = (strict if not (last and closed) else (own <= F.lit(values[k]))) if out is None else strict | ((own == F.lit(values[k])) & out)
            out = step
        return out

    out = F.lit(True)
    if lower is not None and upper is not None and list(lower) == list(upper):
        return F.lit(False)
    if lower is not None:
        out = out & beyond(lower, True, False)
    if upper is not None:
        out = out & beyond(upper, False, True)
    return out


def random_bounds(rows: DataFrame, keys: Sequence[str], size: int, indexed: bool = True, seed: int = 0) -> list[tuple]:
    """Bounds of ceil(rows / size) chunks: that many keys less one, drawn by hash and sorted; one chunk without an index.

    Only the bounds reach the driver; the draw is a top-k, which every task cuts down before it sends.
    """
    chunks = -(-rows.count() // size) if indexed else 1
    if chunks <= 1:
        return []
    drawn = rows.select(*keys).distinct().orderBy(F.xxhash64(F.lit(seed), *keys)).limit(chunks - 1)
    return sorted(tuple(r) for r in drawn.collect())


def bucket_bounds(histogram: DataFrame, size: int) -> DataFrame:
    """Neighbouring histogram buckets (upper, n) merged into chunks of size rows at least, and in how many parts each is to be cut.

    A chunk that is a single bucket of more than twice the size is cut into parts of about the size.
    """
    total = F.expr("sum(n) OVER (ORDER BY upper)")
    merged = histogram.withColumn("chunk", F.floor((total - F.col("n")) / size).cast("long")).groupBy("chunk").agg(F.max("upper").alias("upper"), F.sum("n").alias("n"), F.count("*").alias("_buckets"))
    return merged.withColumn("parts", F.when((F.col("_buckets") == 1) & (F.col("n") > 2 * size), F.ceil(F.col("n") / size)).otherwise(1).cast("long")).drop("_buckets")


def splitter(strategy: str, histogram: bool, indexed: bool) -> str:
    """Which splitter cuts a table: bucket where statistics are there, else limit or random as configured, one chunk without an index."""
    if strategy not in ("auto", "limit", "random"):
        raise ValueError(f"unknown strategy: {strategy}")
    if not indexed:
        return "single"
    if strategy == "auto":
        return "bucket" if histogram else "random"
    return strategy


def collated(keys: Sequence[str], collation: str = "UTF8_LCASE") -> list[Column]:
    """Columns to order by under a collation."""
    return [F.collate(k, collation) for k in keys]


def json_equal(left: Column, right: Column) -> Column:
    """Whether two JSON texts are the same value whatever the order of their keys; null agrees with null, invalid text with itself."""
    a, b = F.try_parse_json(left), F.try_parse_json(right)
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).when(a.isNull() | b.isNull(), left == right).otherwise(F.to_json(a) == F.to_json(b))


def bad_range(source: DataFrame, target: DataFrame, key: str, values: Sequence[str], low: int, high: int, least: int = 1000) -> tuple[int, int]:
    """The smallest range of an integer key, by halving at the median, that holds all differences within low..high.

    Halving goes on while just one half differs and more than `least` rows are in it; each step is one aggregate of both tables.
    """
    text = F.to_json(F.struct(*(F.col(c) for c in [key, *values])), {"ignoreNullFields": "false"})
    own = [rows.select(F.col(key).alias("k"), row_hash(text).alias("h")) for rows in (source, target)]
    while True:
        inside = [rows.where(F.col("k").between(low, high)) for rows in own]
        n, middle = inside[0].agg(F.count("*"), F.percentile_approx("k", 0.5)).first()
        if n <= least or middle is None or middle >= high:
            return low, high
        sums = [dict((r["upper"], (r["n"], r["x"])) for r in rows.groupBy((F.col("k") > middle).alias("upper")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x")).collect()) for rows in inside]
        differs = [sums[0].get(half) != sums[1].get(half) for half in (False, True)]
        if differs[0] == differs[1]:
            return low, high
        low, high = (low, middle) if differs[0] else (middle + 1, high)


def global_checksums(tables: Mapping[str, tuple[DataFrame | None, DataFrame | None]], text: Callable[[DataFrame], Column], done: Sequence[str] = ()) -> DataFrame:
    """table_name, source_rows, target_rows, same of each table that isn't done; if one side lacks a table only counts are compared."""
    out = None
    for name, (source, target) in sorted(tables.items()):
        if name in done:
            continue
        sides = [checksums(rows, text(rows)) if rows is not None else None for rows in (source, target)]
        parts = [s.withColumn("_side", F.lit(k)) for k, s in enumerate(sides) if s is not None]
        each = {k: (F.coalesce(F.max(F.when(F.col("_side") == k, F.col("row_count"))), F.lit(0)), F.max(F.when(F.col("_side") == k, F.col("checksum")))) for k in (0, 1)}
        alike = each[0][0] == each[1][0]
        if None not in (source, target):
            alike = alike & each[0][1].eqNullSafe(each[1][1])
        row = reduce(DataFrame.unionByName, parts).agg(F.lit(name).alias("table_name"), each[0][0].alias("source_rows"), each[1][0].alias("target_rows"), alike.alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


def resume_after(states: DataFrame) -> DataFrame:
    """For each table the number of the last chunk of its finished beginning (table_name, chunk from 0, state), or -1."""
    least = states.where("state NOT IN ('success', 'failed', 'ignored')").groupBy("table_name").agg(F.min("chunk").alias("_open"))
    last = states.groupBy("table_name").agg(F.max("chunk").alias("_last"))
    return last.join(least, "table_name", "left").select("table_name", F.coalesce(F.col("_open") - 1, "_last").alias("resume_after"))


def report(states: DataFrame) -> DataFrame:
    """Per table: rows of both sides over all chunks, rows to add and delete over failed ones, and whether any chunk failed."""
    failed = F.col("state") == "failed"
    return states.groupBy("table_name").agg(
        F.sum("up_count").alias("up_count"), F.sum("down_count").alias("down_count"), F.sum(F.when(failed, F.col("rows_add")).otherwise(0)).alias("rows_add"),
        F.sum(F.when(failed, F.col("rows_delete")).otherwise(0)).alias("rows_delete"), F.when(F.max(failed), "fail").otherwise("pass").alias("result"),
    )


def total_size(sizes: DataFrame, size: str = "size", group: Sequence[str] = ()) -> DataFrame:
    """Bytes of tables, summed."""
    return sizes.groupBy(*group).agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def equal(left: Column, right: Column, kind: T.DataType, tolerance: float = 1e-6) -> Column:
    """Values agree: floats within a millionth, others null-safely; null agrees with null alone."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(F.abs(left - right) <= tolerance)
    return left.eqNullSafe(right)


def compare_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """repair (INSERT, DELETE, REPLACE) with both rows of every key that differs: one full outer sort-merge join."""
    s, t = source.select(*(F.col(k) for k in keys), F.struct(*source.columns).alias("_s")), target.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*target.columns).alias("_t"))
    joined = s.join(t, [s[k].eqNullSafe(t[f"_{k}"]) for k in keys], "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & equal(F.col(f"_s.{c}"), F.col(f"_t.{c}"), source.schema[c].dataType)
    repair = F.when(F.col("_t").isNull(), "INSERT").when(F.col("_s").isNull(), "DELETE").when(~same, "REPLACE")
    return joined.withColumn("repair", repair).where("repair IS NOT NULL").select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), "repair", F.col("_s").alias("source"), F.col("_t").alias("target"))


def diff(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], buckets: int) -> DataFrame:
    """compare_rows() of those hash buckets only whose checksums differ; equal tables cost one aggregate each.

    The list of differing buckets has `buckets` rows at most, which bounds what is broadcast.
    """
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    def sums(rows: DataFrame) -> DataFrame:
        text = F.to_json(F.struct(*(F.col(c) for c in [*keys, *values])), {"ignoreNullFields": "false"})
        return keyed(rows).groupBy("_bucket").agg(F.count("*").alias("n"), F.bit_xor(row_hash(text)).alias("x"))

    a, b = sums(source), sums(target).withColumnsRenamed({"n": "m", "x": "y"})
    bad = a.join(b, "_bucket", "full_outer").where("NOT (n <=> m AND x <=> y)").select("_bucket")
    s, t = (keyed(r).join(F.broadcast(bad), "_bucket", "left_semi").drop("_bucket") for r in (source, target))
    return compare_rows(s, t, keys, values)


def literal(value: Column, kind: T.DataType) -> Column:
    """A value as SQL text; strings in quotes with quotes and backslashes escaped."""
    if isinstance(kind, (T.StringType, T.TimestampType, T.DateType, T.TimestampNTZType)):
        text = F.concat(F.lit("'"), F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def repair_sql(differences: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """The statement that makes the target agree: REPLACE of the source row, or DELETE of the target row by all columns."""
    types = {f.name: f.dataType for f in differences.schema["source"].dataType.fields}
    names = ",".join(f"`{c}`" for c in columns)
    values = F.concat_ws(",", *(literal(F.col(f"source.{c}"), types[c]) for c in columns))
    where = F.concat_ws(" AND ", *(F.when(F.col(f"target.{c}").isNull(), F.lit(f"`{c}` IS NULL")).otherwise(F.concat(F.lit(f"`{c}` = "), literal(F.col(f"target.{c}"), types[c]))) for c in columns))
    text = F.when(F.col("repair") == "DELETE", F.concat(F.lit(f"DELETE FROM {table} WHERE "), where, F.lit(" LIMIT 1;"))).otherwise(F.concat(F.lit(f"REPLACE INTO {table}({names}) VALUES ("), values, F.lit(");")))
    return differences.withColumn("statement", text)


def summary(differences: DataFrame, group: Sequence[Column] = ()) -> DataFrame:
    """Rows to add, to delete and to replace of each group."""
    return differences.groupBy(*group).agg(*(F.sum((F.col("repair") == r).cast("long")).alias(f"n_{r.lower()}") for r in ("INSERT", "DELETE", "REPLACE")))


def selectivity(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values by rows of each column; the best index column has the most."""
    return rows.agg(*((F.count_distinct(c) / F.count(F.lit(1))).alias(c) for c in columns))


def missing_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables on one side only, and which side lacks them."""
    joined = source.select("table_name", F.lit(True).alias("_s")).join(target.select("table_name", F.lit(True).alias("_t")), "table_name", "full_outer")
    return joined.where("_s IS NULL OR _t IS NULL").select("table_name", F.when(F.col("_t").isNull(), "target").otherwise("source").alias("lacking"))


def same_structure(source: T.StructType, target: T.StructType, ignore: Sequence[str] = ()) -> list[str]:
    """Differences of names and types, column by column; empty if rows can be compared."""
    left, right = ([f for f in s.fields if f.name not in ignore] for s in (source, target))
    if len(left) != len(right):
        return [f"{len(left)} and {len(right)} columns"]
    return [f"{a.name} {a.dataType.simpleString()} and {b.name} {b.dataType.simpleString()}" for a, b in zip(left, right, strict=True) if (a.name.lower(), a.dataType) != (b.name.lower(), b.dataType)]
