"""Change logs derived from the given tables; the same SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_ROW = ", ".join(FIELDS)

#: The table before its log.
BASE = f"SELECT {_ROW} FROM orders WHERE o_orderkey % 10 <> 0"

_OLD = "o_custkey AS b_custkey, o_orderstatus AS b_status, o_totalprice AS b_price, o_orderpriority AS b_priority"
_NEW = "o_custkey AS a_custkey, o_orderstatus AS a_status, o_totalprice AS a_price, o_orderpriority AS a_priority"
_NO_OLD = "CAST(NULL AS BIGINT) AS b_custkey, CAST(NULL AS VARCHAR(1)) AS b_status, CAST(NULL AS DOUBLE) AS b_price, CAST(NULL AS VARCHAR(20)) AS b_priority"
_NO_NEW = "CAST(NULL AS BIGINT) AS a_custkey, CAST(NULL AS VARCHAR(1)) AS a_status, CAST(NULL AS DOUBLE) AS a_price, CAST(NULL AS VARCHAR(20)) AS a_priority"

#: Inserts, updates and deletes with images as flat columns; seq is unique and falls as commit_ts grows, so that nothing can rely on it.
LOG = f"""SELECT *, commit_ts - 5 - o_orderkey % 3 AS start_ts, o_orderkey % 4 AS table_id, 'shop' AS schema_name,
  CASE WHEN o_orderkey % 4 = 3 THEN 'orders_old' ELSE 'orders' END AS table_name FROM (
  SELECT o_orderkey, 'I' AS op, 1000 + o_orderkey % 97 AS commit_ts, o_orderkey * 4 + 3 AS seq, {_NO_OLD}, {_NEW} FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, 'U', 2000 + o_orderkey % 89, o_orderkey * 4 + 2, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END, 'U', o_totalprice + 1, o_orderpriority FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 'D', 3000 + o_orderkey % 83, o_orderkey * 4 + 1, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, {_NO_NEW} FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'I', 4000 + o_orderkey % 79, o_orderkey * 4, {_NO_OLD}, o_custkey, 'R', o_totalprice + 2, o_orderpriority FROM orders WHERE o_orderkey % 33 = 0
) AS changes"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}


def _placed(sql: str, name: str) -> str:
    return sql.replace(f"FROM {name}", f"FROM {{{name}}}")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_placed(BASE, "orders"), **tables(spark, sf_dir, "orders"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with images as structs."""
    flat = spark.sql(_placed(LOG, "orders"), **tables(spark, sf_dir, "orders"))
    short = dict(zip(FIELDS[1:], ("custkey", "status", "price", "priority"), strict=True))

    def image(side: str, absent: str) -> F.Column:
        return F.when(F.col("op") != absent, F.struct(F.col("o_orderkey"), *(F.col(f"{side}_{s}").alias(c) for c, s in short.items())))

    return flat.select("op", "table_id", "schema_name", "table_name", "commit_ts", "start_ts", "seq", F.lit(1).cast("long").alias("table_version"), image("b", "I").alias("before"), image("a", "D").alias("after"))


#: Rows of a key range that are numbered together, about; and the most ranges of a table.
RANGE_ROWS, MOST_RANGES = 100_000, 1024


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below the key, by binary search; a null key comes after all."""
    if not bounds:
        return F.lit(0)
    known, steps = F.array(*map(F.lit, bounds)), [2**k for k in reversed(range(len(bounds).bit_length()))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) < key, at + step).otherwise(at))
    return F.coalesce(F.when(key.isNull(), len(bounds)).otherwise(below), F.lit(0))  # never null, so that a join on it adds no second search


def pairs(rows: DataFrame, key: str, size: int = RANGE_ROWS) -> DataFrame:
    """Rows with the key of their partner as other: in key order the first goes with the second, the third with the fourth, an odd last one with none.

    Rows are cut into ranges of about `size` by quantiles of the key and numbered within them, after the counts of earlier ranges; the ends
    of a range see the ends of its neighbours.  So no task sees all rows, and the number of ranges grows with the table.
    """
    found = rows.select(F.count("*").alias("n"), F.percentile_approx(key, [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10_000).alias("q")).first()
    ranges = min(max(-(-found["n"] // size), 1), MOST_RANGES)
    bounds = sorted({found["q"][k * MOST_RANGES // ranges - 1] for k in range(1, ranges)}) if found["q"] else []
    cut = rows.withColumn("_part", _range_of(F.col(key), bounds))
    ends = cut.groupBy("_part").agg(F.count("*").alias("_n"), F.min(key).alias("_low"), F.max(key).alias("_high"))
    near = Window.orderBy("_part")  # one row for each range
    ends = ends.select("_part", "_n", (F.sum("_n").over(near) - F.col("_n")).alias("_before"), F.lag("_high").over(near).alias("_last"), F.lead("_low").over(near).alias("_next"))
    own = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last())
    out = cut.repartitionById(ranges, "_part").join(F.broadcast(ends), "_part").withColumn("_at", F.row_number().over(own))
    after = F.when(F.col("_at") == F.col("_n"), F.col("_next")).otherwise(F.lead(key).over(own))
    before = F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.lag(key).over(own))
    return out.select(*rows.columns, F.when((F.col("_before") + F.col("_at")) % 2 == 1, after).otherwise(before).alias("other"))
