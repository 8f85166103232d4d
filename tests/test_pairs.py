"""Pairs of neighbours in key order: the same as SQL's over any number of ranges, and no task that reads the whole table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from changeloom.plans import catalog, fixtures

ROWS = 400_000


@pytest.mark.parametrize("rows, nulls, size", [(0, 0, 10), (1, 0, 10), (2, 0, 1), (1000, 0, 10_000), (1001, 0, 7), (1000, 0, 1), (1003, 1, 40), (998, 1, 1), (0, 1, 10)])
def test_pairs_over_ranges_agree_with_sql(spark, tmp_path, rows, nulls, size):
    keys = [(k * 7919 % 1009) ** 2 - 5000 for k in range(rows)] + [None] * nulls
    table = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "o_orderkey long, o_custkey long").repartition(3)
    table.write.parquet(f"{tmp_path}/orders.parquet")
    found = fixtures.pairs(spark.read.parquet(f"{tmp_path}/orders.parquet").toDF("k", "c"), "k", size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"SELECT k, c, other FROM ({catalog._PAIRS}) AS q").fetchall()
    assert len(want) == rows + nulls
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_swapped_keys_deals_the_table_out(spark, tmp_path):
    spark.range(ROWS).select(F.col("id").alias("o_orderkey"), (F.col("id") % 999).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    store, tracker = spark._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("swapped_keys", "")
    try:
        catalog.QUERIES["swapped_keys"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("swapped_keys") for s in tracker.getJobInfo(j).stageIds}
    read = []
    for stage in stages:
        tasks = store.taskList(stage, 0, 10_000)
        read += [tasks.apply(k).taskMetrics().get().shuffleReadMetrics().recordsRead() for k in range(tasks.size())]
    assert sum(read) > ROWS and max(read) < 0.7 * ROWS
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    columns = "count(*), count(DISTINCT id), sum(hash(id, owner))"
    found, want = (con.sql(f"SELECT {columns} FROM ({q})").fetchall() for q in (f"SELECT * FROM '{tmp_path}/out/*.parquet'", catalog.ORACLE_SQL["swapped_keys"]))
    assert found == want
