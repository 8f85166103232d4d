"""Connected components by alternating star contraction.

Each round replaces the edges: in a large star all larger neighbours of a vertex are tied to the smallest
neighbour, in a small star all smaller ones.  Both are one aggregate with map-side
combining and one join on the vertex and a salt of SALTS values, so the neighbours of a vertex are spread from the start, and as
both sides are dealt anew for that join, Spark splits one that still has very many.  No component is gathered anywhere.  Rounds are cut to
tables in the shared folder; about log2 of the longest path of them are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from changeloom.llm.frames import cut, drop


SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pairs = both if large else both.where("v < u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    spread = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    tied = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id and component (the smallest id it reaches) of every vertex of edges (u, v) that has one smaller than itself."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most):
        seen = Observation()
        after = cut(_star(_star(now, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")))
        drop(now)
        now, new = after, (seen.get["n"], seen.get["x"])  # counted while the table was written
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = new
    raise RuntimeError(f"components aren't stable after {most} rounds")
