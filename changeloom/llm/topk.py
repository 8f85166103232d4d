"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A block is up to `block` candidates of a partition.  Each of its dimensions is a list of the candidates sorted by
their component, made once for the block; it is read from the top for positive query components and from the
bottom for negative ones.  All lists are read in step, a share of their depth at a time.  What has been read
gives every candidate a lower bound (unread components at the list's far end) and an upper bound (unread components
at the last value read); for a block of queries both are matrix products.  A query's threshold is the k-th best
of the lower bounds and of the scores that the task has found before; a candidate whose upper bound is under it is
an outsider and drops out.  Reading stops when at most `settle` candidates a query are left on average, whose final scores
are then resolved from their vectors.  Otherwise the lists are read on, at worst to their ends, where
both bounds are the score; there is no other path.

Queries go to the candidates in broadcasts of about QUERY_VALUES components, dealt by hash, and candidates are not moved: a
task reads its partition as blocks, keeps the best k of each query of the broadcast over all of them and sends
those alone.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; vectors of
different lengths aren't compared; every row is a candidate of all queries but those of its own id, rows that share an id each for itself;
queries that share id and vector are one query; ids that are null take no part; a query without candidates
gives no row; ties go to the smaller id.  Vectors of any length are read whole; extra columns are ignored.
Scores are exact while their absolute values stay under 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.frames import bound_batches

SCALE = 64
BLOCK = 8192
QUERY_VALUES = 1 << 22  # components of the queries in a broadcast
TOGETHER = 256  # queries whose bounds are held at once
DEPTHS = (0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375, 1.0)
SETTLE = 8  # candidates left for each one wanted


class Lists:
    """The sorted lists of a block: each dimension's values in order."""

    def __init__(self, rows: np.ndarray, kind: type) -> None:
        self.rows, self.kind = rows.astype(kind), kind
        self.ordered = np.sort(self.rows, axis=0)

    def bounds(self, queries: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x rows) after reading a share of every list."""
        n = len(self.rows)
        read = min(n, max(1, int(np.ceil(n * depth))))
        up, down = np.maximum(queries, 0).astype(self.kind), np.minimum(queries, 0).astype(self.kind)
        if read == n:
            exact = queries.astype(self.kind) @ self.rows.T
            return exact, exact
        top, bottom, least, most = self.ordered[n - read], self.ordered[read - 1], self.ordered[0], self.ordered[-1]
        high, low = self.rows >= top, self.rows <= bottom
        lower = up @ np.where(high, self.rows, least).T + down @ np.where(low, self.rows, most).T
        upper = up @ np.where(high, self.rows, top).T + down @ np.where(low, self.rows, bottom).T
        return lower, upper


def search(lists: Lists, own: np.ndarray, queries: np.ndarray, k: int, threshold: np.ndarray, depths: tuple[float, ...] = DEPTHS, settle: int = SETTLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, row, score) of what may be among each query's k best, and the depth at which reading stopped.

    own: pairs that don't count; threshold: what each query's k-th best is known to reach.
    """
    rows = lists.rows
    alive = ~own
    for depth in depths:
        lower, upper = lists.bounds(queries, depth)
        if len(rows) >= k:
            lower[own] = -np.inf
            threshold = np.maximum(threshold, np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k])
        alive &= upper >= threshold[:, None]
        if depth >= 1 or alive.sum() <= settle * k * len(queries):
            break
    a, b = np.nonzero(alive)
    return a, b, np.einsum("ij,ij->i", queries[a].astype(np.int64), rows[b].astype(np.int64)), depth


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k first of their query, by score and then id."""
    order = np.lexsort((ids, -score, query))
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


class Best:
    """The best k rows of each query of one length so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.held = [(np.zeros(0, np.int64),) * 3] * -(-len(queries) // TOGETHER)
        self.threshold = np.full(len(queries), -np.inf)
        self.depths: list[float] = []

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        size = float(np.abs(rows).max(initial=0)) * float(np.abs(self.queries).max(initial=0)) * max(1, rows.shape[1])
        lists = Lists(rows, np.float32 if size < 1 << 24 else np.float64)
        for part in range(len(self.held)):
            at = slice(part * TOGETHER, (part + 1) * TOGETHER)
            own = self.query_ids[at][:, None] == ids[None, :]
            a, b, score, depth = search(lists, own, self.queries[at], self.k, self.threshold[at])
            self.depths.append(depth)
            query, found, score = (np.concatenate(x) for x in zip(self.held[part], (a, ids[b], score), strict=True))
            some = _best(query, found, score, self.k)
            query, found, score = query[some], found[some], score[some]
            self.held[part] = query, found, score
            last = np.flatnonzero(np.diff(query, append=-1))
            full = np.bincount(query, minlength=len(self.threshold[at]))[query[last]] == self.k
            self.threshold[at][query[last[full]]] = score[last[full]]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part, (query, found, score) in enumerate(self.held):
            yield self.query_ids[part * TOGETHER + query], found, score


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)) if len(vectors) else np.zeros((0, dims))


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes).tolist():
        own = pa.array(sizes == dims)
        yield dims, ids.filter(own).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(vectors.filter(own), dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, block: int = BLOCK, query_values: int = QUERY_VALUES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    ids = vectors.schema["vec_id"].dataType.simpleString()
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    )
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    asked = whole.where("is_query").select("vec_id", "v").distinct()
    rounds = max(1, -(-(asked.agg(F.sum(F.size("v"))).first()[0] or 0) // query_values))
    schema, out = "query_id long, vec_id long, score long", None
    for part in range(rounds):
        some = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(rounds)) == part)
        found = some.toArrow().combine_chunks()
        held = spark.sparkContext.broadcast(list(_by_length(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {dims: Best(own, rows, k) for dims, own, rows in held.value}
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def flush(dims: int) -> None:
                own, rows = (np.concatenate(x) for x in zip(*waiting.pop(dims), strict=True))
                best[dims].add(own, rows)

            for batch in batches:
                for dims, own, rows in _by_length(batch.column(0), batch.column(1)):
                    if dims in best:
                        waiting.setdefault(dims, []).append((own, rows))
                        if sum(len(x) for x, _ in waiting[dims]) >= block:
                            flush(dims)
            for dims in list(waiting):
                flush(dims)
            for one in best.values():
                for columns in one.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

        got = whole.select("vec_id", "v").mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").cast("int")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").cast(ids).alias("query_id"), "rank", F.col("vec_id").cast(ids).alias("vec_id"), "score")
