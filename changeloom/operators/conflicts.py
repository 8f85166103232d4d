"""Which changes may be applied at the same time: conflict keys, waves and flush barriers, in windows of bounded size.

A window is what is flushed together, so nothing is compared across windows, and they are worked on in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wave_numbers(keys: Iterable[Iterable[str]]) -> list[int]:
    """The wave of each change in order: one more than the last wave of an earlier change that shares a key; changes of a wave don't conflict."""
    last: dict[str, int] = {}
    out = []
    for own in keys:
        own = list(own)
        wave = 1 + max((last.get(k, 0) for k in own), default=0)
        last.update(dict.fromkeys(own, wave))
        out.append(wave)
    return out


def relation_numbers(keys: Iterable[Iterable[str]]) -> list[tuple[int, int]]:
    """(barrier, relation) of each change in order: changes that share keys are of one relation, which one worker applies in order.

    A change whose keys belong to two relations raises a barrier: everything before it is flushed, and relations begin anew.
    """
    held: dict[str, int] = {}
    barrier = count = 0
    out = []
    for own in keys:
        own = list(own)
        known = {held[k] for k in own if k in held}
        if len(known) > 1:
            barrier, held, known = barrier + 1, {}, set()
        if known:
            relation = known.pop()
        else:
            relation, count = count, count + 1
        held.update(dict.fromkeys(own, relation))
        out.append((barrier, relation))
    return out


def _by_window(log: DataFrame, keys: Column, position: str, rows: int, number, names: str) -> DataFrame:
    slim = log.select("seq", F.col(position).cast("long").alias("position"), keys.alias("keys")).withColumn("window_no", F.floor((F.col("position") - 1) / rows))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        return number(frame)

    return slim.groupBy("window_no").applyInPandas(run, f"seq long, window_no long, {names}")


def waves(log: DataFrame, keys: Column, position: str, rows: int) -> DataFrame:
    """seq, window_no, wave of every change; position numbers the log in commit order, and a window has `rows` changes."""
    return _by_window(log, keys, position, rows, lambda f: pd.DataFrame({"seq": f["seq"], "window_no": f["window_no"], "wave": wave_numbers(f["keys"])}), "wave long")


def relations(log: DataFrame, keys: Column, position: str, rows: int) -> DataFrame:
    """seq, window_no, barrier, relation of every change."""

    def number(f: pd.DataFrame) -> pd.DataFrame:
        found = relation_numbers(f["keys"])
        return pd.DataFrame({"seq": f["seq"], "window_no": f["window_no"], "barrier": [b for b, _ in found], "relation": [r for _, r in found]})

    return _by_window(log, keys, position, rows, number, "barrier long, relation long")


def split_transactions(log: DataFrame, rows: int) -> DataFrame:
    """batch_id of each change of a large transaction, from 1; a mark (commit_ts, batch_id) says how far it has come."""
    place = F.expr("row_number() OVER (PARTITION BY commit_ts, start_ts ORDER BY CASE op WHEN 'D' THEN 0 WHEN 'U' THEN 1 ELSE 2 END, seq)")
    return log.withColumn("batch_id", F.floor((place - 1) / rows) + 1)
