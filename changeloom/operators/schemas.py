"""Schema versions from DDL events, shard DDL coordination and online schema change."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators.filters import SHADOW, TRASH


def catalog_versions(ddl: DataFrame) -> DataFrame:
    """Versions of every table from its DDL events: ts, version from 1, next_ts, name and whether the table is dropped."""
    order = "PARTITION BY table_id ORDER BY commit_ts, seq"
    kind = F.lower("type")
    return ddl.dropDuplicates(["table_id", "commit_ts", "seq"]).select(
        "table_id", F.col("commit_ts").alias("ts"), F.expr(f"row_number() OVER ({order})").alias("version"), F.expr(f"lead(commit_ts) OVER ({order})").alias("next_ts"),
        "schema_name", "table_name", kind.isin("drop table", "truncate table").alias("gone"),
    )


def eligible(before: DataFrame) -> DataFrame:
    """verdict of DDLs by eligibility before and after: keep, skip, or error when an eligible table becomes ineligible."""
    b, a = F.coalesce("eligible_before", F.lit(False)), F.coalesce("eligible_after", F.lit(False))
    return before.withColumn("verdict", F.when(a, "keep").when(b, "error").otherwise("skip"))


def pessimistic_lock(submitted: DataFrame, sources: DataFrame) -> DataFrame:
    """For each target: how many shards submitted, whether all agree on one DDL list, and whether it may run."""
    seen = submitted.groupBy("target").agg(F.count_distinct("source").alias("ready"), F.count_distinct("ddls").alias("variants"), F.min("ddls").alias("ddls"))
    need = sources.groupBy("target").agg(F.count_distinct("source").alias("need"))
    joined = need.join(seen, "target", "left").fillna({"ready": 0, "variants": 0})
    return joined.withColumn("conflict", F.col("variants") > 1).withColumn("synced", (F.col("ready") == F.col("need")) & (F.col("variants") == 1))


#: Integer types from narrow to wide.
_WIDTH = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "bigint": 5}


def join_types(a: str, b: str) -> str:
    """The narrower type that holds both, or an error."""
    if a == b:
        return a
    if a in _WIDTH and b in _WIDTH:
        return max(a, b, key=_WIDTH.__getitem__)
    own = [re.fullmatch(r"(varchar|char)\((\d+)\)", t) for t in (a, b)]
    if all(own) and own[0][1] == own[1][1]:
        return max(a, b, key=lambda t: int(re.search(r"\d+", t)[0]))
    raise ValueError(f"{a} and {b} have no common type")


def join_schemas(schemas: Iterable[dict[str, tuple[str, bool]]]) -> dict[str, tuple[str, bool]]:
    """The least schema (name to type and nullable) that holds rows of all: a column that some lack must be nullable or is made so."""
    schemas = list(schemas)
    out: dict[str, tuple[str, bool]] = {}
    for s in schemas:
        for name, (kind, nullable) in s.items():
            old = out.get(name)
            out[name] = (kind, nullable) if old is None else (join_types(old[0], kind), old[1] or nullable)
    return {name: (kind, nullable or any(name not in s for s in schemas)) for name, (kind, nullable) in out.items()}


class OptimisticLock:
    """Each shard submits its next schema; the target gets DDL only when the joined schema changes.

    A schema that can't be joined, or that adds a column again while others have yet to drop it, is a conflict: the shard keeps its old
    schema in the lock and waits, until it submits one that fits, which resolves the conflict.
    """

    def __init__(self, shards: dict[str, dict[str, tuple[str, bool]]]) -> None:
        self.shards = dict(shards)
        self.joined = join_schemas(self.shards.values())
        self.waiting: set[str] = set()
        self.gone: set[str] = set()

    def dropping(self) -> set[str]:
        """Columns that some shards have dropped and others still have."""
        return {c for c in self.gone if any(c in s for s in self.shards.values())}

    def submit(self, shard: str, schema: dict[str, tuple[str, bool]]) -> tuple[str, list[str]]:
        """("none", "conflict" or "resolved", statements for the target)."""
        old = self.shards.get(shard, {})
        try:
            if (schema.keys() - old.keys()) & self.dropping():
                raise ValueError("a column that is being dropped")
            after = join_schemas((self.shards | {shard: schema}).values())
        except ValueError:
            self.waiting.add(shard)
            return "conflict", []
        self.gone |= old.keys() - schema.keys()
        self.shards[shard] = schema
        added = [f"ADD COLUMN {n} {t}" for n, (t, _) in after.items() if n not in self.joined]
        dropped = [f"DROP COLUMN {n}" for n in self.joined if n not in after]
        changed = [f"MODIFY COLUMN {n} {t}" for n, (t, _) in after.items() if n in self.joined and self.joined[n][0] != t]
        self.joined = after
        state = "resolved" if shard in self.waiting else "none"
        self.waiting.discard(shard)
        return state, added + changed + dropped


def table_kind(name: str) -> tuple[str, str]:
    """(real, shadow or trash, the real table's name)."""
    if m := re.match(SHADOW, name):
        return "shadow", m[1]
    if m := re.match(TRASH, name):
        return "trash", m[1]
    return "real", name


def collapse_online_ddl(events: Sequence[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(table, statement) to run, from ordered (kind, table, detail): alter statements on a shadow table are held until it is renamed to its real name.

    kind is alter (detail: the statement's specification), rename (detail: the new name), create or drop.
    """
    held: dict[str, list[str]] = {}
    out: list[tuple[str, str]] = []
    for kind, table, detail in events:
        role, real = table_kind(table)
        if role == "trash":
            continue
        if role == "shadow":
            if kind == "alter":
                held.setdefault(real, []).append(detail)
            elif kind in ("create", "drop"):
                held.pop(real, None)
            elif kind == "rename" and table_kind(detail) == ("real", real):
                out += [(real, spec) for spec in held.pop(real, [])]
        elif kind == "rename" and table_kind(detail)[0] == "trash":
            continue
        else:
            out.append((table, f"{kind} {detail}".strip()))
    return out
