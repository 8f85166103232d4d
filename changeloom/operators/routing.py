"""Table routing, column mapping, shard merging, topics and partitions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators.filters import table_regex

TOPIC_LENGTH = 249


def _hash_bytes(*parts: Column) -> Column:
    """XOR of CRC-32 sums is taken over calls; this is one call over concatenated bytes."""
    return F.crc32(F.encode(F.concat(*parts), "UTF-8"))


def inertia_hash(schema: Column, table: Column, values: Sequence[tuple[str, Column]] = ()) -> Column:
    """XOR of the CRC-32 of schema and table and of each column's name and value; null values are the text null."""
    out = _hash_bytes(schema, table)
    for name, value in values:
        out = out.bitwiseXOR(_hash_bytes(F.lit(name), F.coalesce(value.cast("string"), F.lit("null"))))
    return out


def partition(kind: str, n: int, schema: Column, table: Column, values: Sequence[tuple[str, Column]] = (), commit_ts: Column | None = None) -> Column:
    """Partition number: table (also default), ts, index-value (also rowid), columns, or key (always 0)."""
    if kind == "key":
        return F.lit(0).cast("int")
    if kind == "ts":
        return F.pmod(commit_ts, F.lit(n)).cast("int")
    if kind in ("table", "default"):
        values = ()
    elif kind not in ("index-value", "rowid", "columns"):
        raise ValueError(f"unknown partition rule: {kind}")
    return F.pmod(inertia_hash(schema, table, values), F.lit(n)).cast("int")


def topic(expression: str, schema: Column, table: Column) -> Column:
    """The topic of {schema} and {table} in an expression: other characters become _, at most 249 are kept, . and .. are replaced."""
    parts = [{"{schema}": schema, "{table}": table}.get(p, F.lit(p)) for p in re.split(r"(\{schema\}|\{table\})", expression) if p]
    cut = F.substring(F.regexp_replace(F.concat(*parts), "[^a-zA-Z0-9._-]", "_"), 1, TOPIC_LENGTH)
    return F.when(cut == ".", "_").when(cut == "..", "__").otherwise(cut)


def valid_topic(expression: str, protocol: str = "") -> bool:
    """Whether an expression names {schema} at most once before {table}; avro needs both, and {schema} at least otherwise unless constant."""
    plain = r"[A-Za-z0-9._-]*"
    if protocol == "avro":
        return bool(re.fullmatch(rf"{plain}\{{schema\}}{plain}\{{table\}}{plain}", expression))
    return bool(re.fullmatch(rf"{plain}(\{{schema\}})?{plain}(\{{table\}})?{plain}", expression)) and bool(expression)


def valid_pulsar_topic(expression: str) -> bool:
    """Whether an expression is a plain name, or a full one: (non-)persistent://tenant/namespace/topic."""
    if "persistent://" not in expression:
        return bool(expression) and "/" not in expression
    part = r"[A-Za-z0-9{}._-]*"
    return bool(re.fullmatch(rf"(persistent|non-persistent)://{part}/{part}/{part}", expression))


@dataclass(frozen=True)
class DispatchRule:
    """Tables of a pattern go to a topic expression by a partition rule; index names the index whose columns an index-value rule takes."""

    tables: str
    topic: str
    partition: str = "default"
    columns: tuple[str, ...] = ()
    index: str = ""

    def names(self, keys: Sequence[str], indexes: Mapping[str, Sequence[str]]) -> Sequence[str]:
        if self.index:
            if self.index not in indexes:
                raise ValueError(f"no index {self.index} for {self.tables}")
            return indexes[self.index]
        return self.columns or keys


def dispatch(log: DataFrame, rules: Sequence[DispatchRule], default_topic: str, n: int, keys: Sequence[str], indexes: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """topic and partition of each change: the first rule that matches, else the default topic by table.

    indexes: columns of named indexes; a rule that names another one, or columns that aren't there, is an error.
    """
    fields = set(log.schema["after"].dataType.names)
    schema, table = F.col("schema_name"), F.col("table_name")
    at, to = F.lit(default_topic), partition("default", n, schema, table)
    for rule in reversed(rules):
        left, right = table_regex(rule.tables.lower())
        hit = F.lower(schema).rlike(left) & F.lower(table).rlike(right)
        names = rule.names(keys, indexes or {})
        if missing := set(names) - fields:
            raise ValueError(f"no column {', '.join(sorted(missing))} for {rule.tables}")
        values = [(c, F.when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(f"before.{c}"))) for c in names]
        at = F.when(hit, topic(rule.topic, schema, table)).otherwise(at)
        to = F.when(hit, partition(rule.partition, n, schema, table, values, F.col("commit_ts"))).otherwise(to)
    return log.withColumn("topic", at).withColumn("partition", to)


def ddl_topic(ddl: DataFrame, rules: Sequence[DispatchRule], default_topic: str) -> DataFrame:
    """topic of each DDL, by the name before a rename; a DDL without a table goes to the default topic."""
    name = F.when(F.lower("type").like("rename table%"), F.coalesce("pre_table_name", "table_name")).otherwise(F.col("table_name"))
    schema, out = F.col("schema_name"), F.lit(default_topic)
    for rule in reversed(rules):
        left, right = table_regex(rule.tables.lower())
        hit = F.lower(schema).rlike(left) & F.lower(name).rlike(right)
        out = F.when(hit, topic(rule.topic, schema, name)).otherwise(out)
    return ddl.withColumn("topic", F.when(F.coalesce(name, F.lit("")) == "", F.lit(default_topic)).otherwise(out))


@dataclass(frozen=True)
class RouteRule:
    """Source tables of a pattern go to a target; without a target table the name stays."""

    schema: str
    table: str
    target_schema: str
    target_table: str = ""


def route(log: DataFrame, rules: Sequence[RouteRule]) -> DataFrame:
    """target_schema and target_table of each change; identity where no rule matches."""
    schema, table = F.col("schema_name"), F.col("table_name")
    to_s, to_t = schema, table
    for rule in reversed(rules):
        left, right = (table_regex(x)[0] for x in (rule.schema, rule.table))
        hit = schema.rlike(left) & table.rlike(right)
        to_s = F.when(hit, F.lit(rule.target_schema)).otherwise(to_s)
        to_t = F.when(hit, F.lit(rule.target_table) if rule.target_table else table).otherwise(to_t)
    return log.withColumn("target_schema", to_s).withColumn("target_table", to_t)


def extend(log: DataFrame, columns: Sequence[tuple[str, str, str]]) -> DataFrame:
    """New columns (name, source column, pattern with one group) taken from schema, table or source names."""
    return log.withColumns({name: F.regexp_extract(F.col(source), pattern, 1) for name, source, pattern in columns})


def add_prefix(value: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def add_suffix(value: Column, suffix: str) -> Column:
    return F.concat(value.cast("string"), F.lit(suffix))


def partition_id(value: Column, instance: int | None, schema: Column | None, table: Column | None, bits: tuple[int, int, int, int] = (4, 7, 8, 44)) -> Column:
    """instance, schema and table numbers packed above the value in 63 bits; parts left out give their bits to the value."""
    sizes = [b if p is not None else 0 for b, p in zip(bits[:3], (instance, schema, table), strict=True)]
    room = 63 - sum(sizes)
    out, shift = F.lit(0).cast("long"), 63
    for size, part in zip(sizes, (None if instance is None else F.lit(instance), schema, table), strict=True):
        if part is None:
            continue
        shift -= size
        whole = part.cast("long")
        checked = F.when((whole < 0) | (whole >= 1 << size), F.raise_error(F.lit("number out of range for its bits")).cast("long")).otherwise(whole)
        out = out.bitwiseOR(F.shiftleft(checked, shift))
    own = value.cast("long")
    return out.bitwiseOR(F.when((own < 0) | (own > (1 << room) - 1), F.raise_error(F.lit("value out of range for its bits")).cast("long")).otherwise(own))


def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All shards as one table; a column that a shard lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
