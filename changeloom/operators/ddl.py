"""DDL as data: a catalog with columns from DDL events, statements split and classified, structures compared, pre-checks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VERSION = "table_id long, ts long, version long, next_ts long, schema_name string, table_name string, columns string, gone boolean"


def _change(columns: dict[str, str], kind: str, detail: str) -> dict[str, str]:
    """Columns (name to type) after a DDL; detail is `name type`, `name`, `old new` or, for a new table, a list of `name type`."""
    first, _, rest = detail.strip().partition(" ")
    if kind == "create table":
        return dict(part.strip().split(" ", 1) for part in detail.split(",") if part.strip())
    if kind in ("add column", "modify column"):
        return columns | {first: rest}
    if kind == "drop column":
        return {k: v for k, v in columns.items() if k != first}
    if kind == "rename column":
        return {rest if k == first else k: v for k, v in columns.items()}
    return columns


def catalog(events: DataFrame) -> DataFrame:
    """Every version of every table from DDL events (table_id, commit_ts, seq, type, schema_name, table_name, detail).

    There is one version for each timestamp; an event that comes again is skipped, and a dropped table has no columns.
    A table's DDLs are few, so they are folded in one task for each table.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, columns = [], {}
        rows = rows.drop_duplicates(["commit_ts", "seq"]).sort_values(["commit_ts", "seq"])
        for r in rows.itertuples():
            kind = r.type.lower()
            columns = {} if kind == "drop table" else _change(columns, kind, r.detail or "")
            new = (r.table_id, r.commit_ts, len(out) + 1, None, r.schema_name, r.table_name, ",".join(f"{k} {v}" for k, v in columns.items()), kind == "drop table")
            if out and out[-1][1] == r.commit_ts:
                out[-1] = (*new[:2], out[-1][2], *new[3:])
            else:
                out.append(new)
        ends = [r[1] for r in out[1:]] + [None]
        return pd.DataFrame([(*r[:3], end, *r[4:]) for r, end in zip(out, ends, strict=True)], columns=["table_id", "ts", "version", "next_ts", "schema_name", "table_name", "columns", "gone"])

    return events.groupBy("table_id").applyInPandas(fold, _VERSION)


def table_events(jobs: DataFrame, versions: DataFrame) -> DataFrame:
    """One event for each table of a job (id, type, finished_ts, tables array of schema_name, table_name, table_id), with the name before it.

    The name before is that of the newest version older than the job.
    """
    each = jobs.select("id", "type", "finished_ts", F.posexplode("tables").alias("part", "t")).select("id", "type", "finished_ts", "part", "t.*")
    old = versions.select(F.col("table_id").alias("_id"), "ts", "next_ts", F.col("schema_name").alias("pre_schema_name"), F.col("table_name").alias("pre_table_name"))
    match = (F.col("table_id") == F.col("_id")) & (F.col("ts") < F.col("finished_ts")) & (F.col("next_ts").isNull() | (F.col("finished_ts") <= F.col("next_ts")))
    return each.join(old, match, "left").drop("_id", "ts", "next_ts")


_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[(),]|[^\s(),'\"`]+|\s+", re.S)


def _parts(text: str) -> list[str]:
    """Text cut at commas outside of quotes and parentheses."""
    out, depth = [""], 0
    for token in _TOKEN.findall(text):
        depth += (token == "(") - (token == ")")
        if token == "," and not depth:
            out.append("")
        else:
            out[-1] += token
    return [p.strip() for p in out if p.strip()]


def _qualified(name: str, schema: str) -> str:
    parts = re.findall(r"`(?:[^`]|``)*`|[^.`\s]+", name)
    return ".".join(p if p.startswith("`") else f"`{p}`" for p in (parts if len(parts) > 1 else [schema, *parts]))


_NAME = r"(?:`(?:[^`]|``)*`|[^\s.`(]+)(?:\s*\.\s*(?:`(?:[^`]|``)*`|[^\s.`(]+))?"


def split_statement(sql: str, schema: str) -> list[str]:
    """A DDL as statements on one table and one specification each, with IF [NOT] EXISTS and full names; others stay as they are."""
    text = sql.strip().rstrip(";").strip()
    if m := re.match(r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(.*)$", text, re.I | re.S):
        return [f"DROP TABLE IF EXISTS {_qualified(p, schema)}" for p in _parts(m[1])]
    if m := re.match(r"RENAME\s+TABLE\s+(.*)$", text, re.I | re.S):
        pairs = [re.split(r"\s+TO\s+", p, flags=re.I) for p in _parts(m[1])]
        return [f"RENAME TABLE {_qualified(a, schema)} TO {_qualified(b, schema)}" for a, b in pairs]
    if m := re.match(rf"ALTER\s+TABLE\s+({_NAME})\s+(.*)$", text, re.I | re.S):
        return [f"ALTER TABLE {_qualified(m[1], schema)} {p}" for p in _parts(m[2])]
    if m := re.match(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*(.*)$", text, re.I | re.S):
        return [f"CREATE TABLE IF NOT EXISTS {_qualified(m[1], schema)} {m[2]}".strip()]
    if m := re.match(r"CREATE\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\S+)(.*)$", text, re.I | re.S):
        return [f"CREATE DATABASE IF NOT EXISTS {m[1]}{m[2]}".strip()]
    if m := re.match(r"DROP\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+EXISTS\s+)?(\S+)$", text, re.I):
        return [f"DROP DATABASE IF EXISTS {m[1]}"]
    return [text]


def split_ddl(ddl: DataFrame, query: str = "query", schema: str = "schema_name") -> DataFrame:
    """ddl with a row for each statement: part from 0 and statement."""
    names = [c for c in ddl.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            each = [split_statement(q, s) for q, s in zip(frame[query], frame[schema], strict=True)]
            out = frame.loc[frame.index.repeat([len(x) for x in each])].copy()
            out["part"] = [k for x in each for k in range(len(x))]
            out["statement"] = [s for x in each for s in x]
            yield out

    kinds = ", ".join(f"`{c}` {ddl.schema[c].dataType.simpleString()}" for c in names)
    return ddl.mapInPandas(run, f"{kinds}, part int, statement string")


#: Names of DDL events in filter rules, by how their statements begin.
DDL_EVENTS = (
    (r"create\s+(database|schema)\b", "create database"), (r"drop\s+(database|schema)\b", "drop database"), (r"alter\s+(database|schema)\b", "alter database"),
    (r"create\s+table\b", "create table"), (r"drop\s+table\b", "drop table"), (r"truncate\b", "truncate table"), (r"rename\s+table\b", "rename table"),
    (r"create\s+(unique\s+|fulltext\s+|spatial\s+)?index\b", "create index"), (r"drop\s+index\b", "drop index"), (r"create\s+(or\s+replace\s+)?view\b", "create view"), (r"drop\s+view\b", "drop view"),
)
#: Names of events of ALTER TABLE, by how a specification begins.
ALTER_EVENTS = (
    (r"(modify|change)\b", "modify column"), (r"rename\s+column\b", "rename column"), (r"rename\s+(index|key)\b", "rename index"), (r"rename\b", "rename table"), (r"drop\s+primary\s+key\b", "drop primary key"),
    (r"drop\s+partition\b", "drop table partition"), (r"truncate\s+partition\b", "truncate table partition"), (r"drop\s+(index|key)\b", "drop index"), (r"drop\s+(column\b|`|\w)", "drop column"),
    (r"alter\s+(column\s+)?\S+\s+(set|drop)\s+default\b", "modify default value"), (r"add\s+partition\b", "add table partition"), (r"add\s+(constraint\b|primary\s+key\b|unique\b|index\b|key\b)", "modify constraint"),
    (r"add\s+(column\b|`|\w|\()", "add column"), (r"(default\s+)?(character\s+set|charset)\b", "modify charset"), (r"(default\s+)?collate\b", "modify collation"), (r"engine\b", "modify storage engine"),
    (r"reorganize\s+partition\b", "reorganize partion"), (r"rebuild\s+partition\b", "rebuild partition"), (r"coalesce\s+partition\b", "coalesce partition"), (r"exchange\s+partition\b", "exchange partition"),
)


def event_type(statement: Column) -> Column:
    """The event name of a statement with one specification; null where none fits."""
    text = F.lower(F.trim(statement))
    spec = F.regexp_replace(text, rf"^alter\s+table\s+{_NAME}\s+", "")
    out = F.lit(None).cast("string")
    for pattern, name in reversed(ALTER_EVENTS):
        out = F.when(text.rlike(r"^alter\s+table\b") & spec.rlike(f"^{pattern}"), name).otherwise(out)
    for pattern, name in reversed(DDL_EVENTS):
        out = F.when(text.rlike(f"^{pattern}"), name).otherwise(out)
    return out


#: Integer types by bytes.
_BYTES = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "bigint": 8}


def narrows(old: str, new: str) -> bool:
    """Whether a column of the new type holds less than before: a smaller integer or length, fewer digits, another sign or class."""
    a, b = (re.fullmatch(r"\s*(\w+)\s*(?:\(([\d,\s]+)\))?\s*(unsigned)?.*", t.lower()) for t in (old, new))
    if not a or not b:
        return old != new
    if a[1] in _BYTES and b[1] in _BYTES:
        return _BYTES[b[1]] < _BYTES[a[1]] or bool(a[3]) != bool(b[3])
    if a[1] != b[1]:
        return True
    x, y = ([int(n) for n in (m[2] or "0").split(",")] for m in (a, b))
    if a[1] in ("decimal", "numeric"):
        x, y = ((v + [0])[:2] for v in (x, y))
        return y[1] < x[1] or y[0] - y[1] < x[0] - x[1]
    return y[0] < x[0]


@dataclass
class ColumnDef:
    name: str
    kind: str
    length: int = 0
    charset: str = ""
    collation: str = ""


@dataclass
class Structure:
    """A table's columns, its indices (name to columns) and its foreign keys (columns, parent, parent's columns)."""

    columns: list[ColumnDef]
    indices: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: Sequence[tuple[tuple[str, ...], str, tuple[str, ...]]] = ()


#: Types whose values compare.
_CLASSES = {**dict.fromkeys(("tinyint", "smallint", "mediumint", "int", "bigint"), "integer"), **dict.fromkeys(("float", "double"), "real"), **dict.fromkeys(("char", "varchar", "tinytext", "text", "mediumtext", "longtext"), "text")}


def compare_structures(a: Structure, b: Structure, ignore: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(differences of columns, after which data can't be compared; other differences).

    Indices that touch an ignored column don't count, those of one side only are told if both have some in common; foreign keys compare by definition.
    """
    left, right = ([c for c in s.columns if c.name not in ignore] for s in (a, b))
    stop = [f"{len(left)} and {len(right)} columns"] if len(left) != len(right) else []
    for x, y in zip(left, right, strict=False):
        if x.name.lower() != y.name.lower():
            stop.append(f"{x.name} and {y.name}")
        elif _CLASSES.get(x.kind, x.kind) != _CLASSES.get(y.kind, y.kind):
            stop.append(f"{x.name}: {x.kind} and {y.kind}")
        else:
            stop += [f"{x.name}: {what} {u} and {v}" for what, u, v in (("length", x.length, y.length), ("charset", x.charset, y.charset), ("collation", x.collation, y.collation)) if u and v and u != v]
    one, two = ({k: v for k, v in s.indices.items() if not set(v) & set(ignore)} for s in (a, b))
    common = one.keys() & two.keys()
    other = [f"index {k}: {','.join(one[k])} and {','.join(two[k])}" for k in sorted(common) if one[k] != two[k]]
    if common:
        other += [f"index {k} on one side" for k in sorted(one.keys() ^ two.keys())]
    other += [f"foreign key ({','.join(c)}) to {p} on one side" for c, p, _ in sorted(set(a.foreign) ^ set(b.foreign))]
    return stop, other


def pre_checks(tables: Mapping[str, Structure], settings: Mapping[str, str], shards: Mapping[str, Sequence[str]] | None = None, connections: int = 0, most_connections: int = 0) -> list[tuple[str, str, str]]:
    """(check, state, message) before a task begins: server settings, keys, charsets, equal shards, number of connections."""
    out = []
    for name, want in (("log_bin", "on"), ("binlog_format", "row"), ("binlog_row_image", "full")):
        got = settings.get(name, "").lower()
        out.append((name, "ok" if got in (want, "1" if want == "on" else want) else "fail", f"{name} is {got or 'unset'}"))
    version = tuple(int(x) for x in re.findall(r"\d+", settings.get("version", "0"))[:2])
    out.append(("version", "ok" if (5, 6) <= version else "warn", settings.get("version", "unset")))
    for name, table in sorted(tables.items()):
        keyed = any(k.lower() == "primary" or k.startswith("uk") for k in table.indices)
        out.append(("key", "ok" if keyed else "warn", f"{name} has {'a' if keyed else 'no'} primary or unique key"))
        if table.foreign:
            out.append(("foreign key", "warn", f"{name} has foreign keys"))
    for target, names in sorted((shards or {}).items()):
        faults = [x for other in names[1:] for x in compare_structures(tables[names[0]], tables[other])[0]]
        out.append(("shards", "fail" if faults else "ok", f"{target}: {faults[0] if faults else 'equal'}"))
    if most_connections:
        out.append(("connections", "ok" if connections <= most_connections else "warn", f"{connections} of {most_connections}"))
    return out
