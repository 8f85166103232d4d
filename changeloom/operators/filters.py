"""Row, event and column filters of a change log, and the rules they are built from."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas that no feed replicates.
SYSTEM_SCHEMAS = ("information_schema", "metrics_schema", "inspection_schema", "mysql", "performance_schema", "sys", "tidb_cdc", "lightning_task_info", "workload_schema")
#: Shadow and trash names of the usual online schema change tools.
SHADOW = "^_(.+)_(?:new|gho)$"
TRASH = "^_(.+)_(?:ghc|del|old)$"
#: Names of row events in filter rules.
DML_EVENTS = ("insert", "update", "delete")


def glob_regex(pattern: str) -> str:
    """A glob with * ? and [classes] (also [!classes]) as a regular expression without anchors."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and "]" in pattern[k + 1 :]:
            stop = pattern.index("]", k + 1)
            inner = pattern[k + 1 : stop]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            k = stop
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        k += 1
    return out


def table_regex(rule: str) -> tuple[str, str]:
    """Patterns of schema and table of a rule schema.table; either part is a glob, or a regular expression between slashes, or in quotes as it is."""
    parts, at = [], 0
    while at < len(rule) and len(parts) < 2:
        close = {"/": "/", "`": "`", '"': '"'}.get(rule[at])
        stop = rule.find(close, at + 1) if close else -1
        if close and stop > 0:
            inner, at = rule[at + 1 : stop], stop + 1
            parts.append(f"^(?:{inner})$" if close == "/" else f"^{re.escape(inner)}$")
        else:
            stop = rule.find(".", at)
            stop = len(rule) if stop < 0 else stop
            parts.append(f"^{glob_regex(rule[at:stop])}$")
            at = stop
        at += rule[at : at + 1] == "."
    return parts[0] if parts else "^$", parts[1] if len(parts) > 1 else "^.*$"


@dataclass(frozen=True)
class TableRules:
    """Rules schema.table, ! for exclusion; the last that matches decides, and without rules everything passes."""

    rules: tuple[str, ...] = ("*.*",)
    case_sensitive: bool = False

    def column(self, schema: str = "schema_name", table: str = "table_name") -> Column:
        fold = (lambda c: c) if self.case_sensitive else F.lower
        out = F.lit(False)
        for rule in self.rules:
            keep = not rule.startswith("!")
            left, right = table_regex(rule.lstrip("!") if self.case_sensitive else rule.lstrip("!").lower())
            hit = fold(F.col(schema)).rlike(left) & fold(F.col(table)).rlike(right)
            out = F.when(hit, F.lit(keep)).otherwise(out)
        return F.coalesce(out & ~F.lower(F.col(schema)).isin(*SYSTEM_SCHEMAS), F.lit(False))


@dataclass(frozen=True)
class EventRule:
    """Events to ignore in tables of a pattern; events are names, or all, none, all dml, all ddl, none dml, none ddl."""

    tables: TableRules = field(default_factory=TableRules)
    ignore: tuple[str, ...] = ()
    do: tuple[str, ...] = ()
    ignore_sql: tuple[str, ...] = ()
    action: str = "Ignore"


def _named(event: Column, names: Sequence[str]) -> Column:
    """Whether the event is listed; the first decisive entry of the list wins."""
    dml, out = event.isin(*DML_EVENTS), F.lit(False)
    for name in reversed([n.lower() for n in names]):
        decides = {"all": F.lit(True), "all dml": dml, "all ddl": ~dml, "none": F.lit(True), "none dml": dml, "none ddl": ~dml}.get(name, event == name)
        out = F.when(decides, F.lit(not name.startswith("none"))).otherwise(out)
    return out


def event_filtered(rules: Sequence[EventRule], event: str = "event", query: str | None = None) -> Column:
    """Whether an event is to be skipped: ignore lists beat do lists, statements may match a pattern; action Error raises."""
    out = F.lit(False)
    for rule in rules:
        name = F.lower(F.col(event))
        skip = _named(name, rule.ignore)
        if rule.do:
            skip = skip | ~_named(name, rule.do)
        if query and rule.ignore_sql:
            text = F.coalesce(F.col(query), F.lit(""))
            skip = skip | ((text != "") & text.rlike("|".join(f"(?:{p})" for p in rule.ignore_sql)))
        hit = rule.tables.column() & skip
        if rule.action == "Error":
            hit = F.when(hit, F.raise_error(F.concat(F.lit("event refused by rule: "), name)).cast("boolean")).otherwise(False)
        out = out | hit
    return out


def _fresh(taken: Sequence[str], name: str) -> str:
    while name in taken:
        name = "_" + name
    return name


def with_predicates(log: DataFrame, predicates: Mapping[str, tuple[str, str]]) -> DataFrame:
    """log with a boolean column for each (image, predicate); null, and an image that isn't there, are false.

    A predicate is analysed where the fields of its image stand beside the log's columns, which have other names there, so its
    text is never changed, and an unknown name is an error.
    """
    fields = log.schema["after"].dataType.names
    away = {c: _fresh(fields, f"_{k}_{c}") for k, c in enumerate([*log.columns, *predicates])}
    out = log.select(*(F.col(f"`{c}`").alias(away[c]) for c in log.columns))
    for side in ("before", "after"):
        own = {name: text for name, (image, text) in predicates.items() if image == side}
        if own:
            image = F.col(f"`{away[side]}`")
            found = [F.coalesce(image.isNotNull() & F.expr(text), F.lit(False)).alias(away[name]) for name, text in own.items()]
            out = out.select(*out.columns, F.col(f"`{away[side]}`.*")).select(*(F.col(f"`{c}`") for c in out.columns), *found)
    return out.select(*(F.col(f"`{away[c]}`").alias(c) for c in [*log.columns, *predicates]))


def check_predicate(spark: SparkSession, columns: T.StructType, predicate: str) -> str:
    """Why a predicate can't be used on rows of these columns; empty if it can."""
    try:
        kind = spark.createDataFrame([], columns).select(F.expr(predicate).alias("p")).schema["p"].dataType
    except (AnalysisException, ParseException) as e:
        return str(e).strip().split("\n")[0]
    return "" if isinstance(kind, (T.BooleanType, T.NumericType)) else f"{kind.simpleString()} is no truth value"


def mark_expression(log: DataFrame, insert: str = "false", update_old: str = "false", update_new: str = "false", delete: str = "false", into: str = "skipped") -> DataFrame:
    """Feed rule: skip an update whose old or new image matches; null keeps the row."""
    marked = with_predicates(log, {"_insert": ("after", insert), "_delete": ("before", delete), "_old": ("before", update_old), "_new": ("after", update_new)})
    skip = F.when(F.col("op") == "I", F.col("_insert")).when(F.col("op") == "D", F.col("_delete")).otherwise(F.col("_old") | F.col("_new"))
    return marked.withColumn(into, skip).select(*log.columns, into)


def mark_migration(log: DataFrame, rules: Sequence[dict[str, str]], into: str = "skipped") -> DataFrame:
    """Migration rule: an update is skipped only if old and new image match, a missing half counting as true; any rule may skip."""
    sides = {"insert": "after", "delete": "before", "update_old": "before", "update_new": "after"}
    marked = with_predicates(log, {f"_{k}_{name}": (sides[name], text) for k, rule in enumerate(rules) for name, text in rule.items()})
    out = F.lit(False)
    for k, rule in enumerate(rules):
        one = {name: F.col(f"_{k}_{name}") for name in rule}
        both = F.lit("update_old" in rule or "update_new" in rule)
        for name in ("update_old", "update_new"):
            both = both & one.get(name, F.lit(True))
        out = out | F.when(F.col("op") == "I", one.get("insert", F.lit(False))).when(F.col("op") == "D", one.get("delete", F.lit(False))).otherwise(both)
    return marked.withColumn(into, out).select(*log.columns, into)


def filter_rows(log: DataFrame, tables: TableRules, ignore_start_ts: Sequence[int] = (), events: Sequence[EventRule] = (), **expressions: str) -> DataFrame:
    """The row filter chain: start timestamps, table rules, event types, expressions."""
    named = log.withColumn("event", F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete"))
    keep = tables.column() & ~event_filtered(events)
    if ignore_start_ts:
        keep = ~F.col("start_ts").isin(*ignore_start_ts) & keep
    out = named.where(keep).drop("event")
    return mark_expression(out, **expressions, into="_skipped").where("NOT _skipped").drop("_skipped") if expressions else out


def filter_migration(log: DataFrame, tables: TableRules, events: Sequence[EventRule] = (), rules: Sequence[dict[str, str]] = ()) -> DataFrame:
    """The migration's chain: shadow and trash tables and system schemas, the allow list, event rules (action Error raises), expression rules."""
    named = log.withColumn("event", F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete"))
    helper = F.col("table_name").rlike(SHADOW) | F.col("table_name").rlike(TRASH)
    out = named.where(~helper & tables.column() & ~event_filtered(events)).drop("event")
    return mark_migration(out, rules, into="_skipped").where("NOT _skipped").drop("_skipped") if rules else out


def filter_ddl(ddl: DataFrame, tables: TableRules, allowed: Sequence[str], events: Sequence[EventRule] = ()) -> DataFrame:
    """discard (never in the catalog: not an allowed type, or table filtered) and ignore (in the catalog, not sent); renames match the old name."""
    own = ddl.withColumn("_now", F.col("table_name")).withColumn("table_name", F.when(F.lower("type").like("rename table%"), F.coalesce("pre_table_name", "table_name")).otherwise(F.col("table_name")))
    discard = ~F.lower("type").isin(*[a.lower() for a in allowed]) | ~tables.column()
    alter = F.lower(F.col("type")).rlike("^(add|drop|modify|rename|alter) (column|index)")
    ignore = event_filtered(events, "type", "query")
    for rule in events:
        ignore = ignore | (alter & rule.tables.column() & _named(F.lit("alter table"), rule.ignore))
    return own.withColumn("discard", discard).withColumn("ignore", ~discard & ignore).drop("table_name").withColumnRenamed("_now", "table_name")


@dataclass(frozen=True)
class ColumnSelector:
    """Of the first rule whose tables match, the columns that pass its rules are kept."""

    tables: str
    columns: tuple[str, ...]

    def kept(self, names: Sequence[str]) -> list[str]:
        out = []
        for name in names:
            keep = False
            for rule in self.columns:
                if re.fullmatch(glob_regex(rule.lstrip("!").lower()), name.lower()):
                    keep = not rule.startswith("!")
            if keep:
                out.append(name)
        return out


def select_columns(log: DataFrame, selectors: Sequence[ColumnSelector], schema: str, table: str, primary: Sequence[str], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Both images with only the selected columns; the full primary key or one full unique key must survive."""
    for s in selectors:
        left, right = table_regex(s.tables)
        if not (re.search(left, schema) and re.search(right, table)):
            continue
        kept = s.kept(log.schema["after"].dataType.names)
        if primary and not set(primary) <= set(kept) and not any(set(u) <= set(kept) for u in unique):
            raise ValueError(f"no primary or unique key of {schema}.{table} is selected")
        cut = {side: F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.{c}").alias(c) for c in kept))) for side in ("before", "after")}
        return log.withColumns(cut)
    return log


def only_updated(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Updates keep in their before image only what changed (and keys); what is equal becomes null."""
    names = log.schema["before"].dataType.names
    slim = F.struct(*((F.col(f"before.{c}") if c in keys else F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.col(f"before.{c}"))).alias(c) for c in names))
    return log.withColumn("before", F.when(F.col("op") == "U", slim).otherwise(F.col("before")))


def handle_keys_only(log: DataFrame, keys: Sequence[str], ops: Sequence[str] = ("D",)) -> DataFrame:
    """Images of the given operations reduced to the handle key columns; the rest becomes null."""
    def slim(side: str) -> Column:
        own = F.struct(*((F.col(f"{side}.{c}") if c in keys else F.lit(None).cast(f.dataType)).alias(c) for c, f in zip(log.schema[side].dataType.names, log.schema[side].dataType.fields, strict=True)))
        return F.when(F.col("op").isin(*ops) & F.col(side).isNotNull(), own).otherwise(F.col(side))

    return log.withColumns({side: slim(side) for side in ("before", "after")})


def fill_defaults(rows: DataFrame, defaults: dict[str, object], not_null: Sequence[str]) -> DataFrame:
    """Missing values: the origin default, else null where allowed, else the type's zero (empty text for strings)."""
    zeros = {"string": "", "boolean": False, "binary": b""}
    out = {}
    for f in rows.schema.fields:
        if f.name in defaults:
            out[f.name] = F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name in not_null:
            out[f.name] = F.coalesce(F.col(f.name), F.lit(zeros.get(f.dataType.simpleString(), 0)).cast(f.dataType))
    return rows.withColumns(out)


def mount(raw: DataFrame, columns: T.StructType, defaults: dict[str, object] | None = None, not_null: Sequence[str] = ()) -> DataFrame:
    """Raw entries (value and old_value as JSON text, null where absent) as changes with typed images; the operation is told by which are there.

    Columns that a text lacks get the origin default or, where null isn't allowed, the zero of their type.
    """

    def typed(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.from_json(side, columns))

    out = raw.withColumns({"after": typed("value"), "before": typed("old_value")}).where("value IS NOT NULL OR old_value IS NOT NULL")
    if defaults or not_null:
        zero = {"string": "", "boolean": False}

        def filled(side: str, f: T.StructField) -> Column:
            own = F.col(f"{side}.{f.name}")
            if f.name in (defaults or {}):
                own = F.coalesce(own, F.lit(defaults[f.name]).cast(f.dataType))
            return F.coalesce(own, F.lit(zero.get(f.dataType.simpleString(), 0)).cast(f.dataType)) if f.name in not_null else own

        out = out.withColumns({side: F.when(F.col(side).isNotNull(), F.struct(*(filled(side, f).alias(f.name) for f in columns.fields))) for side in ("before", "after")})
    op = F.when(F.col("before").isNull(), "I").when(F.col("after").isNull(), "D").otherwise("U")
    return out.withColumn("op", op).drop("value", "old_value")


def unsigned(value: Column, bits: int) -> Column:
    """A signed number of so many bits as the unsigned one of the same bits."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit(1 << bits).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def charset(value: Column, name: str) -> Column:
    """Bytes in a character set as text."""
    return F.decode(value, name)


def finite(value: Column) -> Column:
    """Not-a-number and infinities as zero."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
