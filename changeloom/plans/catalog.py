"""The engine's registered queries, and SQL that gives the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import codecs
from changeloom.operators import changelog, diff, filters, redo, routing
from changeloom.plans import fixtures
from changeloom.plans.fixtures import BASE, LOG
from changeloom.streaming import feed

FLAGSHIP = "flagship"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ["o_orderkey"]
VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_WITH_LOG = f"WITH log AS ({LOG}), base AS ({BASE})"
_RANK = "CASE op WHEN 'D' THEN 0 WHEN 'U' THEN 1 ELSE 2 END"
_ORDER = f"commit_ts, start_ts, {_RANK}, seq"
_AT = f"({_ORDER})"
_AFTER = "a_custkey AS o_custkey, a_status AS o_orderstatus, a_price AS o_totalprice, a_priority AS o_orderpriority"


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _flat(changes: DataFrame, *columns: str) -> DataFrame:
    """Change rows with the fields of both images as columns."""
    short = {"o_custkey": "custkey", "o_orderstatus": "status", "o_totalprice": "price", "o_orderpriority": "priority"}
    images = [F.col(f"{side}.{c}").alias(f"{side[0]}_{s}") for side in ("before", "after") for c, s in short.items()]
    return changes.select(*columns, changelog.image("o_orderkey").alias("o_orderkey"), *images)


_IMAGES = "o_orderkey, b_custkey, b_status, b_price, b_priority, a_custkey, a_status, a_price, a_priority"

# The chain: filter, split, compact, apply.
_KEPT = f"""SELECT * FROM log WHERE table_name <> 'orders_old' AND start_ts NOT IN (1001, 2002)
  AND NOT CASE op WHEN 'I' THEN coalesce(a_price > 400000, false) WHEN 'D' THEN coalesce(b_priority = '5-LOW', false)
    ELSE coalesce(b_price < 2000, false) OR coalesce(a_price > 450000, false) END"""
_FINAL = f"""SELECT o_orderkey, arg_max(op, {_AT}) AS op, arg_max(a_custkey, {_AT}) AS a_custkey, arg_max(a_status, {_AT}) AS a_status, arg_max(a_price, {_AT}) AS a_price, arg_max(a_priority, {_AT}) AS a_priority FROM {{}} GROUP BY o_orderkey"""
_APPLIED = "SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM final) UNION ALL SELECT o_orderkey, " + _AFTER + " FROM final WHERE op <> 'D'"


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_rows(
        fixtures.log(spark, sf_dir), filters.TableRules(("shop.*", "!shop.orders_old")), (1001, 2002),
        insert="o_totalprice > 400000", delete="o_orderpriority = '5-LOW'", update_old="o_totalprice < 2000", update_new="o_totalprice > 450000",
    )


@_query(f"{_WITH_LOG}, kept AS ({_KEPT}), final AS ({_FINAL.format('kept')}) {_APPLIED}")
def flagship(spark, sf_dir):
    return changelog.apply_log(fixtures.base(spark, sf_dir), _filtered(spark, sf_dir), KEYS)


@_query(f"{_WITH_LOG} SELECT op, seq, {_IMAGES} FROM ({_KEPT})")
def filter_chain(spark, sf_dir):
    return _flat(_filtered(spark, sf_dir), "op", "seq")


@_query(f"{_WITH_LOG} SELECT seq, row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) AS position FROM log")
def commit_order(spark, sf_dir):
    return changelog.number_by_commit(fixtures.log(spark, sf_dir), ["table_id"]).select("seq", F.col("position").cast("long").alias("position"))


@_query(f"{_WITH_LOG} SELECT seq, commit_ts, start_ts FROM log WHERE commit_ts BETWEEN 2000 AND 3010 AND (commit_ts > 2000 OR start_ts >= 1995) AND (commit_ts < 3010 OR start_ts <= 3004)")
def fetch_range(spark, sf_dir):
    return changelog.fetch_range(fixtures.log(spark, sf_dir), (2000, 1995), (3010, 3004)).select("seq", "commit_ts", "start_ts")


@_query(f"""{_WITH_LOG} SELECT seq, coalesce(lead(commit_ts) OVER w <> commit_ts OR lead(start_ts) OVER w <> start_ts, true) AS txn_finished
FROM log WINDOW w AS (PARTITION BY table_id ORDER BY {_ORDER})""")
def txn_boundary(spark, sf_dir):
    return changelog.mark_txn_ends(fixtures.log(spark, sf_dir), ["table_id"]).select("seq", "txn_finished")


@_query(f"""{_WITH_LOG}, cut AS (SELECT *, op = 'U' AND b_custkey <> a_custkey AS moved FROM log)
SELECT seq, op, o_orderkey, b_custkey, a_custkey FROM cut WHERE NOT moved
UNION ALL SELECT seq, 'D', o_orderkey, b_custkey, NULL FROM cut WHERE moved UNION ALL SELECT seq, 'I', o_orderkey, NULL, a_custkey FROM cut WHERE moved""")
def split_key_update(spark, sf_dir):
    out = changelog.split_key_updates(fixtures.log(spark, sf_dir), ["o_orderkey", "o_custkey"])
    return _flat(out, "seq", "op").select("seq", "op", "o_orderkey", "b_custkey", "a_custkey")


@_query(f"""{_WITH_LOG} SELECT seq, op, commit_ts FROM log WHERE op <> 'U' OR commit_ts >= 2040
UNION ALL SELECT seq, x, commit_ts FROM log, (VALUES ('D'), ('I')) AS t(x) WHERE op = 'U' AND commit_ts < 2040""")
def split_at_start(spark, sf_dir):
    return changelog.split_updates(fixtures.log(spark, sf_dir), "start", 2040).select("seq", "op", "commit_ts")


@_query(f"""{_WITH_LOG} SELECT o_orderkey, CASE WHEN arg_max(op, {_AT}) = 'D' THEN 'D' WHEN bool_or(op = 'D') OR arg_min(op, {_AT}) = 'I' THEN 'I' ELSE 'U' END AS op,
  bool_or(op = 'D') AND arg_max(op, {_AT}) <> 'D' AS safe_mode, arg_max(seq, {_AT}) AS seq, count(*) AS merged,
  CASE WHEN arg_max(op, {_AT}) <> 'D' THEN arg_max(a_price, {_AT}) END AS a_price FROM log GROUP BY o_orderkey""")
def compaction(spark, sf_dir):
    out = changelog.compact(fixtures.log(spark, sf_dir), KEYS)
    return out.select("o_orderkey", "op", "safe_mode", "seq", "merged", F.col("after.o_totalprice").alias("a_price"))


@_query(f"{_WITH_LOG}, final AS ({_FINAL.format('log')}) {_APPLIED}")
def apply_changes(spark, sf_dir):
    return changelog.apply_log(fixtures.base(spark, sf_dir), fixtures.log(spark, sf_dir), KEYS)


@_query(f"{_WITH_LOG} SELECT seq, CASE op WHEN 'D' THEN 'DELETE' WHEN 'U' THEN 'UPDATE' ELSE CASE WHEN commit_ts > 1050 THEN 'INSERT' ELSE 'REPLACE' END END AS statement FROM log")
def insert_or_replace(spark, sf_dir):
    return changelog.insert_or_replace(fixtures.log(spark, sf_dir), False, F.lit(1050)).select("seq", "statement")


@_query(f"""{_WITH_LOG} SELECT seq, CASE WHEN op = 'D' THEN 'DELETE' ELSE 'REPLACE' END AS statement FROM log
UNION ALL SELECT seq, 'DELETE' FROM log WHERE op = 'U' AND b_custkey <> a_custkey""")
def safe_mode_rewrite(spark, sf_dir):
    return changelog.safe_mode(fixtures.log(spark, sf_dir), ["o_orderkey", "o_custkey"]).select("seq", "statement")


@_query(f"{_WITH_LOG} SELECT seq, concat_ws('.', o_orderkey, coalesce(a_custkey, b_custkey)) AS identity FROM log")
def identity_key(spark, sf_dir):
    return fixtures.log(spark, sf_dir).select("seq", changelog.identity(["o_orderkey", "o_custkey"], []).alias("identity"))


@_query(f"""{_WITH_LOG} SELECT seq, list_sort(list_distinct(list_filter([CASE WHEN op <> 'I' THEN 'orders|o_orderkey=' || o_orderkey END, CASE WHEN op <> 'D' THEN 'orders|o_orderkey=' || o_orderkey END,
  CASE WHEN op <> 'I' THEN 'orders|o_custkey=' || b_custkey || '|o_orderstatus=' || lower(b_status) END, CASE WHEN op <> 'D' THEN 'orders|o_custkey=' || a_custkey || '|o_orderstatus=' || lower(a_status) END],
  lambda x: x IS NOT NULL))) AS keys FROM log""")
def causality_keys(spark, sf_dir):
    keys = changelog.causality_keys(F.lit("orders"), [["o_orderkey"], ["o_custkey", "o_orderstatus"]], VALUES, True, ["o_orderstatus"])
    return fixtures.log(spark, sf_dir).select("seq", F.array_sort(keys).alias("keys"))


@_query(f"{_WITH_LOG} SELECT seq, {_RANK} AS batch_rank, CAST((row_number() OVER (PARTITION BY commit_ts, start_ts, op ORDER BY seq) - 1) // 8 AS BIGINT) AS statement_no FROM log")
def batched_statements(spark, sf_dir):
    return changelog.batch_order(fixtures.log(spark, sf_dir), 8).select("seq", "batch_rank", "statement_no")


@_query(f"""{_WITH_LOG}, marked AS (SELECT seq, table_id, CASE WHEN lag(op) OVER (PARTITION BY table_id ORDER BY {_ORDER}) IS NOT DISTINCT FROM op THEN 0 ELSE 1 END AS new, row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) AS rn FROM log)
SELECT seq, CAST(sum(new) OVER (PARTITION BY table_id ORDER BY rn) AS BIGINT) AS group_no FROM marked""")
def statement_groups(spark, sf_dir):
    return changelog.statement_groups(fixtures.log(spark, sf_dir), ["table_id"], ["op"]).select("seq", "group_no")


_VERSIONS = "SELECT * FROM (VALUES (0, 900, 1), (0, 2005, 2), (0, 3010, 3), (1, 950, 1), (1, 2050, 2), (2, 1010, 1)) AS t(table_id, ts, version)"


@_query(f"""{_WITH_LOG}, versions AS ({_VERSIONS}) SELECT seq, (SELECT max(version) FROM versions v WHERE v.table_id = log.table_id AND v.ts < log.commit_ts) AS version FROM log""")
def schema_as_of(spark, sf_dir):
    versions = spark.sql(_VERSIONS).select(F.col("table_id").cast("long").alias("table_id"), F.col("ts").cast("long").alias("ts"), "version")
    return changelog.as_of(fixtures.log(spark, sf_dir).select("seq", "table_id", "commit_ts"), versions, "table_id", missing="null").select("seq", "version")


@_query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_per_group(spark, sf_dir):
    rows = fixtures.tables(spark, sf_dir, "events")["events"].select("user_id", "ts", "event_id", "value")
    return changelog.latest_per_group(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@_query(f"{_WITH_LOG} SELECT min(ts) AS watermark FROM (SELECT table_id, max(commit_ts) AS ts FROM log GROUP BY table_id)")
def watermark_frontier(spark, sf_dir):
    return changelog.frontier(fixtures.log(spark, sf_dir), ["table_id"], "commit_ts")


@_query(f"""{_WITH_LOG} SELECT seq, op FROM log WHERE NOT CASE op WHEN 'I' THEN false WHEN 'D' THEN coalesce(b_price > 300000, false)
  ELSE coalesce(b_price > 100000, false) AND coalesce(a_custkey % 2 = 0, false) OR coalesce(a_price < 5000, false) END""")
def migration_expression_filter(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    rules = [{"delete": "o_totalprice > 300000", "update_old": "o_totalprice > 100000", "update_new": "o_custkey % 2 = 0"}, {"update_new": "o_totalprice < 5000"}]
    return filters.mark_migration(own, rules).where("NOT skipped").select("seq", "op")


_DDL = """SELECT * FROM (VALUES (1, 'create table', 'shop', 'a', NULL, 'CREATE TABLE a (x INT)'), (2, 'add column', 'shop', 'a', NULL, 'ALTER TABLE a ADD COLUMN y INT'),
  (3, 'drop table', 'shop', 'b', NULL, 'DROP TABLE b'), (4, 'rename table', 'shop', 'c', 'a', 'RENAME TABLE a TO c'), (5, 'create view', 'shop', 'v', NULL, 'CREATE VIEW v AS SELECT 1'),
  (6, 'truncate table', 'mysql', 'user', NULL, 'TRUNCATE TABLE user'), (7, 'add index', 'shop', 'd', NULL, 'ALTER TABLE d ADD INDEX i (x)')) AS t(id, type, schema_name, table_name, pre_table_name, query)"""


@_query(f"""SELECT id, discard, NOT discard AND ignored AS ignore FROM (SELECT id, type IN ('create view') OR schema_name = 'mysql' AS discard, type = 'drop table' OR regexp_matches(query, 'ADD\\s+INDEX') AS ignored FROM ({_DDL}))""")
def ddl_filter(spark, sf_dir):
    allowed = ["create table", "add column", "drop table", "rename table", "truncate table", "add index"]
    out = filters.filter_ddl(spark.sql(_DDL), filters.TableRules(), allowed, [filters.EventRule(ignore=("drop table",), ignore_sql=(r"ADD\s+INDEX",))])
    return out.select("id", "discard", "ignore")


@_query(f"{_WITH_LOG} SELECT seq, op FROM log WHERE op <> 'D' AND table_name = 'orders' OR table_name <> 'orders'")
def event_filter(spark, sf_dir):
    rules = [filters.EventRule(filters.TableRules(("shop.orders",)), ignore=("delete", "all ddl"))]
    return filters.filter_rows(fixtures.log(spark, sf_dir), filters.TableRules(), events=rules).select("seq", "op")


@_query(f"{_WITH_LOG} SELECT seq, o_orderkey, coalesce(a_price, b_price) AS price FROM log")
def column_selector(spark, sf_dir):
    selected = filters.select_columns(fixtures.log(spark, sf_dir), [filters.ColumnSelector("other.*", ("*",)), filters.ColumnSelector("shop.*", ("*", "!o_order*", "o_orderkey", "!o_custkey"))], "shop", "orders", KEYS)
    assert selected.schema["after"].dataType.names == ["o_orderkey", "o_totalprice"]
    return selected.select("seq", changelog.image("o_orderkey").alias("o_orderkey"), changelog.image("o_totalprice").alias("price"))


@_query(f"""{_WITH_LOG} SELECT seq, CASE WHEN op = 'U' AND b_custkey = a_custkey THEN NULL ELSE b_custkey END AS b_custkey, CASE WHEN op = 'U' AND b_price = a_price THEN NULL ELSE b_price END AS b_price,
  CASE WHEN op = 'U' AND b_priority = a_priority THEN NULL ELSE b_priority END AS b_priority FROM log""")
def only_updated_columns(spark, sf_dir):
    return _flat(filters.only_updated(fixtures.log(spark, sf_dir), KEYS), "seq").select("seq", "b_custkey", "b_price", "b_priority")


@_query(f"{_WITH_LOG} SELECT seq, CASE WHEN table_name = 'orders_old' THEN 'archive' ELSE schema_name END AS target_schema, CASE WHEN table_name LIKE 'orders%' AND table_name <> 'orders_old' THEN 'all_orders' ELSE table_name END AS target_table FROM log")
def table_route(spark, sf_dir):
    rules = [routing.RouteRule("shop", "orders_old", "archive"), routing.RouteRule("shop", "orders*", "shop", "all_orders")]
    return routing.route(fixtures.log(spark, sf_dir), rules).select("seq", "target_schema", "target_table")


@_query("""SELECT o_orderkey, 'x' || o_custkey AS prefixed, o_custkey || 'y' AS suffixed, (CAST(2 AS BIGINT) << 59) | (CAST(o_orderkey % 100 AS BIGINT) << 52) | (CAST(o_orderkey % 7 AS BIGINT) << 44) | o_orderkey AS packed FROM orders""")
def column_mapping(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    return orders.select("o_orderkey", routing.add_prefix(F.col("o_custkey"), "x").alias("prefixed"), routing.add_suffix(F.col("o_custkey"), "y").alias("suffixed"), routing.partition_id(F.col("o_orderkey"), 2, F.col("o_orderkey") % 100, F.col("o_orderkey") % 7).alias("packed"))


@_query("SELECT o_orderkey, o_custkey, 'shard_' || (o_orderkey % 2) AS source_table, CAST(o_orderkey % 2 AS VARCHAR) AS shard_no FROM orders")
def shard_merge(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_custkey")
    shards = [orders.where(F.col("o_orderkey") % 2 == k).withColumn("source_table", F.lit(f"shard_{k}")) for k in (0, 1)]
    return routing.extend(routing.merge_shards(shards), [("shard_no", "source_table", r"shard_(\d+)")])


@_query(f"{_WITH_LOG} SELECT seq, CASE WHEN table_name = 'orders_old' THEN 'old_shop_x' ELSE 'main' END AS topic, CAST(CASE WHEN table_name = 'orders_old' THEN commit_ts % 5 ELSE {zlib.crc32(b'shoporders') % 5} END AS INTEGER) AS partition FROM log")
def topic_dispatch(spark, sf_dir):
    rules = [routing.DispatchRule("shop.*_old", "old_{schema}_x", "ts")]
    return routing.dispatch(fixtures.log(spark, sf_dir), rules, "main", 5, KEYS).select("seq", "topic", "partition")


#: A CRC-32 in SQL: the table of its 256 remainders, and a sum over the bytes of an ASCII text.
CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"


def crc32(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


@_query(f"""{_WITH_LOG}, {CRC}, base_hash AS (SELECT table_name, {crc32("'shop' || table_name")} AS h FROM (SELECT DISTINCT table_name FROM log), crc)
SELECT seq, CASE WHEN table_name = 'orders' THEN 'shop.orders' ELSE 'rest' END AS topic,
  CAST(xor(h, CASE WHEN table_name = 'orders' THEN {crc32("'o_orderkey' || o_orderkey")} ELSE {crc32("'o_custkey' || coalesce(a_custkey, b_custkey)")} END) % 16 AS INTEGER) AS partition FROM log JOIN base_hash USING (table_name), crc""")
def index_value_dispatch(spark, sf_dir):
    rules = [routing.DispatchRule("shop.orders", "{schema}.{table}", "index-value"), routing.DispatchRule("*.*", "rest", "columns", ("o_custkey",))]
    return routing.dispatch(fixtures.log(spark, sf_dir), rules, "main", 16, KEYS).select("seq", "topic", "partition")


def _checksum_sql(table: str, group: str, text: str) -> str:
    half = "CAST(('0x' || substring(m, {}, 16)) AS UBIGINT)"
    return f"SELECT {group}, count(*) AS row_count, CAST(bit_xor(xor({half.format(1)}, {half.format(17)})) AS DECIMAL(20,0)) AS checksum FROM (SELECT *, md5({text}) AS m FROM {table}) GROUP BY 1"


_TEXT = "concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, '0000')"


def _order_text() -> F.Column:
    return diff.row_text([(F.col(c), F.col(c).cast("string")) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")])


@_query(_checksum_sql("orders", "o_orderkey % 64 AS chunk", _TEXT))
def chunk_checksum(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    return diff.checksums(orders, _order_text(), [(F.col("o_orderkey") % 64).alias("chunk")])


@_query(_checksum_sql("orders", "1 AS all_rows", _TEXT))
def shard_checksum(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    parts = [diff.checksums(orders.where(F.col("o_orderkey") % 3 == k), _order_text(), [F.lit(1).alias("all_rows")]) for k in range(3)]
    return diff.combine_checksums(routing.merge_shards(parts), ["all_rows"])


_CHANGED = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 17 = 0 THEN o_totalprice + 0.0000001 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 19 <> 0"
_EXTRA = "SELECT o_orderkey + 100000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 23 = 0"
_DIFF = f"""WITH s AS (SELECT o_orderkey, {", ".join(VALUES)} FROM orders), t AS ({_CHANGED} UNION ALL {_EXTRA}), j AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
  CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'DELETE' WHEN abs(s.o_totalprice - t.o_totalprice) > 1e-6 THEN 'REPLACE' END AS repair FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    target = spark.sql(f"{_CHANGED} UNION ALL {_EXTRA}".replace("FROM orders", "FROM {orders}"), orders=orders)
    return orders.select("o_orderkey", *VALUES), target


@_query(f"{_DIFF} SELECT o_orderkey, repair FROM j WHERE repair IS NOT NULL")
def table_diff(spark, sf_dir):
    return diff.compare_rows(*_pair(spark, sf_dir), KEYS, VALUES).select("o_orderkey", "repair")


@_query(f"{_DIFF} SELECT o_orderkey, repair FROM j WHERE repair IS NOT NULL")
def checksum_first_diff(spark, sf_dir):
    return diff.diff(*_pair(spark, sf_dir), KEYS, VALUES, 1024).select("o_orderkey", "repair")


@_query(f"{_DIFF} SELECT CAST(count(*) FILTER (repair = 'INSERT') AS BIGINT) AS n_insert, CAST(count(*) FILTER (repair = 'DELETE') AS BIGINT) AS n_delete, CAST(count(*) FILTER (repair = 'REPLACE') AS BIGINT) AS n_replace FROM j")
def diff_summary(spark, sf_dir):
    return diff.summary(diff.compare_rows(*_pair(spark, sf_dir), KEYS, VALUES))


@_query(f"""{_DIFF} SELECT j.o_orderkey, CASE WHEN repair = 'DELETE' THEN 'DELETE FROM shop.orders WHERE `o_orderkey` = ' || t.o_orderkey || ' AND `o_custkey` = ' || t.o_custkey || ' LIMIT 1;'
  ELSE 'REPLACE INTO shop.orders(`o_orderkey`,`o_custkey`) VALUES (' || s.o_orderkey || ',' || s.o_custkey || ');' END AS statement
FROM j LEFT JOIN s ON s.o_orderkey = j.o_orderkey LEFT JOIN t ON t.o_orderkey = j.o_orderkey WHERE repair IS NOT NULL""")
def repair_statements(spark, sf_dir):
    return diff.repair_sql(diff.compare_rows(*_pair(spark, sf_dir), KEYS, VALUES), "shop.orders", ["o_orderkey", "o_custkey"]).select("o_orderkey", "statement")


@_query("SELECT CAST((rn - 1) // 500 AS BIGINT) AS chunk, max(o_orderkey) AS upper, lag(max(o_orderkey)) OVER (ORDER BY (rn - 1) // 500) AS lower, count(*) AS n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY (rn - 1) // 500")
def limit_chunks(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    return diff.chunk_bounds(orders, KEYS, 500).select("chunk", F.col("upper.o_orderkey").alias("upper"), F.col("lower.o_orderkey").alias("lower"), "n")


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey > 100 OR l_orderkey = 100 AND l_linenumber > 3) AND (l_orderkey < 900 OR l_orderkey = 900 AND l_linenumber <= 2)")
def chunk_range_scan(spark, sf_dir):
    lines = fixtures.tables(spark, sf_dir, "lineitem")["lineitem"]
    return lines.where(diff.range_predicate(["l_orderkey", "l_linenumber"], (100, 3), (900, 2))).select("l_orderkey", "l_linenumber", "l_partkey")


@_query("SELECT count(DISTINCT o_orderkey) / count(*) AS o_orderkey, count(DISTINCT o_custkey) / count(*) AS o_custkey, count(DISTINCT o_orderstatus) / count(*) AS o_orderstatus FROM orders")
def index_selectivity(spark, sf_dir):
    return diff.selectivity(fixtures.tables(spark, sf_dir, "orders")["orders"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@_query(f"""{_WITH_LOG}, lines AS (SELECT *, 0 AS line_no, op AS k, o_orderkey AS id, CASE WHEN op = 'I' THEN a_custkey ELSE b_custkey END AS c, CASE WHEN op = 'I' THEN a_status ELSE b_status END AS s FROM log WHERE op <> 'U'
  UNION ALL SELECT *, 0, 'D', o_orderkey, b_custkey, b_status FROM log WHERE op = 'U' UNION ALL SELECT *, 1, 'I', o_orderkey, a_custkey, a_status FROM log WHERE op = 'U')
SELECT seq, line_no, concat_ws(',', '"' || k || '"', '"' || table_name || '"', '"' || schema_name || '"', commit_ts, op = 'U', id, c, '"' || s || '"') AS line FROM lines""")
def csv_encode(spark, sf_dir):
    own = filters.select_columns(fixtures.log(spark, sf_dir), [filters.ColumnSelector("*.*", ("o_orderkey", "o_custkey", "o_orderstatus"))], "shop", "orders", KEYS)
    return codecs.csv_lines(own, old_value=True).select("seq", "line_no", "line")


@_query(f"{_WITH_LOG} SELECT schema_name, table_name, op, commit_ts, {_IMAGES} FROM log")
def canal_json_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    sent = own.select(codecs.canal_json(own, KEYS).alias("message"))
    return _flat(codecs.from_canal_json(sent, own.schema["after"].dataType), "schema_name", "table_name", "op", "commit_ts")


@_query(f"{_WITH_LOG} SELECT schema_name, table_name, op, commit_ts, {_IMAGES} FROM log")
def debezium_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    sent = own.select(codecs.debezium(own).alias("message"))
    return _flat(codecs.from_debezium(sent, own.schema["after"].dataType), "schema_name", "table_name", "op", "commit_ts")


@_query(f"""{_WITH_LOG} SELECT seq, '{{"ts":' || commit_ts || ',"scm":"shop","tbl":"' || table_name || '","t":1}}' AS key FROM log""")
def open_protocol_keys(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    return own.select("seq", codecs.open_protocol(own, KEYS)[0].alias("key"))


def narrow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with three columns in each image."""
    return filters.select_columns(fixtures.log(spark, sf_dir), [filters.ColumnSelector("*.*", ("o_orderkey", "o_custkey", "o_orderstatus"))], "shop", "orders", KEYS)


def _open_side(p: str) -> str:
    return f"""'{{"o_custkey":{{"t":8,"f":0,"v":' || {p}_custkey || '}},"o_orderkey":{{"t":8,"h":true,"f":11,"v":' || o_orderkey || '}},"o_orderstatus":{{"t":15,"f":0,"v":"' || {p}_status || '"}}}}'"""


def _row_side(p: str, quote: str) -> str:
    return f"""'{{"o_orderkey":{quote}' || o_orderkey || '{quote},"o_custkey":{quote}' || {p}_custkey || '{quote},"o_orderstatus":"' || {p}_status || '"}}'"""


_SIMPLE_HEAD = """'{"version":1,"database":"shop","table":"' || table_name || '","tableID":' || table_id || ',"type":"' || CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END || '","commitTs":' || commit_ts || ',"schemaVersion":1,'"""
_CHANGED_CELLS = """concat_ws(',', CASE WHEN b_custkey <> a_custkey THEN '"o_custkey":' || b_custkey END, CASE WHEN b_status <> a_status THEN '"o_orderstatus":"' || b_status || '"' END)"""


@_query(f"""{_WITH_LOG} SELECT seq,
  CASE op WHEN 'I' THEN '{{"u":' || {_open_side('a')} || '}}' WHEN 'U' THEN '{{"u":' || {_open_side('a')} || ',"p":' || {_open_side('b')} || '}}' ELSE '{{"d":' || {_open_side('b')} || '}}' END AS open,
  {_SIMPLE_HEAD} || CASE op WHEN 'I' THEN '"data":' || {_row_side('a', '"')} WHEN 'U' THEN '"data":' || {_row_side('a', '"')} || ',"old":' || {_row_side('b', '"')} ELSE '"old":' || {_row_side('b', '"')} END || '}}' AS simple,
  '{{"database":"shop","table":"' || table_name || '","type":"' || CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END || '","ts":0,"data":' || CASE op WHEN 'D' THEN {_row_side('b', '')} ELSE {_row_side('a', '')} END
    || CASE op WHEN 'U' THEN ',"old":{{' || {_CHANGED_CELLS} || '}}}}' ELSE '}}' END AS maxwell FROM log""")
def other_codecs(spark, sf_dir):
    own = narrow_log(spark, sf_dir)
    return own.select("seq", codecs.open_protocol(own, KEYS)[1].alias("open"), codecs.simple(own).alias("simple"), codecs.maxwell(own).alias("maxwell"))


@_query(f"{_WITH_LOG} SELECT seq, CAST((commit_ts > 2010)::INT + (commit_ts > 3020)::INT AS INTEGER) AS segment FROM log")
def ddl_segments(spark, sf_dir):
    return redo.segments(fixtures.log(spark, sf_dir), [2010, 3020]).select("seq", "segment")


@_query(f"{_WITH_LOG}, part AS (SELECT * FROM log WHERE commit_ts > 1020 AND commit_ts <= 3040), final AS ({_FINAL.format('part')}) {_APPLIED}")
def redo_replay(spark, sf_dir):
    own = fixtures.log(spark, sf_dir).where((F.col("commit_ts") > 1020) & (F.col("commit_ts") <= 3040))
    return redo.replay(fixtures.base(spark, sf_dir), own, KEYS)


_NEWEST = f"newest AS (SELECT o_orderkey, arg_max(op, {_AT}) AS op, arg_max(seq, {_AT}) AS seq, arg_max(a_custkey, {_AT}) AS a_custkey, arg_max(a_status, {_AT}) AS a_status, arg_max(a_price, {_AT}) AS a_price FROM log GROUP BY o_orderkey)"


@_query(f"""{_WITH_LOG}, {_NEWEST}
SELECT o_orderkey, seq, CASE WHEN op = 'D' THEN 'not deleted' ELSE 'missing' END AS fault FROM newest WHERE (op = 'D') = (o_orderkey % 10 <> 0)""")
def validator(spark, sf_dir):
    return feed.validate(fixtures.log(spark, sf_dir), fixtures.base(spark, sf_dir), KEYS, VALUES, full=False)


@_query(f"""{_WITH_LOG}, {_NEWEST}, j AS (SELECT newest.*, base.o_orderkey IS NOT NULL AS there, o_custkey, o_orderstatus, o_totalprice FROM newest LEFT JOIN base USING (o_orderkey))
SELECT o_orderkey, seq, CASE WHEN op = 'D' THEN 'not deleted' WHEN NOT there THEN 'missing' ELSE 'different' END AS fault FROM j
WHERE CASE WHEN op = 'D' THEN there WHEN NOT there THEN true ELSE a_custkey <> o_custkey OR a_status <> o_orderstatus OR a_price <> o_totalprice END""")
def validator_full(spark, sf_dir):
    return feed.validate(fixtures.log(spark, sf_dir), fixtures.base(spark, sf_dir), KEYS, VALUES)


_PAIRS = "SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN rn % 2 = 1 THEN after_key ELSE before_key END AS other FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS after_key, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS before_key FROM orders) AS numbered"


@_query(f"WITH pairs AS ({_PAIRS}) SELECT p.k AS id, coalesce(CASE WHEN greatest(p.k, p.other) % 3 = 0 THEN q.c END, p.c) AS owner FROM pairs p LEFT JOIN pairs q ON q.k = p.other")
def swapped_keys(spark, sf_dir):
    """Two rows exchange their keys in one transaction, and seq runs against the order of commits."""
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    pairs = fixtures.pairs(orders, "k")
    base = orders.select(F.col("k").alias("id"), F.col("c").alias("owner"))
    row = lambda key: F.struct(F.col(key).alias("id"), F.col("c").alias("owner"))
    moved = pairs.where("greatest(k, other) % 3 = 0 AND other IS NOT NULL").select(F.lit("U").alias("op"), F.lit(7).alias("commit_ts"), F.lit(6).alias("start_ts"), (-F.col("k")).alias("seq"), row("k").alias("before"), row("other").alias("after"))
    return changelog.apply_log(base, moved, ["id"])


@_query(f"{_WITH_LOG}, final AS ({_FINAL.format('log')}) {_APPLIED}")
def always_split_then_apply(spark, sf_dir):
    return changelog.apply_log(fixtures.base(spark, sf_dir), changelog.split_updates(fixtures.log(spark, sf_dir)), KEYS)


_LITERAL = "concat('o_orderstatus is ', o_orderstatus) = 'o_orderstatus is F' OR `o_orderpriority` = '1-URGENT' AND o_totalprice > 100000"


@_query(f"{_WITH_LOG} SELECT seq FROM log WHERE op <> 'I' OR NOT coalesce('o_orderstatus is ' || a_status = 'o_orderstatus is F' OR a_priority = '1-URGENT' AND a_price > 100000, false)")
def predicate_with_column_names_in_text(spark, sf_dir):
    return filters.mark_expression(fixtures.log(spark, sf_dir), insert=_LITERAL).where("NOT skipped").select("seq")
