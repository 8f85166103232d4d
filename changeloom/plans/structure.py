"""Registered queries of DDL, spans, storage layout, binary forms and the comparison of tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import binary, codecs, decoders
from changeloom.operators import changelog, conflicts, ddl, diff, filters, redo, routing, spans, statements
from changeloom.plans import fixtures
from changeloom.plans.catalog import _APPLIED, _DIFF, _FINAL, _IMAGES, _ORDER, _WITH_LOG, CRC, KEYS, VALUES, _checksum_sql, _flat, _order_text, _pair, _query, _TEXT, crc32, narrow_log
from changeloom.sources import storage
from changeloom.streaming import feed

# DDL.
_EVENTS = """SELECT * FROM (VALUES (1, 10, 1, 'create table', 's', 'a', 'x int,y text'), (1, 20, 2, 'add column', 's', 'a', 'z bigint'), (1, 20, 3, 'drop column', 's', 'a', 'y'), (1, 20, 3, 'drop column', 's', 'a', 'y'),
  (1, 30, 4, 'rename column', 's', 'a', 'x k'), (1, 40, 5, 'rename table', 's', 'b', ''), (2, 15, 6, 'create table', 's', 'c', 'p int'), (2, 35, 7, 'modify column', 's', 'c', 'p bigint'), (2, 50, 8, 'drop table', 's', 'c', '')) AS t(table_id, commit_ts, seq, type, schema_name, table_name, detail)"""
_CATALOG = """SELECT * FROM (VALUES (1, 10, 1, 20, 's', 'a', 'x int,y text', false), (1, 20, 2, 30, 's', 'a', 'x int,z bigint', false), (1, 30, 3, 40, 's', 'a', 'k int,z bigint', false), (1, 40, 4, NULL, 's', 'b', 'k int,z bigint', false),
  (2, 15, 1, 35, 's', 'c', 'p int', false), (2, 35, 2, 50, 's', 'c', 'p bigint', false), (2, 50, 3, NULL, 's', 'c', '', true)) AS t(table_id, ts, version, next_ts, schema_name, table_name, columns, gone)"""


def _events(spark):
    return spark.sql(_EVENTS).withColumn("table_id", F.col("table_id").cast("long"))


@_query(f"SELECT CAST(table_id AS BIGINT) AS table_id, CAST(ts AS BIGINT) AS ts, CAST(version AS BIGINT) AS version, CAST(next_ts AS BIGINT) AS next_ts, schema_name, table_name, columns, gone FROM ({_CATALOG})")
def ddl_catalog(spark, sf_dir):
    return ddl.catalog(_events(spark))


@_query("SELECT * FROM (VALUES (7, 0, 'b2', 'a'), (7, 1, 'c2', 'c'), (8, 0, 'd', NULL)) AS t(id, part, table_name, pre_table_name)")
def ddl_table_events(spark, sf_dir):
    tables = "array(named_struct('schema_name', 's', 'table_name', '{}', 'table_id', {}L){})"
    rename = tables.format("b2", 1, ", named_struct('schema_name', 's', 'table_name', 'c2', 'table_id', 2L)")
    jobs = spark.sql(f"SELECT 7 AS id, 'rename tables' AS type, 40 AS finished_ts, {rename} AS tables UNION ALL SELECT 8, 'create table', 45, {tables.format('d', 9, '')}")
    return ddl.table_events(jobs, ddl.catalog(_events(spark))).select("id", "part", "table_name", "pre_table_name")


_STATEMENTS = r"""SELECT * FROM (VALUES (1, 's', 'DROP TABLE a, `b`, t.c'), (2, 's', 'rename table a to b, c to t.d'), (3, 's', 'ALTER TABLE a ADD COLUMN x DECIMAL(10,2) DEFAULT 1, DROP INDEX i, ADD UNIQUE u (p, q)'),
  (4, 's', 'CREATE TABLE a (x INT, y VARCHAR(3))'), (5, 's', 'CREATE DATABASE d'), (6, 's', 'ALTER TABLE a COMMENT ''x, y''')) AS t(id, schema_name, query)"""
_SPLIT = """SELECT * FROM (VALUES (1, 0, 'DROP TABLE IF EXISTS `s`.`a`', 'drop table'), (1, 1, 'DROP TABLE IF EXISTS `s`.`b`', 'drop table'), (1, 2, 'DROP TABLE IF EXISTS `t`.`c`', 'drop table'), (2, 0, 'RENAME TABLE `s`.`a` TO `s`.`b`', 'rename table'),
  (2, 1, 'RENAME TABLE `s`.`c` TO `t`.`d`', 'rename table'), (3, 0, 'ALTER TABLE `s`.`a` ADD COLUMN x DECIMAL(10,2) DEFAULT 1', 'add column'), (3, 1, 'ALTER TABLE `s`.`a` DROP INDEX i', 'drop index'), (3, 2, 'ALTER TABLE `s`.`a` ADD UNIQUE u (p, q)', 'modify constraint'),
  (4, 0, 'CREATE TABLE IF NOT EXISTS `s`.`a` (x INT, y VARCHAR(3))', 'create table'), (5, 0, 'CREATE DATABASE IF NOT EXISTS d', 'create database'), (6, 0, 'ALTER TABLE `s`.`a` COMMENT ''x, y''', NULL)) AS t(id, part, statement, type)"""


@_query(_SPLIT)
def ddl_split(spark, sf_dir):
    out = ddl.split_ddl(spark.sql(_STATEMENTS))
    return out.select("id", "part", "statement", ddl.event_type(F.col("statement")).alias("type"))


@_query("SELECT * FROM (VALUES ('int', 'smallint', true), ('int', 'bigint', false), ('int', 'int unsigned', true), ('varchar(10)', 'varchar(5)', true), ('decimal(10,2)', 'decimal(12,4)', false), ('decimal(10,2)', 'decimal(11,4)', true)) AS t(old, new, narrows)")
def ddl_lossy_modify(spark, sf_dir):
    pairs = [("int", "smallint"), ("int", "bigint"), ("int", "int unsigned"), ("varchar(10)", "varchar(5)"), ("decimal(10,2)", "decimal(12,4)"), ("decimal(10,2)", "decimal(11,4)")]
    return spark.createDataFrame([(a, b, ddl.narrows(a, b)) for a, b in pairs], "old string, new string, narrows boolean")


@_query("SELECT * FROM (VALUES ('stop', 'b: length 10 and 20'), ('stop', 'c: int and varchar'), ('other', 'index i: a and b'), ('other', 'index k on one side'), ('other', 'foreign key (b) to p on one side')) AS t(kind, message)")
def structure_compare(spark, sf_dir):
    c, s = ddl.ColumnDef, ddl.Structure
    left = s([c("a", "int"), c("b", "varchar", 10), c("c", "int"), c("x", "int")], {"i": ("a",), "k": ("b",), "l": ("x",)}, [(("b",), "p", ("id",))])
    right = s([c("A", "bigint"), c("b", "text", 20), c("c", "varchar")], {"i": ("b",)})
    stop, other = ddl.compare_structures(left, right, ["x"])
    return spark.createDataFrame([("stop", x) for x in stop] + [("other", x) for x in other], "kind string, message string")


@_query("SELECT * FROM (VALUES ('binlog_format', 'fail'), ('log_bin', 'ok'), ('binlog_row_image', 'ok'), ('version', 'ok'), ('key', 'ok'), ('key', 'warn'), ('shards', 'fail'), ('connections', 'warn')) AS t(name, state)")
def pre_checks(spark, sf_dir):
    a, b = ddl.Structure([ddl.ColumnDef("x", "int")], {"primary": ("x",)}), ddl.Structure([ddl.ColumnDef("x", "text")])
    settings = {"log_bin": "ON", "binlog_format": "STATEMENT", "binlog_row_image": "FULL", "version": "8.0.11"}
    return spark.createDataFrame([(n, s) for n, s, _ in ddl.pre_checks({"a": a, "b": b}, settings, {"t": ["a", "b"]}, 20, 10)], "name string, state string")


@_query("SELECT * FROM (VALUES ('o_custkey > 1', true), ('no_such > 1', false), ('o_custkey >', false), ('o_orderstatus', false), ('o_orderstatus = ''no_such''', true)) AS t(predicate, fine)")
def predicate_validation(spark, sf_dir):
    columns = fixtures.log(spark, sf_dir).schema["after"].dataType
    texts = ["o_custkey > 1", "no_such > 1", "o_custkey >", "o_orderstatus", "o_orderstatus = 'no_such'"]
    return spark.createDataFrame([(t, not filters.check_predicate(spark, columns, t)) for t in texts], "predicate string, fine boolean")


@_query(f"{_WITH_LOG} SELECT seq FROM log WHERE table_name <> 'orders_old' AND op <> 'D' AND NOT (op = 'I' AND a_price > 300000)")
def migration_chain(spark, sf_dir):
    rules = [filters.EventRule(filters.TableRules(("shop.*",)), ignore=("delete",))]
    return filters.filter_migration(fixtures.log(spark, sf_dir), filters.TableRules(("shop.*", "!shop.nothing")), rules, [{"insert": "o_totalprice > 300000"}]).where("table_name <> 'orders_old'").select("seq")


@_query("SELECT * FROM (VALUES ('t'), ('_t'), ('_t_x')) AS t(table_name)")
def migration_skips_helper_tables(spark, sf_dir):
    names = spark.sql("SELECT * FROM (VALUES ('t'), ('_t'), ('_t_x'), ('_t_gho'), ('_t_new'), ('_t_ghc'), ('_t_del'), ('_t_old')) AS t(table_name)").withColumn("schema_name", F.lit("s")).withColumn("op", F.lit("I"))
    return filters.filter_migration(names, filters.TableRules()).select("table_name")


@_query(f"{_WITH_LOG} SELECT op, seq, {_IMAGES} FROM log")
def mounted_rows(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    raw = own.select("seq", F.to_json("after").alias("value"), F.to_json("before").alias("old_value"))
    return _flat(filters.mount(raw, own.schema["after"].dataType), "op", "seq")


@_query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 7 END) AS o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def mounted_defaults(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    some = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    raw = orders.select(F.to_json(some).alias("value"), F.lit(None).cast("string").alias("old_value"))
    columns = T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_orderstatus", "string")
    return filters.mount(raw, columns, {"o_custkey": 7}, ["o_orderstatus"]).select("after.*")


@_query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 100 < 50 THEN o_orderkey % 100 - 50 + 4294967296 ELSE o_orderkey % 100 - 50 END AS DECIMAL(20,0)) AS wide FROM orders")
def unsigned_values(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    return orders.select("o_orderkey", filters.unsigned((F.col("o_orderkey") % 100 - 50).cast("int"), 32).alias("wide"))


# Spans.
_A = "SELECT * FROM (VALUES (1, 'a', 'f'), (1, 'h', 'm'), (2, 'a', 'c'), (3, 'a', NULL)) AS t(table_id, start_key, end_key)"
_B = "SELECT * FROM (VALUES (1, 'c', 'i'), (2, 'c', 'd'), (3, 'b', 'x'), (3, 'y', NULL)) AS t(table_id, start_key, end_key)"


@_query("SELECT * FROM (VALUES (1, 'c', 'f'), (1, 'h', 'i'), (3, 'b', 'x'), (3, 'y', NULL)) AS t(table_id, start_key, end_key)")
def span_intersection(spark, sf_dir):
    return spans.intersect(spark.sql(_A), spark.sql(_B))


@_query("SELECT o_orderkey, CAST(CAST('0x' || substring(md5('orders/' || o_orderkey), 1, 8) AS BIGINT) % 16 AS INTEGER) AS slot FROM orders")
def span_slots(spark, sf_dir):
    return fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", spans.slot(F.concat(F.lit("orders/"), F.col("o_orderkey")), 16).alias("slot"))


@_query("SELECT * FROM (VALUES (1, 'f', 'h')) AS t(table_id, start_key, end_key)")
def span_gaps(spark, sf_dir):
    return spans.gaps(spark.sql(_A))


# Storage.
@_query(f"""{_WITH_LOG}, placed AS (SELECT seq, table_name, row_number() OVER (PARTITION BY table_name ORDER BY {_ORDER}) AS place FROM log)
SELECT seq, 'shop/' || table_name || '/1/1970-01-01/CDC' || lpad(CAST((place - 1) // 300 + 1 AS VARCHAR), 6, '0') || '.csv' AS path FROM placed""")
def storage_paths(spark, sf_dir):
    return storage.numbered(fixtures.log(spark, sf_dir), 300, "day").select("seq", "path")


@_query("SELECT * FROM (VALUES (1, 1, true), (2, 2, true), (3, 1, false), (4, 2, false), (5, 5, true)) AS t(version, data_version, written)")
def storage_schema_versions(spark, sf_dir):
    rows = "SELECT 's' AS schema_name, 't' AS table_name, version, d AS definition FROM (VALUES (1, 'x'), (2, 'y'), (3, 'x'), (4, 'y'), (5, 'z')) AS t(version, d)"
    return storage.data_versions(spark.sql(rows)).select("version", "data_version", "written")


@_query("SELECT * FROM (VALUES ('f', 100, 1, 5), ('f', 200, 3, 9), ('g', 100, 2, 6)) AS t(changefeed, primary_ts, secondary_ts, created_at)")
def syncpoint_table(spark, sf_dir):
    name = "AS t(changefeed, primary_ts, secondary_ts, created_at)"
    stored = spark.sql(f"SELECT 'c' AS cluster, * FROM (VALUES ('f', 100, 1, 5)) {name}")
    new = spark.sql(f"SELECT 'c' AS cluster, * FROM (VALUES ('f', 100, 2, 7), ('f', 200, 3, 9), ('f', 200, 4, 10), ('g', 100, 2, 6)) {name}")
    return feed.syncpoint_store(stored, new).drop("cluster")


# Binary forms.
@_query(f"{_WITH_LOG} SELECT seq, 42 AS schema_id, o_orderkey, a_custkey, a_status, a_price, a_priority FROM log WHERE op <> 'D'")
def avro_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir).where("op <> 'D'")
    columns = own.schema["after"].dataType
    sent = own.select("seq", binary.to_avro(columns, 42)(F.col("after")).alias("value"))
    names = {"o_custkey": "a_custkey", "o_orderstatus": "a_status", "o_totalprice": "a_price", "o_orderpriority": "a_priority"}
    return binary.from_avro(sent, columns).select("seq", "schema_id", "row.*").withColumnsRenamed(names)


@_query("SELECT o_orderkey, o_orderkey % 13 = 0 AS corrupted FROM orders")
def row_checksum_verification(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    kinds = [(c, orders.schema[c].dataType) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")]
    sent = orders.withColumn("expected", binary.row_checksum([(F.col(c), k) for c, k in kinds]))
    got = sent.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.concat("o_orderstatus", F.lit("x"))).otherwise(F.col("o_orderstatus")))
    return got.select("o_orderkey", binary.corrupted(binary.row_checksum([(F.col(c), k) for c, k in kinds]), F.col("expected")).alias("corrupted"))


@_query(f"WITH {CRC} SELECT o_orderkey, CAST({crc32('o_orderpriority')} AS BIGINT) AS checksum FROM orders, crc")
def crc_of_text(spark, sf_dir):
    return fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", F.crc32(F.col("o_orderpriority").cast("binary")).alias("checksum"))


@_query("SELECT o_orderkey, o_orderpriority AS gzip, o_orderpriority AS zstd, o_orderpriority AS lz4, o_orderpriority AS none FROM orders")
def compressed_payloads(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    return orders.select("o_orderkey", *(binary.decompress(k)(binary.compress(k)(F.col("o_orderpriority"))).cast("string").alias(k) for k in ("gzip", "zstd", "lz4", "none")))


@_query(f"""{_WITH_LOG} SELECT seq, CASE WHEN length(v) > 120 THEN 'claim' ELSE v END AS message FROM (SELECT seq, repeat(coalesce(a_status, b_status), CAST(o_orderkey % 200 AS INTEGER)) AS v FROM log)""")
def claim_check_split(spark, sf_dir):
    own = fixtures.log(spark, sf_dir).select("seq", F.repeat(changelog.image("o_orderstatus"), (changelog.image("o_orderkey") % 200).cast("int")).alias("message"))
    sent, stored = codecs.claim_check(own, 120, "s3://store/payloads")
    return sent.withColumn("message", F.when(F.col("message").startswith('{"claimCheckLocation"'), "claim").otherwise(F.col("message")))


@_query(f"{_WITH_LOG} SELECT table_name, op, commit_ts, o_orderkey, CAST(NULL AS BIGINT) AS a_custkey FROM log WHERE op = 'U' UNION ALL SELECT table_name, op, commit_ts, o_orderkey, a_custkey FROM log WHERE op <> 'U'")
def canal_json_within_a_size(spark, sf_dir):
    """Messages of updates, which are the longer ones, are cut to handle keys."""
    own = fixtures.log(spark, sf_dir)
    sent = codecs.canal_json_within(own, KEYS, 590)
    return _flat(decoders.from_canal_json(sent.select("message"), own.schema["after"].dataType), "table_name", "op", "commit_ts").select("table_name", "op", "commit_ts", "o_orderkey", "a_custkey")


@_query("SELECT o_orderkey, o_custkey % 100 BETWEEN 10 AND 19 AS regex, o_custkey % 100 = 7 AS quoted FROM orders")
def table_rules_by_regex(spark, sf_dir):
    rows = fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", F.lit("shop").alias("schema_name"), F.concat(F.lit("t"), F.col("o_custkey") % 100).alias("table_name"))
    rules = {"regex": filters.TableRules((r"shop./t1\d/",)), "quoted": filters.TableRules(("`shop`.`t7`",))}
    return rows.select("o_orderkey", *(r.column().alias(n) for n, r in rules.items()))


@_query(f"""{_WITH_LOG}, {CRC}, base_hash AS (SELECT table_name, {crc32("'shop' || table_name")} AS h FROM (SELECT DISTINCT table_name FROM log), crc)
SELECT seq, CAST(xor(h, {crc32("'o_custkey' || coalesce(a_custkey, b_custkey)")}) % 8 AS INTEGER) AS partition FROM log JOIN base_hash USING (table_name), crc""")
def named_index_dispatch(spark, sf_dir):
    rules = [routing.DispatchRule("*.*", "t", "index-value", index="uk")]
    return routing.dispatch(fixtures.log(spark, sf_dir), rules, "main", 8, KEYS, {"uk": ["o_custkey"]}).select("seq", "partition")


@_query(f"{_WITH_LOG} SELECT seq, CASE WHEN op = 'D' THEN NULL ELSE a_custkey END AS a_custkey, CASE WHEN op = 'D' THEN NULL ELSE b_custkey END AS b_custkey, o_orderkey FROM log")
def handle_keys_on_delete(spark, sf_dir):
    return _flat(filters.handle_keys_only(fixtures.log(spark, sf_dir), KEYS), "seq").select("seq", "a_custkey", "b_custkey", "o_orderkey")


@_query(f"{_WITH_LOG} SELECT seq, CASE WHEN coalesce(b_custkey, 0) % 2 = 1 THEN 'uk' ELSE 'all' END AS chosen FROM log WHERE op = 'U'")
def where_key_choice(spark, sf_dir):
    own = fixtures.log(spark, sf_dir).where("op = 'U'")
    holed = own.withColumn("before", F.struct(F.col("before.o_orderkey"), F.when(F.col("before.o_custkey") % 2 == 1, F.col("before.o_custkey")).alias("o_custkey"), F.col("before.o_orderstatus")))
    chosen = changelog.where_columns([], [(["o_custkey"], False)], ["o_orderkey", "o_custkey", "o_orderstatus"])
    return holed.select("seq", F.when(F.size(chosen) == 1, "uk").otherwise("all").alias("chosen"))


@_query(f"{_WITH_LOG} SELECT seq FROM log")
def replayed_changes_dropped(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    return changelog.drop_replayed(own.unionByName(own.where("seq % 3 = 0")), ["commit_ts", "start_ts", "seq"]).select("seq")


@_query(f"{_WITH_LOG} SELECT table_name, avg(length('x')) >= 0 AS mergeable FROM log WHERE op = 'U' GROUP BY table_name")
def mergeable_updates(spark, sf_dir):
    return statements.mergeable_updates(fixtures.log(spark, sf_dir)).select("table_name", "mergeable")


# Comparison.
@_query("SELECT o_orderkey, o_orderkey % 7 <> 0 AS same FROM orders")
def json_equality(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    changed = F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")
    left = F.concat(F.lit('{"a": '), F.col("o_custkey"), F.lit(', "b": {"x": [1, 2], "y": "t"}}'))
    right = F.concat(F.lit('{"b":{"y":"t","x":[1,2]},"a":'), changed, F.lit("}"))
    return orders.select("o_orderkey", diff.json_equal(left, right).alias("same"))


_BUCKETS = "SELECT CAST(o_orderkey // 100 * 100 + 99 AS BIGINT) AS upper, CAST(count(*) * CASE WHEN o_orderkey // 100 = 3 THEN 20 ELSE 1 END AS BIGINT) AS n FROM orders GROUP BY o_orderkey // 100"


@_query(f"""WITH h AS ({_BUCKETS}), c AS (SELECT *, sum(n) OVER (ORDER BY upper) - n AS below FROM h)
SELECT CAST(below // 500 AS BIGINT) AS chunk, max(upper) AS upper, CAST(sum(n) AS BIGINT) AS n, CAST(CASE WHEN count(*) = 1 AND sum(n) > 1000 THEN ceil(sum(n) / 500) ELSE 1 END AS BIGINT) AS parts FROM c GROUP BY 1""")
def bucket_chunks(spark, sf_dir):
    histogram = spark.sql(_BUCKETS.replace("FROM orders", "FROM {orders}").replace("o_orderkey // 100", "o_orderkey div 100"), **fixtures.tables(spark, sf_dir, "orders"))
    return diff.bucket_bounds(histogram, 500)


@_query("SELECT CAST(1 AS BIGINT) AS n_over, CAST(ceil(count(*) / 200) - 1 AS BIGINT) AS bounds, true AS sorted FROM orders")
def random_chunks(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    bounds = diff.random_bounds(orders, KEYS, 200)
    return spark.createDataFrame([(len(diff.random_bounds(orders, KEYS, 200, indexed=False)) + 1, len(bounds), bounds == sorted(set(bounds)))], "n_over long, bounds long, sorted boolean")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey = 520 THEN 'DELETE' ELSE 'REPLACE' END AS repair FROM orders WHERE o_orderkey BETWEEN 500 AND 520")
def bad_range_search(spark, sf_dir):
    """Differences are narrowed to one range by halving, and only that is compared row by row."""
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", *VALUES)
    source = orders.where("o_orderkey <> 520")
    target = orders.withColumn("o_custkey", F.col("o_custkey") + F.col("o_orderkey").between(500, 519).cast("int"))
    low, high = diff.bad_range(source, target, "o_orderkey", VALUES, 0, 1 << 40, 100)
    inside = [rows.where(F.col("o_orderkey").between(low, high)) for rows in (source, target)]
    return diff.compare_rows(*inside, KEYS, VALUES).select("o_orderkey", "repair")


@_query(f"""WITH a AS ({_checksum_sql('orders', "'orders' AS table_name", _TEXT).replace('GROUP BY 1', 'GROUP BY ALL')}) SELECT table_name, row_count AS source_rows, row_count AS target_rows, true AS same FROM a
UNION ALL SELECT 'changed', count(*), count(*), false FROM orders UNION ALL SELECT 'lacking', count(*), 0, false FROM orders""")
def global_checksum(spark, sf_dir):
    orders = fixtures.tables(spark, sf_dir, "orders")["orders"]
    changed = orders.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") == 7).cast("int"))
    pairs = {"orders": (orders, orders), "changed": (orders, changed), "lacking": (orders, None), "done": (orders, changed)}
    return diff.global_checksums(pairs, lambda rows: _order_text(), ["done"])


_STATES = "SELECT * FROM (VALUES ('a', 0, 'success', 10, 10, 0, 0), ('a', 1, 'failed', 10, 9, 2, 1), ('a', 2, 'not_checked', 10, 10, 5, 5), ('a', 3, 'success', 1, 1, 0, 0), ('b', 0, 'success', 4, 4, 0, 0), ('b', 1, 'ignored', 4, 4, 0, 0)) AS t(table_name, chunk, state, up_count, down_count, rows_add, rows_delete)"


@_query("SELECT table_name, CAST(u AS BIGINT) AS up_count, CAST(d AS BIGINT) AS down_count, CAST(a AS BIGINT) AS rows_add, CAST(r AS BIGINT) AS rows_delete, result FROM (VALUES ('a', 31, 30, 2, 1, 'fail'), ('b', 8, 8, 0, 0, 'pass')) AS t(table_name, u, d, a, r, result)")
def diff_report(spark, sf_dir):
    return diff.report(spark.sql(_STATES))


@_query("SELECT * FROM (VALUES ('a', 1), ('b', 1)) AS t(table_name, resume_after)")
def diff_resume(spark, sf_dir):
    return diff.resume_after(spark.sql(_STATES))


@_query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY p_brand")
def table_sizes(spark, sf_dir):
    return diff.total_size(fixtures.tables(spark, sf_dir, "part")["part"], "p_size", ["p_brand"])


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY lower(word), o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS word FROM orders WHERE o_orderkey < 500)")
def collated_order(spark, sf_dir):
    from pyspark.sql import Window

    orders = fixtures.tables(spark, sf_dir, "orders")["orders"].where("o_orderkey < 500")
    words = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("word"))
    return words.select("o_orderkey", F.row_number().over(Window.orderBy(*diff.collated(["word"]), "o_orderkey")).cast("long").alias("place"))


@_query(f"{_DIFF}, sides AS (SELECT 'orders' AS table_name) SELECT table_name, 'target' AS lacking FROM (VALUES ('only_source')) AS t(table_name) UNION ALL SELECT 'only_target', 'source'")
def missing_tables(spark, sf_dir):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "table_name string")
    return diff.missing_tables(names("orders", "only_source"), names("orders", "only_target"))


# Conflicts.
_WINDOWS = f"{_WITH_LOG}, placed AS (SELECT seq, o_orderkey, commit_ts, row_number() OVER (ORDER BY {_ORDER}) AS place FROM log)"


def _conflict_keys(spark, sf_dir):
    own = changelog.number_by_commit(fixtures.log(spark, sf_dir), [])
    return own, changelog.causality_keys(F.lit("orders"), [["o_orderkey"]], VALUES, True)


@_query(f"{_WINDOWS} SELECT seq, CAST((place - 1) // 500 AS BIGINT) AS window_no, row_number() OVER (PARTITION BY (place - 1) // 500, o_orderkey ORDER BY place) AS wave FROM placed")
def conflict_waves(spark, sf_dir):
    return conflicts.waves(*_conflict_keys(spark, sf_dir), "position", 500)


@_query(f"{_WINDOWS}, firsts AS (SELECT *, (place - 1) // 500 AS w, row_number() OVER (PARTITION BY (place - 1) // 500, o_orderkey ORDER BY place) = 1 AS first FROM placed), counted AS (SELECT *, sum(first::INT) OVER (PARTITION BY w ORDER BY place) - 1 AS n FROM firsts) SELECT seq, CAST(w AS BIGINT) AS window_no, CAST(0 AS BIGINT) AS barrier, CAST(min(n) OVER (PARTITION BY w, o_orderkey) AS BIGINT) AS relation FROM counted")
def conflict_relations(spark, sf_dir):
    return conflicts.relations(*_conflict_keys(spark, sf_dir), "position", 500)


@_query(f"{_WITH_LOG} SELECT seq, CAST((row_number() OVER (PARTITION BY commit_ts, start_ts ORDER BY CASE op WHEN 'D' THEN 0 WHEN 'U' THEN 1 ELSE 2 END, seq) - 1) // 4 + 1 AS BIGINT) AS batch_id FROM log")
def split_transactions(spark, sf_dir):
    return conflicts.split_transactions(fixtures.log(spark, sf_dir), 4).select("seq", "batch_id")


@_query("""SELECT * FROM (VALUES (1, '{"id":0,"database":"s","table":"a","pkNames":null,"isDdl":true,"type":"CREATE","es":0,"sql":"CREATE TABLE a (x INT)","sqlType":null,"mysqlType":null,"data":null,"old":null,"_tidb":{"commitTs":10}}', '{"q":"CREATE TABLE a (x INT)","t":3}'),
  (2, '{"id":0,"database":"s","table":"a","pkNames":null,"isDdl":true,"type":"ALTER","es":0,"sql":"ALTER TABLE a ADD COLUMN y INT","sqlType":null,"mysqlType":null,"data":null,"old":null,"_tidb":{"commitTs":20}}', '{"q":"ALTER TABLE a ADD COLUMN y INT","t":5}')) AS t(id, canal, open)""")
def ddl_messages(spark, sf_dir):
    rows = spark.sql("SELECT * FROM (VALUES (1, 10L, 's', 'a', 3, 'CREATE TABLE a (x INT)'), (2, 20L, 's', 'a', 5, 'ALTER TABLE a ADD COLUMN y INT')) AS t(id, commit_ts, schema_name, table_name, type_number, query)")
    return rows.select("id", codecs.canal_json_ddl().alias("canal"), codecs.open_protocol_ddl()[1].alias("open"))


@_query("SELECT vec_id, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def vector_text_round_trip(spark, sf_dir):
    rows = fixtures.tables(spark, sf_dir, "embeddings")["embeddings"].where("embedding IS NOT NULL").select("vec_id", "embedding")
    kind = rows.schema["embedding"].dataType.elementType
    return rows.select("vec_id", codecs.vector_from_text(codecs.vector_text(F.col("embedding")), kind).eqNullSafe(F.col("embedding")).alias("same"))


# Redo.
@_query(f"{_WITH_LOG}, first AS (SELECT * FROM log WHERE commit_ts <= 2030), final AS ({_FINAL.format('first')}), middle AS ({_APPLIED}), kept AS (SELECT * FROM middle WHERE o_orderkey % 2 = 0), second AS (SELECT * FROM log WHERE commit_ts > 2030), last AS ({_FINAL.format('second')}) SELECT * FROM kept WHERE o_orderkey NOT IN (SELECT o_orderkey FROM last) UNION ALL SELECT o_orderkey, a_custkey, a_status, a_price, a_priority FROM last WHERE op <> 'D'")
def redo_with_ddl(spark, sf_dir):
    """A DDL between two segments (here one that drops the partition of odd keys) sees what came before it, and only that."""
    return redo.replay_with_ddl(fixtures.base(spark, sf_dir), fixtures.log(spark, sf_dir), [2030], KEYS, lambda table, ts: table.where("o_orderkey % 2 = 0"))


@_query("SELECT CAST(40 AS BIGINT) AS checkpoint_ts, CAST(70 AS BIGINT) AS resolved_ts")
def redo_flushed(spark, sf_dir):
    rows = "SELECT * FROM (VALUES ('a', 40L, 90L), ('b', 50L, 60L), ('b', 45L, 70L), ('a', 30L, 20L)) AS t(span, checkpoint_ts, resolved_ts)"
    return redo.flushed(spark.sql(rows))
