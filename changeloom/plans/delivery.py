"""Registered queries of decoders, statements and consumers."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import codecs, decoders, protobuf
from changeloom.operators import changelog, consumer, routing, statements
from changeloom.plans import fixtures
from changeloom.plans.catalog import _FINAL, _IMAGES, _ORDER, _RANK, _VERSIONS, _WITH_LOG, _APPLIED, KEYS, VALUES, _flat, _query, narrow_log
from changeloom.streaming import feed

_DECODED = f"{_WITH_LOG} SELECT schema_name, table_name, op, commit_ts, {_IMAGES} FROM log"


@_query(_DECODED)
def open_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    key, value = codecs.open_protocol(own, KEYS)
    return _flat(decoders.from_open_protocol(own.select(key.alias("key"), value.alias("value")), own.schema["after"].dataType), "schema_name", "table_name", "op", "commit_ts")


@_query(_DECODED + " WHERE table_name = 'orders'")
def simple_round_trip(spark, sf_dir):
    """Messages of a table whose schema hasn't come yet wait."""
    own = fixtures.log(spark, sf_dir)
    known = own.select("schema_name", "table_name", "table_version").where("table_name = 'orders'")
    return _flat(decoders.from_simple(own.select(codecs.simple(own).alias("message")), own.schema["after"].dataType, known)[0], "schema_name", "table_name", "op", "commit_ts")


@_query(f"{_WITH_LOG} SELECT schema_name, table_name, op, CAST(0 AS BIGINT) AS ts, {_IMAGES} FROM log")
def maxwell_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    return _flat(decoders.from_maxwell(own.select(codecs.maxwell(own).alias("message")), own.schema["after"].dataType), "schema_name", "table_name", "op", "ts")


@_query(f"""{_WITH_LOG} SELECT table_name, op, commit_ts, false AS is_update, o_orderkey, b_custkey, b_status, a_custkey, a_status FROM log WHERE op <> 'U'
UNION ALL SELECT table_name, 'D', commit_ts, true, o_orderkey, b_custkey, b_status, NULL, NULL FROM log WHERE op = 'U' UNION ALL SELECT table_name, 'I', commit_ts, true, o_orderkey, NULL, NULL, a_custkey, a_status FROM log WHERE op = 'U'""")
def csv_round_trip(spark, sf_dir):
    own = narrow_log(spark, sf_dir)
    back = decoders.from_csv_lines(codecs.csv_lines(own, old_value=True).select("line"), own.schema["after"].dataType, old_value=True)
    images = [F.col(f"{side}.{c}").alias(f"{side[0]}_{s}") for side in ("before", "after") for c, s in (("o_custkey", "custkey"), ("o_orderstatus", "status"))]
    return back.select("table_name", "op", "commit_ts", "is_update", changelog.image("o_orderkey").alias("o_orderkey"), *images)


@_query(f"{_WITH_LOG} SELECT schema_name, table_name, op, CAST(0 AS BIGINT) AS execute_ms, {_IMAGES} FROM log")
def canal_protobuf_round_trip(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    sent = protobuf.canal_packets(own, KEYS).select("value")
    return _flat(protobuf.from_canal_packets(sent, own.schema["after"].dataType), "schema_name", "table_name", "op", "execute_ms")


def _files(spark, sf_dir):
    own = changelog.number_by_commit(fixtures.log(spark, sf_dir), [])
    return decoders.canal_json_files(own.select("position", codecs.canal_json(own, KEYS).alias("message")), 100, [F.col("position")])


@_query(f"{_WITH_LOG} SELECT CAST((rn - 1) // 100 AS BIGINT) AS file, CAST(count(*) AS INTEGER) AS n FROM (SELECT row_number() OVER (ORDER BY {_ORDER}) AS rn FROM log) GROUP BY 1")
def canal_json_txn_files(spark, sf_dir):
    return _files(spark, sf_dir).select("file", "n")


@_query(_DECODED)
def canal_json_txn_round_trip(spark, sf_dir):
    columns = fixtures.log(spark, sf_dir).schema["after"].dataType
    return _flat(decoders.from_canal_json_files(_files(spark, sf_dir), columns), "schema_name", "table_name", "op", "commit_ts")


# Statements.
_ROW = "'(' || o_orderkey || ',' || a_custkey || ',''' || a_status || ''')'"
_FOUND = "'`o_orderkey` = ' || o_orderkey"
_NAMES = "(`o_orderkey`,`o_custkey`,`o_orderstatus`)"


@_query(f"""{_WITH_LOG} SELECT seq, CASE op WHEN 'I' THEN CASE WHEN commit_ts > 1050 THEN 'INSERT' ELSE 'REPLACE' END || ' INTO `shop`.`' || table_name || '` {_NAMES} VALUES ' || {_ROW}
  WHEN 'U' THEN 'UPDATE `shop`.`' || table_name || '` SET `o_orderkey` = ' || o_orderkey || ', `o_custkey` = ' || a_custkey || ', `o_orderstatus` = ''' || a_status || ''' WHERE ' || {_FOUND} || ' LIMIT 1'
  ELSE 'DELETE FROM `shop`.`' || table_name || '` WHERE ' || {_FOUND} || ' LIMIT 1' END AS statement FROM log""")
def single_row_statements(spark, sf_dir):
    return statements.single_row(narrow_log(spark, sf_dir), KEYS, replace=F.col("commit_ts") <= 1050).select("seq", "statement")


@_query(f"""{_WITH_LOG}, cut AS (SELECT *, CAST((row_number() OVER (PARTITION BY table_name, commit_ts, start_ts, op ORDER BY seq) - 1) // 3 AS BIGINT) AS statement_no FROM log)
SELECT table_name, commit_ts, start_ts, op, statement_no, CAST(count(*) AS INTEGER) AS n, CASE op WHEN 'I' THEN 'INSERT INTO `shop`.`' || table_name || '` {_NAMES} VALUES ' || string_agg({_ROW}, ',' ORDER BY seq)
  WHEN 'U' THEN 'UPDATE `shop`.`' || table_name || '` SET `o_orderkey`=CASE' || string_agg(' WHEN ' || {_FOUND} || ' THEN ' || o_orderkey, '' ORDER BY seq) || ' END, `o_custkey`=CASE' || string_agg(' WHEN ' || {_FOUND} || ' THEN ' || a_custkey, '' ORDER BY seq)
    || ' END, `o_orderstatus`=CASE' || string_agg(' WHEN ' || {_FOUND} || ' THEN ''' || a_status || '''', '' ORDER BY seq) || ' END WHERE (' || string_agg({_FOUND}, ') OR (' ORDER BY seq) || ')'
  ELSE 'DELETE FROM `shop`.`' || table_name || '` WHERE (' || string_agg({_FOUND}, ') OR (' ORDER BY seq) || ')' END AS statement
FROM cut GROUP BY table_name, commit_ts, start_ts, op, statement_no""")
def multi_row_statements(spark, sf_dir):
    cut = changelog.batch_order(narrow_log(spark, sf_dir), 3, ["table_name"])
    return statements.multi_row(cut, ["commit_ts", "start_ts", "statement_no"], KEYS).select("table_name", "commit_ts", "start_ts", "op", "statement_no", "n", "statement")


@_query(f"""{_WITH_LOG}, halves AS (SELECT seq, commit_ts, start_ts, op AS phase FROM log WHERE NOT (op = 'U' AND b_custkey <> a_custkey)
  UNION ALL SELECT seq, commit_ts, start_ts, x FROM log, (VALUES ('D'), ('I')) AS t(x) WHERE op = 'U' AND b_custkey <> a_custkey)
SELECT seq, phase, row_number() OVER (PARTITION BY commit_ts, start_ts ORDER BY {_RANK.replace('op', 'phase')}, seq) AS place FROM halves""")
def redo_update_split(spark, sf_dir):
    out = statements.redo_order(fixtures.log(spark, sf_dir), changelog.key_changed(["o_orderkey", "o_custkey"]))
    return out.select("seq", "phase", F.expr("row_number() OVER (PARTITION BY commit_ts, start_ts ORDER BY phase_rank, seq)").cast("long").alias("place"))


@_query(f"""{_WITH_LOG}, sent AS (SELECT seq, table_id AS lane, row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) AS position FROM log)
SELECT lane, CAST((position - 1) // 64 AS BIGINT) AS block_no, CAST((position - 1) % 64 // 25 AS BIGINT) AS batch_no, count(*) AS n, min(seq) AS first_seq FROM sent GROUP BY ALL""")
def mq_batches(spark, sf_dir):
    sent = changelog.number_by_commit(fixtures.log(spark, sf_dir), ["table_id"]).withColumnRenamed("table_id", "lane")
    return consumer.batches(sent, ["lane"], 64, F.lit(4), 100).groupBy("lane", "block_no", "batch_no").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


# Consumers: each table_id is a partition; every ninth row is sent again three places later, every fiftieth place tells a resolved timestamp.
_SENT = f"""SELECT lane, pos, kind, table_name, commit_ts, seq FROM (
  SELECT table_id AS lane, rn * 10 AS pos, 'row' AS kind, table_name, commit_ts, seq FROM numbered
  UNION ALL SELECT table_id, rn * 10 + 35, 'row', table_name, commit_ts, seq FROM numbered WHERE seq % 9 = 0
  UNION ALL SELECT table_id, rn * 10 + 1, 'resolved', table_name, commit_ts - 1, NULL FROM numbered WHERE rn % 50 = 0) AS sent"""
_WITH_SENT = f"{_WITH_LOG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) AS rn FROM log), messages AS ({_SENT})"
_MARK = "(SELECT min(ts) FROM (SELECT max(commit_ts) AS ts FROM messages WHERE kind = 'resolved' GROUP BY lane))"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_FRESH = f"""marked AS (SELECT *, max(CASE WHEN kind = 'resolved' THEN commit_ts END) OVER (PARTITION BY lane ORDER BY pos {_BEFORE}) AS mark FROM messages),
  placed AS (SELECT *, max(commit_ts) OVER (PARTITION BY lane, table_name ORDER BY pos {_BEFORE}) AS high FROM marked WHERE kind = 'row' AND (mark IS NULL OR commit_ts >= mark)),
  fresh AS (SELECT lane, pos, commit_ts, seq FROM placed WHERE high IS NULL OR commit_ts >= high)"""


def _messages(spark, sf_dir):
    numbered = changelog.number_by_commit(fixtures.log(spark, sf_dir), ["table_id"], "rn")
    out = spark.sql(_SENT.replace("FROM numbered", "FROM {numbered}"), numbered=numbered)
    return out.withColumnsRenamed({"lane": "partition", "pos": "offset"})


@_query(f"{_WITH_SENT}, {_FRESH} SELECT lane, pos, seq FROM fresh")
def mq_without_replays(spark, sf_dir):
    return consumer.without_replays(_messages(spark, sf_dir)).select(F.col("partition").alias("lane"), F.col("offset").alias("pos"), "seq")


@_query(f"{_WITH_SENT}, {_FRESH} SELECT pos, seq FROM fresh WHERE commit_ts <= {_MARK}")
def mq_released(spark, sf_dir):
    return consumer.released(_messages(spark, sf_dir), 4).select(F.col("offset").alias("pos"), "seq")


@_query(f"{_WITH_SENT} SELECT {_MARK} AS watermark")
def mq_watermark(spark, sf_dir):
    return consumer.global_watermark(_messages(spark, sf_dir), 4)


@_query(f"{_WITH_SENT}, {_FRESH}, log2 AS (SELECT * FROM log WHERE seq IN (SELECT seq FROM fresh WHERE commit_ts <= {_MARK})), final AS ({_FINAL.format('log2')}) {_APPLIED}")
def mq_consumer_applies(spark, sf_dir):
    """The whole way: messages, replays dropped, released up to the watermark, decoded and applied."""
    own = fixtures.log(spark, sf_dir)
    sent = consumer.released(_messages(spark, sf_dir), 4).select("seq").distinct()
    return changelog.apply_log(fixtures.base(spark, sf_dir), own.join(sent, "seq", "left_semi"), KEYS)


_DDL_SENT = "SELECT * FROM (VALUES (1, 1, 10, 'A', 1), (2, 1, 10, 'A', 1), (3, 2, 20, 'B', 1), (4, 1, 15, 'C', 1), (5, 2, 20, 'B', 2), (6, 3, 30, 'D', 1), (7, 2, 20, 'B', 1)) AS t(pos, start_ts, commit_ts, query, seq)"


@_query("SELECT * FROM (VALUES (1, 'A'), (3, 'B'), (5, 'B'), (6, 'D')) AS t(pos, query)")
def mq_ddl_once(spark, sf_dir):
    return consumer.ddl_once(spark.sql(_DDL_SENT).withColumnRenamed("pos", "offset")).select(F.col("offset").alias("pos"), "query")


@_query("SELECT * FROM (VALUES ('a/1', 3, 5), ('b/1', 1, 2)) AS t(folder, low, high)")
def storage_new_files(spark, sf_dir):
    listed = spark.sql("SELECT * FROM (VALUES ('a/1', 1), ('a/1', 2), ('a/1', 5), ('b/1', 2), ('c/1', 1)) AS t(folder, number)")
    return consumer.new_files(listed, spark.sql("SELECT * FROM (VALUES ('a/1', 2), ('c/1', 1)) AS t(folder, number)"))


@_query(f"{_WITH_LOG} SELECT seq FROM log WHERE NOT (table_name = 'orders' AND commit_ts < 2040)")
def storage_newer_rows(spark, sf_dir):
    done = spark.sql("SELECT 'shop' AS schema_name, 'orders' AS table_name, 2040L AS last_ts")
    return consumer.newer_rows(fixtures.log(spark, sf_dir), done, ["schema_name", "table_name"]).select("seq")


@_query(f"{_WITH_LOG} SELECT table_id, position FROM (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY {_ORDER}) AS position FROM log) WHERE position % 100 = 1")
def bootstrap_messages(spark, sf_dir):
    own = changelog.number_by_commit(fixtures.log(spark, sf_dir), ["table_id"])
    return own.where(consumer.bootstrap_points(own, "position", 100)).select("table_id", F.col("position").cast("long").alias("position"))


_FAULTS = f"{_WITH_LOG}, newest AS (SELECT o_orderkey, arg_max(op, ({_ORDER})) AS op FROM log GROUP BY o_orderkey), failing AS (SELECT o_orderkey FROM newest WHERE (op = 'D') = (o_orderkey % 10 <> 0))"
_FIRST = "CASE WHEN o_orderkey % 5 = 0 THEN 100 WHEN o_orderkey % 3 = 0 THEN 80 ELSE 110 END"


def _validated(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    failing = feed.validate(own, fixtures.base(spark, sf_dir), KEYS, VALUES, full=False).select("o_orderkey")
    pending = fixtures.tables(spark, sf_dir, "orders")["orders"].where("o_orderkey % 15 <> 1 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)").select("o_orderkey", F.expr(_FIRST).alias("first_failed"))
    return consumer.validation_step(pending, failing, 110, 20, KEYS)


@_query(f"{_FAULTS} SELECT o_orderkey, {_FIRST} AS first_failed FROM failing WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def validation_pending(spark, sf_dir):
    return _validated(spark, sf_dir)[0].select("o_orderkey", F.col("first_failed").cast("int").alias("first_failed"))


@_query(f"{_FAULTS} SELECT o_orderkey FROM failing WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def validation_errors(spark, sf_dir):
    return _validated(spark, sf_dir)[1].select("o_orderkey")


@_query("SELECT CAST(l_linenumber AS INTEGER) AS status, count(*) AS count, CASE l_linenumber WHEN 1 THEN 'new' WHEN 2 THEN 'ignored' ELSE NULL END AS name FROM lineitem GROUP BY l_linenumber")
def error_counts(spark, sf_dir):
    lines = fixtures.tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_linenumber").cast("int").alias("status"))
    return consumer.error_counts(lines, {1: "new", 2: "ignored"})


@_query(f"{_WITH_LOG}, marks AS (SELECT DISTINCT table_id, commit_ts AS ts FROM log WHERE seq % 5 = 0), open AS (SELECT table_id, min(commit_ts) AS low FROM log WHERE commit_ts > 2000 + table_id * 10 AND seq % 3 = 0 GROUP BY table_id) SELECT table_id, coalesce(max(ts) FILTER (low IS NULL OR ts < low), 0) AS checkpoint FROM marks LEFT JOIN open USING (table_id) GROUP BY table_id")
def checkpoint_progress(spark, sf_dir):
    own = fixtures.log(spark, sf_dir)
    rows = own.select("table_id", "commit_ts", (~((F.col("commit_ts") > 2000 + F.col("table_id") * 10) & (F.col("seq") % 3 == 0))).alias("flushed"))
    return feed.checkpoints(own.where("seq % 5 = 0").select("table_id", F.col("commit_ts").alias("ts")).distinct(), rows, ["table_id"])


@_query(f"{_WITH_LOG}, part AS (SELECT * FROM log WHERE commit_ts <= 2044), final AS ({_FINAL.format('part')}) {_APPLIED}")
def snapshot_read(spark, sf_dir):
    return changelog.snapshot(fixtures.base(spark, sf_dir), fixtures.log(spark, sf_dir), KEYS, 2044)


@_query("SELECT * FROM (VALUES (3, 40), (5, 60)) AS t(id, finished_ts)")
def ddl_puller(spark, sf_dir):
    jobs = spark.sql("SELECT * FROM (VALUES (1, 20, 5), (2, 30, 6), (3, 40, 7), (4, 50, 0), (5, 60, 8), (5, 60, 8)) AS t(id, finished_ts, schema_version)")
    return feed.ddl_jobs(jobs, 30).select("id", "finished_ts")


@_query(f"""{_WITH_LOG}, versions AS ({_VERSIONS}) SELECT seq, coalesce((SELECT max(version) FROM versions v WHERE v.table_id = log.table_id AND v.ts < log.commit_ts), -1) AS version FROM log WHERE table_id < 2""")
def schema_as_of_or_error(spark, sf_dir):
    versions = spark.sql(_VERSIONS).select(F.col("table_id").cast("long").alias("table_id"), F.col("ts").cast("long").alias("ts"), "version")
    return changelog.as_of(fixtures.log(spark, sf_dir).where("table_id < 2").select("seq", "table_id", "commit_ts"), versions, "table_id").select("seq", "version")


@_query(f"""{_WITH_LOG} SELECT seq, list_sort(list_distinct(list_filter([CASE WHEN op <> 'I' THEN 'orders|o_orderkey=' || o_orderkey END, CASE WHEN op <> 'D' THEN 'orders|o_orderkey=' || o_orderkey END,
  CASE WHEN op <> 'I' THEN 'orders|o_orderpriority=' || lower(substring(b_priority, 1, 3)) END, CASE WHEN op <> 'D' THEN 'orders|o_orderpriority=' || lower(substring(a_priority, 1, 3)) END,
  CASE WHEN op <> 'I' THEN 'customer|c_custkey=' || b_custkey END, CASE WHEN op <> 'D' THEN 'customer|c_custkey=' || a_custkey END], lambda x: x IS NOT NULL))) AS keys FROM log""")
def causality_with_parents(spark, sf_dir):
    parent = changelog.ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    keys = changelog.causality_keys(F.lit("orders"), [["o_orderkey"], ["o_orderpriority"]], VALUES, False, ["o_orderpriority"], {"o_orderpriority": 3}, [parent])
    return fixtures.log(spark, sf_dir).select("seq", F.array_sort(keys).alias("keys"))


_TOPIC_DDL = "SELECT * FROM (VALUES (1, 'rename table', 'shop', 'b_new', 'a_old'), (2, 'create database', 'shop', '', NULL), (3, 'add column', 'shop', 'c', NULL), (4, 'rename table', 'shop', 'a_old', 'z')) AS t(id, type, schema_name, table_name, pre_table_name)"


@_query("SELECT * FROM (VALUES (1, 'old_shop_x'), (2, 'main'), (3, 'main'), (4, 'main')) AS t(id, topic)")
def ddl_topics(spark, sf_dir):
    return routing.ddl_topic(spark.sql(_TOPIC_DDL), [routing.DispatchRule("shop.*_old", "old_{schema}_x", "ts")], "main").select("id", "topic")
