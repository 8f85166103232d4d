"""Storage layout, feed source, relay, streams that restart, progress, conflicts and binary forms."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import binary, codecs, decoders, protobuf
from changeloom.operators import changelog, conflicts, ddl, diff, filters, redo, routing, spans, statements
from changeloom.plans import fixtures
from changeloom.plans.catalog import narrow_log
from changeloom.sources import files, storage
from changeloom.streaming import feed

SF = "/root/testdata/sf0.001"


def test_storage_files_and_their_schema(spark, tmp_path):
    own = narrow_log(spark, SF)
    text = storage.definition("shop", "orders", [("o_orderkey", "bigint", False)], ["o_orderkey"])
    wrote = storage.write(codecs.csv_lines(own), f"file://{tmp_path}", [("shop", "orders", 1, text), ("shop", "orders", 2, text)], 100)
    files = {r["path"]: r["n"] for r in wrote.collect()}
    assert sum(files.values()) == own.count() and max(files.values()) <= 100 and "shop/orders/1/CDC000001.csv" in files
    last = max(x for x in files if x.startswith("shop/orders/1/")).rsplit("/", 1)[1]
    assert (tmp_path / "shop/orders/1/meta/CDC.index").read_text().strip() == last
    schemas = [x.name for x in (tmp_path / "shop/orders/meta").iterdir()]
    assert schemas == [f"schema_1_{zlib.crc32(text.encode()):010d}.json"]  # the second version has the same definition
    assert storage.data_version(schemas, 7, text) == (1, False) and storage.data_version(schemas, 7, text + " ") == (7, True)
    lines = storage.read(spark, str(tmp_path), ["shop/orders", "shop/orders_old"])
    back = decoders.from_csv_lines(lines, own.schema["after"].dataType)
    assert sorted(r["commit_ts"] for r in back.collect()) == sorted(r["commit_ts"] for r in own.collect())
    first = (tmp_path / "shop/orders/1/CDC000001.csv").read_text().splitlines()
    assert [int(x.split(",")[3]) for x in first] == sorted(int(x.split(",")[3]) for x in first)


def test_feed_source_by_span(spark, tmp_path):
    for span in ("a", "b"):
        rows = [{"kind": "row", "table_id": 1, "op": "I", "commit_ts": ts, "start_ts": ts - 1, "value": json.dumps({"k": ts})} for ts in range(1, 6)]
        (tmp_path / f"{span}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(feed.ChangeFeed)
    got = spark.read.format("changes").option("path", str(tmp_path)).option("start_ts", "2").load()
    assert got.rdd.getNumPartitions() == 2 and sorted((r["span"], r["commit_ts"]) for r in got.collect()) == [(s, ts) for s in "ab" for ts in (3, 4, 5)]
    assert {r["op"] for r in filters.mount(got, T.StructType().add("k", "long")).collect()} == {"I"}


def test_relay_keeps_what_is_not_done(spark, tmp_path):
    relay, log = feed.Relay(str(tmp_path)), fixtures.log(spark, SF)
    for n, (low, high) in enumerate(((0, 1999), (2000, 2999), (3000, 9999))):
        relay.land(log.where(F.col("commit_ts").between(low, high)), n)
    relay.land(log, 1)  # a batch that comes again changes nothing
    assert relay.read(spark).count() == log.count() and relay.read(spark, 1).agg(F.min("commit_ts")).first()[0] >= 3000
    assert relay.purge(spark, 1500) == [0] and relay.purge(spark, 99_999) == [1]
    assert relay.read(spark).count() == log.where("commit_ts >= 3000").count()


def test_table_versions_of_a_stream(spark, tmp_path):
    base, log = fixtures.base(spark, SF), fixtures.log(spark, SF)
    base.write.parquet(f"{tmp_path}/table/v-0")
    for n, (low, high) in enumerate(((0, 1999), (2000, 9999))):
        log.where(F.col("commit_ts").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        feed.apply_stream(feed.read_files(spark, f"{tmp_path}/in/*", log.schema), f"{tmp_path}/table", ["o_orderkey"], f"{tmp_path}/check").awaitTermination()
    newest = feed.current_version(spark, f"{tmp_path}/table")
    assert newest == 2
    assert sorted(spark.read.parquet(f"{tmp_path}/table/v-{newest}").collect()) == sorted(changelog.apply_log(base, log, ["o_orderkey"]).collect())


def test_state_on_disk(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    feed.keep_state_on_disk(spark)
    try:
        events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        events.write.parquet(f"{tmp_path}/in/a")
        events.limit(50).write.parquet(f"{tmp_path}/in/b")
        stream = feed.without_repeats(feed.read_files(spark, f"{tmp_path}/in/*", events.schema), ["event_id"], "ts", "400 days")
        feed.run_available(stream, lambda rows, n: rows.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/check")
        assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_progress_waits_for_every_row_before_a_mark():
    p = feed.Progress()
    a, b = p.add(), p.add()
    p.resolve(5)
    c = p.add()
    p.resolve(9)
    p.resolve(7)  # a mark never goes back
    assert p.advance() == 0
    p.flushed(c)
    p.flushed(a)
    assert p.advance() == 0
    p.flushed(b)
    assert p.advance() == 9


def test_waves_and_relations():
    keys = [["a"], ["b"], ["a", "c"], ["c"], ["b", "c"], ["d"]]
    assert conflicts.wave_numbers(keys) == [1, 1, 2, 3, 4, 1]
    assert conflicts.relation_numbers(keys) == [(0, 0), (0, 1), (0, 0), (0, 0), (1, 2), (1, 3)]
    rng = random.Random(4)
    keys = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 3))] for _ in range(200)]
    found = conflicts.wave_numbers(keys)
    for i in range(200):
        for j in range(i):
            assert not set(keys[i]) & set(keys[j]) or found[j] < found[i]


def test_avro_bytes(spark):
    columns = T.StructType().add("a", "long", False).add("b", "string").add("c", "double").add("d", "boolean")
    rows = [(1, (-3, "é", 1.5, True)), (2, (1 << 62, None, None, False)), (3, None)]
    frame = spark.createDataFrame(rows, T.StructType().add("id", "long").add("r", columns))
    sent = frame.select("id", "r", binary.to_avro(columns, 7)(F.col("r")).alias("value"))
    raw = {r["id"]: r["value"] for r in sent.collect()}
    assert bytes(raw[1]) == b"\0\0\0\0\7" + b"\5" + b"\2\4\xc3\xa9" + b"\2" + struct.pack("<d", 1.5) + b"\2\1" and raw[3] is None
    assert [(r["id"], r["row"]) for r in binary.from_avro(sent, columns).select("id", "row").collect()] == [(r["id"], r["r"]) for r in frame.collect()]


def test_protobuf_fields():
    assert protobuf.field(1, 150) == b"\x08\x96\x01" and protobuf.field(2, "testing") == b"\x12\x07testing"
    assert protobuf.fields(protobuf.field(1, 150) + protobuf.field(12, "a") + protobuf.field(12, b"b")) == {1: [150], 12: [b"a", b"b"]}


def test_row_checksum_against_zlib(spark):
    columns = T.StructType().add("a", "long").add("b", "string").add("c", "double").add("d", "binary")
    rows = [(-5, "é x", 2.25, b"\1\2"), (None, None, float("nan"), None), (7, "", None, b"")]
    frame = spark.createDataFrame(rows, columns)
    got = [r[0] for r in frame.select(binary.row_checksum([(F.col(f.name), f.dataType) for f in columns.fields])).collect()]

    def text(v):
        raw = v.encode() if isinstance(v, str) else v
        return struct.pack("<I", len(raw)) + raw

    want = []
    for a, b, c, d in rows:
        raw = b"" if a is None else struct.pack("<q", a)
        raw += b"" if b is None else text(b)
        raw += b"" if c is None else struct.pack("<d", c if c == c else 0.0)
        want.append(zlib.crc32(raw + (b"" if d is None else text(d))))
    assert got == want


def test_csv_bytes_and_escapes(spark):
    columns = T.StructType().add("k", "long").add("s", "string").add("x", "binary")
    log = spark.createDataFrame([("I", "s", "t", 9, None, (1, 'a "q", b', b"\0\xff"))], T.StructType().add("op", "string").add("schema_name", "string").add("table_name", "string").add("commit_ts", "long").add("before", columns).add("after", columns))
    assert codecs.csv_lines(log).first()["line"] == '"I","t","s",9,1,"a ""q"", b",AP8='
    assert codecs.csv_lines(log, binary="hex").first()["line"].endswith(",00ff")


def test_maxwell_tells_a_value_that_was_null(spark):
    one = "struct<k:long,v:string>"
    log = spark.createDataFrame([("U", "s", "t", 1 << 30, (1, None), (1, "x"))], f"op string, schema_name string, table_name string, commit_ts long, before {one}, after {one}")
    message = log.select(codecs.maxwell(log).alias("message"))
    assert '"old":{"v":null}' in message.first()["message"]
    assert decoders.from_maxwell(message, log.schema["after"].dataType).first()["before"] == (1, None)


def test_version_must_be_there(spark):
    events = spark.createDataFrame([(1, 5), (1, 3)], "table_id long, commit_ts long")
    versions = spark.createDataFrame([(1, 3, "v")], "table_id long, ts long, name string")
    assert {r["commit_ts"]: r["name"] for r in changelog.as_of(events, versions, "table_id", missing="null").collect()} == {5: "v", 3: None}
    with pytest.raises(Exception, match="no version before 3"):
        changelog.as_of(events, versions, "table_id").collect()


def test_partition_id_takes_all_its_bits(spark):
    big = (1 << 63) - 1
    assert spark.range(1).select(routing.partition_id(F.lit(big), None, None, None)).first()[0] == big


def test_disjoint_spans_are_an_error(spark):
    with pytest.raises(Exception, match="disjoint"):
        spark.range(1).select(spans.clip(F.lit("a"), F.lit("c"), F.lit("d"), F.lit("e"))).collect()


def test_statements_of_a_table_without_key(spark):
    log = narrow_log(spark, SF)
    assert {r["op"] for r in statements.single_row(log, []).select("op").distinct().collect()} == {"I"}
    assert statements.single_row(log, [], force_replicate=True).count() == log.count()
    text = statements.single_row(log.where("op = 'D'"), ["o_orderkey"]).first()["statement"]
    assert text.startswith("DELETE FROM `shop`.`") and text.endswith(" LIMIT 1")


def test_statement_splitting_keeps_quotes_and_brackets():
    assert ddl.split_statement("ALTER TABLE `a,b` ADD COLUMN c ENUM('x,y', \"z\") COMMENT 'it''s, so', DROP COLUMN d;", "s") == ["ALTER TABLE `s`.`a,b` ADD COLUMN c ENUM('x,y', \"z\") COMMENT 'it''s, so'", "ALTER TABLE `s`.`a,b` DROP COLUMN d"]
    assert ddl.split_statement("SELECT 1", "s") == ["SELECT 1"]


def test_splitters():
    assert [diff.splitter(*x) for x in (("auto", True, True), ("auto", False, True), ("limit", True, True), ("random", False, False))] == ["bucket", "random", "limit", "single"]
    with pytest.raises(ValueError, match="unknown strategy"):
        diff.splitter("best", True, True)


def test_chunks_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 250).alias("k"), F.col("id").alias("n"))
    got = [[(r["chunk"], r["upper"]["k"], r["upper"]["n"], r["n"]) for r in diff.chunk_bounds(rows.repartition(p), ["k", "n"], 100).orderBy("chunk").collect()] for p in (1, 7)]
    ordered = sorted((k % 250, k) for k in range(1000))
    assert got[0] == got[1] == [(c, *ordered[c * 100 + 99], 100) for c in range(10)]


def test_pulsar_topics():
    assert [routing.valid_pulsar_topic(x) for x in ("persistent://a/b/{schema}_{table}", "persistent://a/b", "t", "a/b", "")] == [True, False, True, False, False]


def test_rules_that_name_what_is_not_there(spark):
    log = fixtures.log(spark, SF)
    with pytest.raises(ValueError, match="no index uk"):
        routing.dispatch(log, [routing.DispatchRule("*.*", "t", "index-value", index="uk")], "m", 4, ["o_orderkey"])
    with pytest.raises(ValueError, match="no column nothing"):
        routing.dispatch(log, [routing.DispatchRule("*.*", "t", "columns", ("nothing",))], "m", 4, ["o_orderkey"])


def test_retention_deletes_old_days(spark, tmp_path):
    for day in ("2024-01-01", "2024-02-01"):
        (tmp_path / f"s/t/1/{day}").mkdir(parents=True)
        (tmp_path / f"s/t/1/{day}/CDC000001.csv").write_text("x")
    gone = files.remove_expired(spark, f"file://{tmp_path}", "2024-02-03", 7)
    assert len(gone) == 1 and sorted(x.name for x in (tmp_path / "s/t/1").iterdir()) == ["2024-02-01"]


def test_repair_files_by_chunk(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "chunk long, statement string")
    files.write_repairs(rows, f"{tmp_path}/fix")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/fix/chunk=1").collect()) == ["a", "b"] and spark.read.text(f"{tmp_path}/fix").count() == 3


def test_debezium_with_its_schema(spark):
    log = fixtures.log(spark, SF)
    columns = log.schema["after"].dataType
    block = codecs.debezium_schema(columns, "c", "shop", "orders")
    message = json.loads(log.select(codecs.debezium(log, "c", block).alias("m")).first()["m"])
    assert [f["field"] for f in message["schema"]["fields"]] == ["before", "after", "op", "ts_ms"] and message["payload"]["op"] in "cud"
    assert message["schema"]["fields"][1]["fields"][0] == {"type": "int64", "optional": True, "field": "o_orderkey"}


def test_messages_too_large_for_their_keys(spark):
    with pytest.raises(Exception, match="too large"):
        codecs.canal_json_within(fixtures.log(spark, SF), ["o_orderkey"], 10).select("message").collect()


def test_redo_ddl_at_the_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([(10, 1, "create table"), (20, 2, "add column"), (20, 3, "exchange partition"), (30, 4, "drop table"), (50, 5, "add column")], "commit_ts long, seq long, type string")
    redo.write_ddl(rows, f"{tmp_path}/ddl")
    redo.write_ddl(rows.where("seq = 4"), f"{tmp_path}/ddl")
    got = redo.read_ddl(spark, f"{tmp_path}/ddl", 20, 40, ["add column"])
    assert sorted(r["seq"] for r in got.collect()) == [2, 4]
