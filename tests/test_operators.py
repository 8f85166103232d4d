import zlib

import pytest
from pyspark.sql import functions as F

from changeloom.functions import codecs
from changeloom.operators import changelog, diff, filters, redo, routing, schemas
from changeloom.plans import fixtures
from changeloom.sources import files
from changeloom.streaming import feed

SF = "/root/testdata/sf0.001"


def test_compaction_then_apply_equals_apply(spark):
    base, log = fixtures.base(spark, SF), fixtures.log(spark, SF)
    whole = changelog.apply_log(base, log, ["o_orderkey"])
    steps = base
    for low, high in ((0, 1999), (2000, 2999), (3000, 9999)):
        steps = changelog.apply_log(steps, log.where(F.col("commit_ts").between(low, high)), ["o_orderkey"])
    assert sorted(whole.collect()) == sorted(steps.collect())
    assert diff.diff(whole, steps, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice"], 64).count() == 0


def test_compaction_of_each_pair(spark):
    one = "struct<k:long,v:long>"
    rows = [(k, op, n, None if op == "I" else (k, n), None if op == "D" else (k, n + 10)) for k, ops in enumerate(["IU", "UU", "ID", "UD", "DI", "I", "IUDI"]) for n, op in enumerate(ops)]
    log = spark.createDataFrame([(op, n, n, k * 10 - n, b, a) for k, op, n, b, a in rows], f"op string, commit_ts long, start_ts long, seq long, before {one}, after {one}")
    out = {r["k"]: (r["op"], r["safe_mode"]) for r in changelog.compact(log, ["k"]).collect()}
    assert out == {0: ("I", False), 1: ("U", False), 2: ("D", False), 3: ("D", False), 4: ("I", True), 5: ("I", False), 6: ("I", True)}


def test_null_predicate_keeps_the_row(spark):
    one = "struct<k:long,v:long>"
    log = spark.createDataFrame([("I", None, (1, None)), ("I", None, (2, 5)), ("U", (3, None), (3, 9)), ("D", (4, 7), None)], f"op string, before {one}, after {one}")
    skipped = filters.mark_expression(log, insert="v > 1", update_old="v > 1", update_new="v > 100", delete="v > 1").where("skipped")
    assert sorted(r["op"] for r in skipped.collect()) == ["D", "I"]
    both = filters.mark_migration(log, [{"update_old": "v is null", "update_new": "v = 9"}]).where("skipped")
    assert [r["op"] for r in both.collect()] == ["U"]


def test_table_rules(spark):
    names = spark.createDataFrame([("shop", "a1"), ("shop", "e1"), ("mysql", "user"), ("Shop", "B")], "schema_name string, table_name string")
    kept = names.where(filters.TableRules(("*.*", "!shop.[!a-d]*")).column())
    assert sorted(r["table_name"] for r in kept.collect()) == ["B", "a1"]


def test_selection_needs_a_key(spark):
    log = fixtures.log(spark, SF)
    with pytest.raises(ValueError, match="no primary"):
        filters.select_columns(log, [filters.ColumnSelector("*.*", ("o_custkey",))], "shop", "orders", ["o_orderkey"])


def test_partition_hash_is_xor_of_crc(spark):
    row = spark.range(1).select(routing.inertia_hash(F.lit("s"), F.lit("t"), [("a", F.lit(1)), ("b", F.lit(None))]).alias("h")).first()
    assert row["h"] == zlib.crc32(b"st") ^ zlib.crc32(b"a1") ^ zlib.crc32(b"bnull")


def test_topics(spark):
    rows = spark.createDataFrame([("s-1", "t é"), ("", "."), ("x" * 300, "t")], "s string, t string").select(routing.topic("{schema}{table}", F.col("s"), F.col("t")).alias("x"))
    assert [r["x"] for r in rows.collect()] == ["s-1t__", "_", "x" * 249]
    assert routing.valid_topic("a_{schema}_{table}", "avro") and not routing.valid_topic("a_{schema}", "avro")


def test_partition_id_rejects_large_numbers(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(routing.partition_id(F.lit(1), 99, F.lit(1), F.lit(1))).collect()


def test_redo_round_trip(spark, tmp_path):
    log = fixtures.log(spark, SF)
    redo.write(log, str(tmp_path / "redo"), 1024)
    redo.write_meta(spark, str(tmp_path / "meta"), 1020, 3040)
    low, high = redo.read_meta(spark, str(tmp_path / "meta"))
    got = redo.read(spark, str(tmp_path / "redo"), low, high, 1024)
    assert sorted(r["seq"] for r in got.collect()) == sorted(r["seq"] for r in log.where(f"commit_ts > {low} AND commit_ts <= {high}").collect())


def test_claim_check(spark):
    sent, stored = codecs.claim_check(spark.createDataFrame([("a" * 50,), ("b",)], "message string"), 10, "s3://bucket/x")
    assert stored.count() == 1 and sent.where("message LIKE '%claimCheckLocation%'").count() == 1


def test_shard_ddl():
    lock = schemas.OptimisticLock({"a": {"id": ("int", False)}, "b": {"id": ("int", False)}})
    assert lock.submit("a", {"id": ("int", False), "c": ("varchar(10)", True)}) == ("none", ["ADD COLUMN c varchar(10)"])
    assert lock.submit("b", {"id": ("bigint", False), "c": ("varchar(20)", True)}) == ("none", ["MODIFY COLUMN id bigint", "MODIFY COLUMN c varchar(20)"])
    assert lock.submit("b", {"id": ("varchar(5)", False)})[0] == "conflict"
    assert lock.submit("b", {"id": ("bigint", False), "c": ("varchar(20)", True), "d": ("int", True)})[0] == "resolved"
    assert lock.submit("a", {"id": ("int", False)}) == ("none", []) and lock.dropping() == {"c"}
    assert lock.submit("a", {"id": ("int", False), "c": ("varchar(10)", True)})[0] == "conflict"
    assert lock.submit("b", {"id": ("bigint", False), "d": ("int", True)}) == ("none", ["DROP COLUMN c"])
    assert lock.submit("a", {"id": ("int", False), "c": ("varchar(10)", True)}) == ("resolved", ["ADD COLUMN c varchar(10)"])
    assert schemas.collapse_online_ddl([("create", "_t_gho", ""), ("alter", "_t_gho", "ADD COLUMN x INT"), ("rename", "t", "_t_del"), ("rename", "_t_gho", "t")]) == [("t", "ADD COLUMN x INT")]


def test_pessimistic_lock(spark):
    sources = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "target string, source string")
    sent = spark.createDataFrame([("t", "a", "D1"), ("t", "b", "D1")], "target string, source string, ddls string")
    assert {r["target"]: r["synced"] for r in schemas.pessimistic_lock(sent, sources).collect()} == {"t": True, "u": False}


def test_change_files_and_sinks(spark, tmp_path):
    lines = codecs.csv_lines(fixtures.log(spark, SF))
    files.write_change_files(lines, str(tmp_path / "out"))
    assert files.read_change_files(spark, str(tmp_path / "out")).count() == lines.count()
    files.sink("blackhole://")(lines)
    assert files.expired(["x/date=2024-01-01/a", "x/date=2024-02-01/a"], "2024-02-02", 7) == ["x/date=2024-01-01/a"]


def _emit_all(spark, folder, batches, first=0, restart=True):
    schema, out, emitter = "kind string, table_id long, op string, commit_ts long, start_ts long, seq long", [], None
    for n, rows in enumerate(batches, first):
        if emitter is None or restart:  # nothing may live in the object
            emitter = feed.ResolvedEmitter(folder, lambda rows, n: out.append([r["seq"] for r in rows.collect()]))
        emitter(spark.createDataFrame(rows, schema), n)
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_resolved_emitter_orders_and_holds(spark, tmp_path, restart):
    batches = [[("row", 1, "I", 5, 4, 1), ("row", 1, "D", 3, 2, 2), ("resolved", 1, None, 3, None, None)], [("row", 1, "U", 4, 3, 3), ("resolved", 1, None, 9, None, None)], [("resolved", 1, None, 2, None, None)]]
    assert _emit_all(spark, str(tmp_path), batches, restart=restart) == [[2], [3, 1], []]
    assert feed.ResolvedEmitter(str(tmp_path), None).resolved(spark, 3) == 9


def test_resolved_emitter_waits_for_the_slowest_table(spark, tmp_path):
    batches = [[("resolved", 1, None, 2, None, None), ("resolved", 2, None, 3, None, None)], [("row", 2, "I", 8, 7, 1), ("row", 1, "I", 3, 2, 2), ("resolved", 1, None, 9, None, None)], [("resolved", 2, None, 8, None, None)]]
    assert _emit_all(spark, str(tmp_path), batches) == [[], [2], [1]]
    again = _emit_all(spark, str(tmp_path), batches[1:], first=1)  # the last two batches run once more, as after a failure
    assert again == [[2], [1]]


def test_resolved_emitter_holds_rows_of_a_table_without_a_mark(spark, tmp_path):
    batches = [[("row", 2, "I", 1, 1, 1), ("resolved", 1, None, 9, None, None)], [("resolved", 2, None, 1, None, None)]]
    assert _emit_all(spark, str(tmp_path), batches) == [[], [1]]


def test_stream_without_repeats(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in/a"))
    events.limit(50).write.parquet(str(tmp_path / "in/b"))
    stream = feed.read_files(spark, str(tmp_path / "in/*"), events.schema)
    feed.run_available(feed.without_repeats(stream, ["event_id"], "ts", "400 days"), lambda rows, n: rows.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
