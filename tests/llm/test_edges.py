"""Clashing columns, repeated rows, ties, very long texts, hot passages and the pipeline's stages."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeloom.llm import components, decontaminate, language, licenses, lmscore, neardup, packing, repeats, secrets, topk, toxicity
from changeloom.llm.frames import fresh

WORDS = [f"w{k}" for k in range(60)]
#: Names that operators use within.
CLASHES = ["id", "_id", "key", "at", "_at", "_row_key", "gone_id", "component", "component_id", "u", "v", "n", "words", "anchors", "others", "owner", "held_out", "accepted", "lang_pred", "window", "items", "spans", "step", "probe", "members", "prefix", "severity", "license"]


@pytest.fixture
def rng():
    return random.Random(11)


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def with_clashes(frame):
    return frame.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in CLASHES})


def untouched(frame):
    rows = frame.collect()
    assert frame.columns[-len(CLASHES) :] == CLASHES
    assert all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHES)
    return {r["doc_id"]: r["text"] for r in rows}


def test_fresh_names():
    assert fresh(["a", "_A"], "a") == "__a" and fresh([], "a") == "a"


def test_clashing_columns_stay(docs, spark, rng):
    body = prose(rng, 40)
    table = with_clashes(docs([(1, body), (2, body + " end"), (3, prose(rng, 30)), (4, "password=hunter2222"), (5, None)]))
    bench = spark.createDataFrame([(1, " ".join(body.split()[5:15]))], "item_id long, text string").withColumn("key", F.lit(1)).withColumn("window", F.lit(2))
    assert set(untouched(decontaminate.remove(table, bench))) == {3, 4, 5}
    spans = untouched(decontaminate.remove(table, bench, "spans"))
    assert spans[1] == " ".join(body.split()[:5] + body.split()[15:]) and spans[5] is None
    assert set(untouched(neardup.keep_one(table))) == {1, 3, 4, 5}
    assert untouched(secrets.redact(table))[4] == "[secret]"
    assert set(untouched(language.keep_known(table, None))) == set()
    assert decontaminate.scan(table, bench).count() == neardup.classes(table).count() == repeats.remove(table).count() == secrets.scan(table).count() == licenses.scan(table).count() == 5
    assert language.learn_and_predict(table, F.lit(False)).count() == toxicity.score(table, toxicity.train(table, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"))).count() == 5
    counts = lmscore.word_counts(table.select("text"))
    assert lmscore.score(table, counts, lmscore.train(table, counts)).count() == 5
    vectors = spark.createDataFrame([(k, [float(k), 1.0], "x") for k in range(5)], "vec_id long, embedding array<double>, v string").withColumns({"score": F.lit(1), "rank": F.lit(2), "query_id": F.lit(3)})
    assert topk.top_k(vectors, F.col("vec_id") == 0, 2).count() == 2


def test_a_passage_in_every_document_and_every_item(docs, spark, rng):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(k, f"{prose(rng, 5)} {passage} {prose(rng, 5)}") for k in range(200)] + [(500, prose(rng, 40))]
    bench = spark.createDataFrame([(k, f"i{k} {passage}") for k in range(60)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.scan(docs(rows), bench, block=7).collect()}
    ids = ",".join(sorted(str(k) for k in range(60)))
    assert all(out[k]["n_hit"] == 20 and out[k]["n_items"] == 60 and out[k]["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest() for k in range(200))
    assert (out[500]["n_hit"], out[500]["n_items"]) == (0, 0)
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove(docs(rows)).collect()), key=str)
    assert got == windows_removed(rows) and min(n for k, n, _ in got if 0 < k < 200) >= 20


def windows_removed(rows, span=13):
    first, out = {}, []
    for k, text in sorted(((k, t) for k, t in rows if k is not None), key=lambda r: r[0]):
        w = (text or "").split()
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), k)
    for k, text in rows:
        w = (text or "").split()
        gone = {j for i in range(len(w) - span + 1) if k is not None and first[tuple(w[i : i + span])] < k for j in range(i, i + span)}
        out.append((k, len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 24])
def test_repeats_with_copies_of_copies_and_repeated_rows(docs, rng, bits):
    base = [prose(rng, 60).split() for _ in range(6)]
    rows = [(None, " ".join(base[0])), (3, None), (3, "")]
    for k in range(150):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(40), rng.randrange(40)
        rows.append((k // 2 if k < 20 else k, " ".join([*rng.choices(WORDS, k=3), *a[i : i + rng.randint(5, 40)], *rng.choices(WORDS, k=rng.randint(0, 2)), *b[j : j + rng.randint(5, 40)]])))
    rows += rows[50:60]  # whole rows again
    rows.append((900, "same " * 2000))
    rows.append((901, "same " * 1500 + prose(rng, 5)))
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove(docs(rows), bits=bits).collect()), key=str)
    if bits == 64:
        assert got == windows_removed(rows)
    else:  # chance collisions never remove a word that isn't repeated
        assert len(got) == len(rows) and sum(n for _, n, _ in got) <= sum(n for _, n, _ in windows_removed(rows))


def test_reading_of_lists_stops_by_the_bounds():
    generator = np.random.default_rng(2)
    rows = np.floor(64 * generator.normal(size=(6000, 16)) / 4)
    queries = rows[:64]
    best = topk.Best(np.arange(64), queries, 10)
    for at in range(0, 6000, 2000):
        best.add(np.arange(at, at + 2000), rows[at : at + 2000])
    assert len(best.depths) == 3 and all(depth < 1 for depth in best.depths)
    for query, found, score in best.rows():
        for q in range(64):
            want = sorted((-int(queries[q] @ rows[k]), k) for k in range(6000) if k != q)[:10]
            own = query == q
            assert sorted(zip((-score[own]).tolist(), found[own].tolist(), strict=True)) == want


def test_top_k_counts_every_row_and_blocks_of_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.5, 0.2]), (2, [0.25, 0.0]), (20, [0.0, 1.0]), (40, [1.0] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, 3, query_values=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 64 * 32), (0, 2, 1, 64 * 32), (0, 3, 2, 64 * 16), (20, 1, 1, 64 * 12), (20, 2, 1, 64 * 6), (20, 3, 0, 0)]


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    out = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{k: 0 for k in range(1, 400)}, **{k: 1000 for k in range(1001, 1061)}}


def test_word_counts_with_more_words_than_ranks(docs, rng):
    keys, n = neardup.word_counts(docs([(1, " ".join(f"a{k} a{k}" for k in range(100)))]).select("text"), ranked=10)
    assert len(keys) == len(n) == 0  # all occur as often: none is ranked, and none reaches the driver
    rows = [(k, prose(rng, 30)) for k in range(40)] * 2
    assert {r["component_id"] for r in neardup.classes(docs(rows), 3, Fraction(9, 10)).collect()} == set(range(40))


def test_repeated_and_very_long_rows(docs, spark, rng):
    long = prose(rng, 20_000)
    rows = [(1, long), (1, long), (2, long + " more"), (3, "x" * 200_000), (None, "x")]
    table = docs(rows)
    assert [r["n_shingles"] for r in neardup.classes(table).where("doc_id = 1").collect()] == [len({tuple(long.split()[i : i + 5]) for i in range(19_996)})] * 2
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove(table).collect()}[2] == 20_000
    bench = spark.createDataFrame([(7, " ".join(long.split()[19_000:19_020])), (8, "x" * 200_000)], "item_id long, text string")
    assert {(r["doc_id"], r["contaminated"], r["n_items"]) for r in decontaminate.scan(table, bench, 1).collect()} == {(1, True, 1), (2, True, 1), (3, True, 1), (None, False, 0)}
    assert sum(r["length"] for r in packing.pack(docs([]), __import__("changeloom.llm.queries", fromlist=["x"]).tokenizer_path()).collect()) == 0
    assert [r["license"] for r in licenses.scan(docs([(1, f"{long}\nReleased under the MIT License.\n{long}")] * 2)).collect()] == ["MIT"] * 2


def test_packing_of_ties_and_empty_texts(docs):
    path = __import__("changeloom.llm.queries", fromlist=["x"]).tokenizer_path()
    out = packing.pack(docs([(k, "") for k in range(100)] + [(200, None)]), path, 64).collect()
    assert len(out) == 101 and all((r["start"], r["length"], r["doc_tokens"]) == (0, 1, 1) for r in out)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 101 and len({r["sequence_id"] for r in out}) == 2


def tongue(rng, letters, n=40):
    return " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))


def test_language_rejects_what_it_never_saw(docs, rng):
    rows = [(k, tongue(rng, "abcde" if k % 2 else "vwxyz"), "xx" if k % 2 else "yy", None, None) for k in range(200)]
    odd = [(1000 + k, tongue(rng, "kmnopq"), None, None, None) for k in range(5)] + [(2000, "жзий клмн опрс", None, None, None), (2001, None, "xx", None, None), (2002, "1 2", "xx", None, None)]
    table = docs(rows + odd)
    kept = {r["doc_id"] for r in language.keep_known(table, language.train(table.where("lang IS NOT NULL"))).collect()}
    assert kept == set(range(200))
    few = docs(rows + [(300, tongue(rng, "klmno"), "zz", None, None)])
    assert language.train(few).limit[2] < np.inf  # a language of one document has a limit too


def test_conflicting_labels_and_rows_through_score(docs, spark, rng):
    rows = [(k, prose(rng, 20) + (" bad worse" if k % 3 == 0 else "")) for k in range(300)] + [(1000, None), (1001, "bad " * 20_000), (1001, "bad worse"), (None, "bad worse")]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(0, 1, 0), (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), toxicity.severity_grades(labels))
    again = toxicity.train(docs(rows[::-1]), toxicity.severity_grades(labels))
    assert np.array_equal(model.words, again.words) and np.allclose(model.weight, again.weight)
    out = [(r["doc_id"], r["severity"], r["toxic"]) for r in toxicity.score(docs(rows), model).collect()]
    assert len(out) == len(rows) and all(toxic == (k % 3 == 0) for k, _, toxic in out if k is not None and k < 300)
    assert sum(k == 1001 for k, *_ in out) == 2 and {toxic for k, _, toxic in out if k is None} == {True}


def pipeline_rows(rng):
    body = [prose(rng, 60) for _ in range(8)]
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate(body)]
    rows += [(10 + k, text + " end", "en", "s", 1) for k, text in enumerate(body[:3])]  # near copies
    rows += [(20, body[5].replace(" ", "\n", 3), "en", "s", 1), (21, "1234 5678", "en", "s", 1), (22, None, "en", "s", 0)]
    rows += [(23, prose(rng, 50) + " password=hunter2222 " + prose(rng, 50), "en", "s", 1)]
    rows += [(24, " ".join(prose(rng, 20).split() + body[7].split()[10:20] + prose(rng, 60).split()), "en", "s", 1)]
    return rows, body


def test_pipeline_against_its_parts(spark, rng, tmp_path):
    rows, body = pipeline_rows(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(body[7].split()[8:22]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, frame, seen = {r[0]: r[1] for r in rows}, spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == [c.split()[0] for c in schema.split(", ")]
        seen[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert set(seen["language ID"]) == set(kept) - {21, 22}
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in seen["language ID"].items()}
    gone = {k for k in shingles for j in shingles if j < k and 10 * len(shingles[j] & shingles[k]) >= 8 * len(shingles[j] | shingles[k])}
    assert set(seen["n-gram Jaccard join"]) == set(shingles) - gone and gone == {10, 11, 12, 20}
    assert set(seen["benchmark decontamination"]) == set(shingles) - gone - {7, 24}
    assert "hunter2222" not in seen["secret scans"][23] and seen["secret scans"][0] == body[0]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["secret scans"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
