"""The corpus operators as registered queries, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import decontaminate, language, licenses, lmscore, neardup, packing, repeats, secrets, topk, toxicity
from changeloom.llm.frames import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(documents, toxicity.train(documents, toxicity.severity_grades(labels)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.learn_and_predict(documents, held_out("doc_id", 4)).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    training = documents.where(~held_out("doc_id", 7))
    counts = lmscore.word_counts(training.select("text"))
    return lmscore.score(documents, counts, lmscore.train(training, counts)).withColumn("held_out", held_out("doc_id", 7))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_jaccard, op3_topk, op4_toxicity, op5_substring_dedup, op6_packing, op7_secrets, op8_language, op9_lm_score, op10_licenses)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_decontaminate": rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, w[i : i + 7] AS g FROM item, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
span AS (SELECT DISTINCT len(g) AS l FROM win),
probe AS (SELECT doc_id, l, i, w[i : i + l - 1] AS g FROM doc, span, unnest(range(1, len(w) - l + 2)) AS t(i)),
hit AS (SELECT doc_id, i, l, item FROM probe JOIN win USING (g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, {_PLAIN_WORDS.format(_FOLD)} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM doc, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * shared >= 90 * (s.n + t.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low AS component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc.doc_id""",
    "op3_topk": """
WITH whole AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 64) FOR x IN embedding] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op5_substring_dedup": rf"""
WITH doc AS (SELECT doc_id, {_PLAIN_WORDS.format("coalesce(text, '')")} AS w FROM documents),
run AS (SELECT doc_id, i, w[i : i + 12] AS g FROM doc, unnest(range(1, len(w) - 11)) AS t(i)),
owner AS (SELECT g, min(doc_id) AS low FROM run GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM run JOIN owner USING (g), unnest(range(i, i + 13)) AS t(p) WHERE low < doc_id),
word AS (SELECT doc_id, p, w[p] AS x FROM doc, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)""",
}
