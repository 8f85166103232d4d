"""Toxicity as severity grades: a cumulative-link (proportional odds) model over word presence.

P(grade > k) = sigmoid(w . x - b_k) with one weight vector w for all ordered thresholds
b_0 <= b_1 <= ...; the expected severity is the sum of these over k.  Features are lower-cased words
that occur in a text, held as hashes; every word whose presence goes with the grade or against it in the training sample by a
chi-square test is one, so x is sparse and a text's length doesn't count against it.

The model is fitted on a bounded sample: SAMPLE labelled documents at most, those with the smallest hash of
their id.  Only the distinct words of those documents reach the driver, whole; every document is scored, over its whole text.

Defined results: null text has no words, so it gets the severity of the thresholds alone; documents with null ids
or grades are not learned from; of several grades of an id the highest counts; of rows of documents that share
an id each is learned from; repeated rows give one result each; very long texts count their distinct words; without two
different grades to learn from every severity is 0.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.words import ALNUM, LOWER, words

SAMPLE = 12_000
CHANCE = 28.0  # chi-square that one word in ten million without bearing passes


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    bounds: np.ndarray  # of each threshold, in order

    def severity(self, margin: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(self.bounds[None, :] - margin[:, None]))).sum(axis=1) if len(self.bounds) else np.zeros(len(margin))


def _word_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Of each chunk: first row, distinct (document, word) pairs in order, number of documents."""
    for w in words(texts, ALNUM, LOWER):
        order = np.lexsort((w.hash, doc := w.doc))
        doc, key = doc[order], w.hash[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        yield w.row, doc[new], key[new], len(w.first) - 1


def fit(doc: np.ndarray, word: np.ndarray, grade: np.ndarray, chance: float = CHANCE, rounds: int = 1000, penalty: float = 1e-5) -> Model:
    """The model of documents 0 .. len(grade) - 1 with (doc, word) pairs, by gradient steps of their own size (Adam)."""
    grades = int(grade.max(initial=0))
    if not len(grade) or grade.min() == grade.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    known, at = np.unique(word, return_inverse=True)
    n, toxic = len(grade), grade > 0
    df, hit = np.bincount(at, minlength=len(known)), np.bincount(at, toxic[doc], len(known))
    share = toxic.mean()
    expected = df * share
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    good = np.flatnonzero((df >= 4) & (chi > chance))
    number = np.full(len(known), -1)
    number[good] = np.arange(len(good))
    keep = number[at] >= 0
    rows, columns = doc[keep], number[at[keep]]
    weight, bounds = np.zeros(len(good)), np.log(np.array([(grade <= k).mean() for k in range(grades)]).clip(1e-4, 1 - 1e-4))
    bounds = np.sort(bounds - np.log1p(-np.exp(bounds)))
    above = grade[:, None] > np.arange(grades)[None, :]
    first, second = np.zeros(len(weight) + grades), np.zeros(len(weight) + grades)
    for t in range(1, rounds + 1):
        margin = np.bincount(rows, weight[columns], n)
        p = 1 / (1 + np.exp(bounds[None, :] - margin[:, None]))
        gap = (p - above) / n
        slope = np.concatenate([np.bincount(columns, gap.sum(axis=1)[rows], len(weight)) + penalty * weight, -gap.sum(axis=0)])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        weight, bounds = weight - step[: len(weight)], np.maximum.accumulate(bounds - step[len(weight) :])
    return Model(known[good], weight, bounds)


def train(documents: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and grades (doc_id, grade from 0)."""
    rows = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    some = rows.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, key, n in _word_sets(batch.column(2)):
                cuts = np.searchsorted(doc, np.arange(n + 1))
                raw = [key[cuts[k] : cuts[k + 1]].tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, n) for k in (0, 1)), pa.array(raw, pa.binary())], ["doc_id", "grade", "words"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    picked = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.col("grade").cast("int").alias("grade"), "text")
    found = picked.mapInArrow(run, f"doc_id {kind}, grade int, words binary")
    held = [(r["grade"], np.frombuffer(bytes(r["words"]), np.uint64)) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "words").toLocalIterator()]
    grade = np.array([g for g, _ in held], np.int64)
    doc = np.repeat(np.arange(len(held)), [len(w) for _, w in held])
    return fit(doc, np.concatenate([np.zeros(0, np.uint64), *(w for _, w in held)]), grade)


def score(documents: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """doc_id, severity (expected grade), toxic (the chance of the highest grade is limit or more) for each row."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            margin = np.zeros(batch.num_rows)
            for row, doc, key, n in _word_sets(batch.column(1)) if len(model.words) else ():
                at = np.minimum(np.searchsorted(model.words, key), len(model.words) - 1)
                hit = model.words[at] == key
                margin[row : row + n] = np.bincount(doc[hit], model.weight[at[hit]], n)
            highest = 1 / (1 + np.exp(model.bounds[-1] - margin)) if len(model.bounds) else np.zeros(len(margin))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.severity(margin)), pa.array(highest >= limit)], ["doc_id", "severity", "toxic"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, toxic boolean")


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades from labels: 0 fine, 1 of low quality but not toxic, 2 toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("toxic").isNotNull(), 1 - F.coalesce("quality", F.lit(1))).alias("grade"))
