"""Language-model scores: an interpolated modified Kneser-Ney bigram model over whole words.

Counting: word counts of all training texts are summed in Spark, and so are the counts of all bigrams.  Nothing is
pruned, whatever the size of the input: words and bigrams that occur once are in the model.

Model: P(w | u) = (c(u w) - D(c)) / c(u) + back(u) P(w), where back(u) is the mass that the discounts of u's bigrams
leave, and P(w) = (before(w) - D'(before)) / bigrams + left / (words + 1), with before(w) the number of distinct words
before w.  D and D' come from the counts of counts.  One more word stands for all that are unseen.

Storage: words, bigrams and their counts lie in the shared folder in sorted arrays, dealt by ranges of their hashes
to files of bounded size whose number grows with the input.  Workers map the files and look up the sorted hashes
of a chunk file by file.  A bigram's hash is a bijection of the numbers of its two words.

Defined results: null text is empty and holds its end token only; an empty training set gives every token the base
probability; repeated rows give a result each; a null id is in the training set.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import STRIDE, Files, part_column, small
from changeloom.llm.frames import cut, shared_path
from changeloom.llm.words import GRAPHIC, LOWER, Words, mix, unmix, words

HELD = 3_000_000
WORDS_IN_FILE, TOKENS_IN_FILE = 1 << 20, 1 << 22  # on average; files of bigrams are dealt by the number of tokens
END, FIRST, UNSEEN = 0, 1, 2  # places after the last file: the end of a text, the context before a text, an unseen word


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(key)).astype(np.int64)


def _count(texts: DataFrame, make: Callable[[], Callable[[Words], np.ndarray]]) -> DataFrame:
    """key, n as each task has them; make() gives the task's function from a chunk of words to the keys to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, held = make(), []

        def sent() -> pa.RecordBatch:
            key, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        for batch in batches:
            for w in words(batch.column(0), GRAPHIC, LOWER):
                held.append(np.unique(keys_of(w), return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held[:] = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield sent()
                        held.clear()
        if held:
            yield sent()

    return texts.mapInArrow(run, "key long, n long")


def word_counts(texts: DataFrame) -> DataFrame:
    """key (word hash), n over all texts, as a table in the shared folder."""
    return cut(_count(texts, lambda: lambda w: w.hash.view(np.int64)).groupBy("key").agg(F.sum("n").alias("n")))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """part, sorted keys and sums of n of the rows of a task."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in batches:
        part, key, n = (b.column(k).to_numpy() for k in range(3))
        for k in np.unique(part).tolist():
            held.setdefault(k, []).append((key[part == k].view(np.uint64), n[part == k]))
    for k in sorted(held):
        key, at = np.unique(np.concatenate([x for x, _ in held[k]]), return_inverse=True)
        yield k, key, np.bincount(at, np.concatenate([n for _, n in held.pop(k)])).astype(np.int64)


def _tokens(w: Words, at: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of each token, as places in the chunk's kinds of words with END and FIRST after them; offsets by document."""
    offsets = w.first + np.arange(len(w.first))
    token = np.full(offsets[-1], kinds + END, np.int64)
    token[np.arange(len(at)) + w.doc] = at
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1]
    before[offsets[:-1]] = kinds + FIRST
    return before, token, offsets


def _pairs(number: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(number[before].astype(np.uint64) << np.uint64(32) | number[token].astype(np.uint64))


@dataclass
class Model:
    """Where the arrays are, and the numbers that are needed beside them."""

    folder: str
    word_parts: int
    pair_parts: int
    tokens: int
    types: int
    texts: int
    discount: np.ndarray  # of bigrams by count
    lower: np.ndarray  # of the numbers of distinct words before a word
    bigrams: int  # distinct ones
    left: float  # mass for the uniform distribution
    ends: np.ndarray  # of END and FIRST: once, twice, more, before


def _discounts(n: dict[int, int]) -> np.ndarray:
    """D of counts 0, 1, 2 and 3 or more from the numbers of bigrams that occur 1 to 4 times."""
    if not all(n.get(k, 0) for k in (1, 2, 3, 4)):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))])


def _few(n: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


_STATS = ("once", "twice", "more", "before")  # of a word: bigrams after it by count, and distinct words before it


def train(documents: DataFrame, counts: DataFrame, files: Callable[[int], int] = lambda tokens: -(-tokens // TOKENS_IN_FILE)) -> Model:
    """The model of documents, whose word_counts are counts; its arrays lie in the shared folder."""
    spark = documents.sparkSession
    ends = documents.count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, types = row["n"] + ends, row["v"] + (1 if ends else 0)
    word_parts, pair_parts = max(1, -(-row["v"] // WORDS_IN_FILE)), max(1, files(total))
    last = word_parts * STRIDE
    if last + STRIDE > 1 << 32:
        raise ValueError("too many distinct words for numbers of 32 bits")
    folder = shared_path(spark, f"loom-lm-{uuid.uuid4().hex}")

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Files(folder)
        for k, key, n in _by_part(batches):
            if len(key) > STRIDE:
                raise ValueError("too many words in a file")
            out.save("words", k, key)
            out.save("count", k, small(n))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(key)])], ["part", "n"])

    dealt = counts.select(part_column("key", word_parts).alias("part"), "key", "n").repartitionById(word_parts, F.col("part"))
    dealt.mapInArrow(store_words, "part long, n long").collect()

    def keys_of() -> Callable[[Words], np.ndarray]:
        found = Files(folder)

        def keys(w: Words) -> np.ndarray:
            kinds, at = np.unique(w.hash, return_inverse=True)
            number = np.append(found.find("words", word_parts, kinds, ())[0], [last + END, last + FIRST])
            before, token, _ = _tokens(w, at, len(kinds))
            return _pairs(number, before, token).view(np.int64)

        return keys

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Files(folder)
        for k, key, n in _by_part(batches):
            out.save("pairs", k, key)
            out.save("times", k, small(n))
            out.save("few", k, _few(n))
            pair = unmix(key)
            context, word = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del pair, key
            number, at = np.unique(np.concatenate([context, word]), return_inverse=True)
            first, second = at[: len(n)], at[len(n) :]
            sums = [np.bincount(first, x, len(number)).astype(np.int64) for x in (n == 1, n == 2, n > 2)] + [np.bincount(second, minlength=len(number))]
            yield pa.RecordBatch.from_arrays([pa.array(number // STRIDE, pa.int32()), pa.array(number % STRIDE, pa.int32()), *(pa.array(x, pa.int32()) for x in sums)], ["part", "place", *_STATS])

    def store_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Files(folder), {}
        for b in batches:
            part, place, *sums = (c.to_numpy() for c in b.columns)
            for k in np.unique(part).tolist():
                own = part == k
                if k not in held:
                    held[k] = np.zeros((4, len(out("words", k)) if k < word_parts else 2), np.int64)
                for x, n in zip(held[k], sums, strict=True):
                    np.add.at(x, place[own], n[own])
        for k, stats in held.items():
            for kind, x in zip(_STATS, stats, strict=True):
                out.save(kind, k, small(x))
            out.save("few-before", k, _few(stats[3]))
            out.save("all-before", k, np.array([stats[3].sum(), np.count_nonzero(stats[3] > 2)]))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([stats.shape[1]])], ["part", "n"])

    sent = _count(documents.select("text"), keys_of).select(part_column("key", pair_parts).alias("part"), "key", "n").repartitionById(pair_parts, F.col("part"))
    partial = sent.mapInArrow(store_pairs, "part int, place int, " + ", ".join(f"{x} int" for x in _STATS))
    summed = partial.groupBy("part", "place").agg(*(F.sum(x).alias(x) for x in _STATS))  # one row a word, however many files have it
    summed.repartitionById(word_parts + 1, F.col("part")).mapInArrow(store_stats, "part long, n long").collect()
    made = Files(folder)

    def over(kind: str, parts: int, n: int) -> np.ndarray:
        return np.sum([np.zeros(n, np.int64), *(x for k in range(parts) if len(x := made(kind, k)))], axis=0)

    few, few_before, (pairs, many) = over("few", pair_parts, 4), over("few-before", word_parts + 1, 4), over("all-before", word_parts + 1, 2)
    discount, lower = (_discounts(dict(enumerate(x.tolist(), 1))) for x in (few, few_before))
    left = float(lower[1] * few_before[0] + lower[2] * few_before[1] + lower[3] * many) / max(pairs, 1)
    stats = np.array([made(kind, word_parts) if ends else np.zeros(2) for kind in _STATS]).T
    return Model(folder, word_parts, pair_parts, int(total), int(types), int(ends), discount, lower, int(pairs), left, stats)


def score(documents: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of documents; the model's files hold the counts."""
    m, last = model, model.word_parts * STRIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Files(m.folder)
        for batch in batches:
            for w in words(batch.column(1), GRAPHIC, LOWER):
                n = len(w.first) - 1
                if not n:
                    continue
                kinds, at = np.unique(w.hash, return_inverse=True)
                number, count, *stats = found.find("words", m.word_parts, kinds, ("count", *_STATS))
                number = np.append(np.where(number < 0, last + UNSEEN, number), [last + END, last + FIRST])
                count = np.append(count, [m.texts, m.texts])
                once, twice, more, before = (np.append(x, y) for x, y in zip(stats, m.ends.T, strict=True))
                base = np.log10((count + 1) / (m.tokens + m.types + 1))
                back = np.where(count > 0, (m.discount[1] * once + m.discount[2] * twice + m.discount[3] * more) / np.maximum(count, 1), 1)
                below = (before - m.lower[np.minimum(before, 3).astype(np.int64)]) / max(m.bigrams, 1) + m.left / (m.types + 1)
                context, token, offsets = _tokens(w, at, len(kinds))
                if m.tokens:
                    key, place = np.unique(_pairs(number, context, token), return_inverse=True)
                    times = found.find("pairs", m.pair_parts, key, ("times",))[1][place]
                    full = np.log10((times - m.discount[np.minimum(times, 3)]) / np.maximum(count[context], 1) + back[context] * below[token])
                else:
                    full = base[token]
                known, base, full = (np.add.reduceat(x, offsets[:-1]) for x in ((count > 0)[token].astype(np.int64), base[token], full))
                tokens = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, n), *map(pa.array, (tokens, known, np.full(n, m.tokens), base, full, 10 ** (-full / tokens)))], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
