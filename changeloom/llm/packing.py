"""Packing of tokenised documents into sequences of a fixed size.

One pass tokenises: every document becomes full pieces of the window and one piece with
what is left, each with its checksum; only these rows are written.  The histogram of piece
lengths (at most one count for each length of the window) goes to the driver, where
combinations of up to three lengths that fill a window are enumerated, their repeat
counts solved by non-negative least squares against the histogram and rounded down, and
what is left over is packed greedily, largest piece first with the best fit.  The plan is
a table of runs (length, first rank, last rank, sequence, offset) whose size depends on the window
alone.  Each piece gets its rank among pieces of its length from counts for each part of
the written table and a count within the part, so no length is gathered in a task.

Words are tokenised once for each worker and remembered, as no token of this vocabulary spans two words;
the memory holds REMEMBERED words and is emptied when full, which changes no result.

Defined results: null text is empty, so its document is the closing token alone; repeated rows
are packed as often as they occur; an empty table has no piece; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.frames import cut
from changeloom.llm.words import ragged

WINDOW = 4096
CLOSE = 2
REMEMBERED = 600_000


#: How the vocabulary's file splits lower-case text into words, written for texts of the plain alphabet below.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \t\n\r\v\fa-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Anything but printable ASCII, white space and composed Latin letters; and what may be a special token.
_OTHER = re.compile("[^ -~\t\n\r\v\f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]|<\\|")


class WordEncoder:
    """Token ids of texts; each word of the plain alphabet is encoded once, other texts are encoded whole.

    New words are encoded together: a word's ids end with the one that closes a word, which tells
    them apart.  Where that fails, each word is encoded alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        ends = [self.ends]
        for at in range(0, len(fresh), 500):
            some = fresh[at : at + 500]
            (ids,) = self._encoded([" ".join(some)])
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                parts = self._encoded(some)
                ids, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
            first = int(ends[-1][-1])
            if first + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
            self.ids[first : first + len(ids)] = ids
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            ends.append(first + stops)
        self.ends = np.concatenate(ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [not _OTHER.search(t) for t in texts]
        split = [_SPLIT.findall(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        found = list(chain.from_iterable(split))
        index = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        missing = np.flatnonzero(index < 0).tolist()
        fresh = dict.fromkeys(found[k] for k in missing)
        if len(self.number) + len(fresh) > REMEMBERED:
            self.forget()
            fresh, missing = dict.fromkeys(found), range(len(found))
        if fresh:
            self._learn(list(fresh))
            index[missing] = np.fromiter((self.number[found[k]] for k in missing), np.int64, len(missing))
        begins = self.ends[index]
        lengths = self.ends[index + 1] - begins
        ids = self.ids[ragged(begins, lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] if p else self._encoded([t])[0] for t, p, a, b in zip(texts, plain, total[:-1], total[1:], strict=True)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """A worker's encoder, which later tasks of the worker use with the words that it remembers."""
    return WordEncoder(path)


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, close: int = CLOSE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        last = np.array([close], "<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            k = 0
            while k < len(ids):
                some, size = [], 0
                while k + len(some) < len(ids) and size < 1 << 20:
                    some.append(texts[k + len(some)].as_py() or "")
                    size += len(some[-1])
                out = []
                for j, tokens in enumerate(encoder.encode(some)):
                    own = np.concatenate([tokens.astype("<u4", copy=False), last])
                    out += [(ids[k + j], s, len(x := own[s : s + window]), zlib.crc32(x), len(own)) for s in range(0, len(own), window)]
                k += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [batch.schema.field(0).type, *[pa.int64()] * 4], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(lengths: np.ndarray, window: int, anchors: int = 48) -> list[tuple[int, ...]]:
    """Combinations of one to three of the lengths that fill a window: all pairs, and triples around evenly spread anchors."""
    there = set(lengths.tolist())
    found = {(window,)} if window in there else set()
    found |= {(window - x, x) for x in there if 2 * x <= window and window - x in there}
    some = sorted(there)[:: max(1, len(there) // anchors)]
    found |= {tuple(sorted((a, x, window - a - x), reverse=True)) for a in some for x in there if x <= window - a - x and window - a - x in there}
    return sorted(found)


def repeats(shapes: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that minimise the squares of A x - histogram, A the lengths in each shape.

    Projected gradient steps with momentum; A has at most three entries a column, so a
    step is linear in the number of shapes.
    """
    rows = np.array([x for shape in shapes for x in shape], np.int64)
    columns = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    target = histogram.astype(float)
    degree = np.bincount(rows, minlength=len(target))
    step = 1 / max(1.0, 3.0 * degree.max())
    x = np.zeros(len(shapes))
    y, momentum = x, 1.0
    for _ in range(rounds):
        gap = np.bincount(rows, y[columns], len(target)) - target
        new = np.maximum(0, y - step * np.bincount(columns, gap[rows], len(shapes)))
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        x, y, momentum = new, new + (momentum - 1) / after * (new - x), after
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that use each length as often as the histogram says."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def use(shape: tuple[int, ...], times: int) -> None:
        if times > 0:
            made.append((shape, times))
            for x in shape:
                left[x] -= times

    shapes = combinations(np.flatnonzero(left), window)
    if shapes:
        solved = repeats(shapes, left)
        for k in np.argsort(-solved, kind="stable"):
            need = defaultdict(int)
            for x in shapes[k]:
                need[x] += 1
            use(shapes[k], min(int(solved[k]), *(int(left[x]) // n for x, n in need.items())))
    while left.any():  # greedy: the largest piece, then again and again the largest that fits
        lengths = np.flatnonzero(left)
        shape, room, need = [], window, defaultdict(int)
        while room:
            fit = lengths[: np.searchsorted(lengths, room, "right")]
            fit = [x for x in fit[::-1][:64] if need[x] < left[x]] or [x for x in fit[::-1] if need[x] < left[x]]
            if not fit:
                break
            shape.append(int(fit[0]))
            need[fit[0]] += 1
            room -= int(fit[0])
        use(tuple(shape), min(int(left[x]) // n for x, n in need.items() if n))
    return made


def runs(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: first rank, sequence of that rank, offset in the sequence."""
    used, first, out = defaultdict(int), 0, defaultdict(list)
    for shape, times in made:
        offset = 0
        for x in shape:
            out[x].append((used[x], first, offset))
            used[x] += times
            offset += x
        first += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, close: int = CLOSE) -> DataFrame:
    """pieces() with the sequence_id and the offset of each."""
    written = cut(pieces(documents, tokenizer_path, window, close).withColumn("part", F.spark_partition_id()))
    counts = cut(written.groupBy("length", "part").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most window rows
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(runs(plan(histogram, window)))
    before = counts.select("length", "part", (F.expr("sum(count) OVER (PARTITION BY length ORDER BY part)") - F.col("count")).alias("before"))
    local = F.expr("row_number() OVER (PARTITION BY length, part ORDER BY doc_id, start, ids_crc32)") - 1
    ranked = written.join(before, ["length", "part"]).withColumn("rank", F.col("before") + local)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, begin = np.unique(length[order], return_index=True)
            for kind, rows in zip(kinds.tolist(), np.split(order, begin[1:]), strict=True):
                run = table.value[kind]
                k = np.searchsorted(run[:, 0], rank[rows], "right") - 1
                sequence[rows] = run[k, 1] + rank[rows] - run[k, 0]
                offset[rows] = run[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
