"""Substring deduplication by seed and extend over winnowed anchors.

1. Seeds: every run of `span` words is winnowed, so its anchor is the k-gram of least hash in it.
   Equal runs have equal anchors, so only runs whose anchor occurs in two documents can repeat.
   Documents are joined on anchors to find those.
2. Pairs: runs around a shared anchor meet by 96 bits of hash, and each is tied to the smallest document
   that has it, at the place it has there.  Runs of a pair of documents on one diagonal are
   one stretch, so a copy is one row however long it is.
3. Extension: the other document's words of each stretch are fetched, once for all documents that ask
   for it, and compared with the document's own words: a run that is equal word by word is a seed, it is
   extended while the words agree, and the maximal repeats of at least `span` words are kept.  No word is removed on a
   hash alone.  A repeat would be missed only if its 96 bits were also those of another run.

Tasks combine before the shuffle: an anchor or run that several documents of a task share is
settled there but for its smallest document, so no key has more rows than there are
batches of tasks, whatever share of the documents holds a passage, and no list of a passage's documents exists.
Keys are sorted within partitions and read as a stream, so a worker holds one batch of rows.
Every step ends as a table, and its shuffles are deleted before the next begins; runs are shuffled in
slices of their keys.  Texts are shuffled at every size, as a broadcast of what they are joined with has no bound.

Defined results: null text has no words; a row without an id keeps all its words and owns none; rows
that share an id never remove each other's words; repeats within a document stay;
documents shorter than `span` words have no run; of equal runs the smallest id keeps its words.  Ids are integers.  Extra
columns are ignored, whatever their names.  A very long text is one row, and its words are compared in time
in proportion to it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.frames import cut, drop
from changeloom.llm.words import GRAPHIC, SAME, Words, mix, ngrams, words

SPAN = 13
ANCHOR = 5
HELD = 800_000
SLICES = 2  # of the runs' keys, shuffled one after the other
_SALT = np.uint64(0xA0761D6478BD642F)
SINGLE, SEVERAL, SETTLED = 0, 1, 2


def runs(w: Words, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Start, document, hash and anchor hash of every run of span words of a chunk."""
    found, inside = ngrams(w.hash, span, w.first)
    if not len(found):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), found, found)
    grams, _ = ngrams(w.hash, anchor, w.first)
    least = grams[: len(found)].copy()
    for k in range(1, span - anchor + 1):
        np.minimum(least, grams[k : k + len(found)], out=least)
    start = np.flatnonzero(inside)
    return start, w.doc[start], found[start], least[start]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _spread(doc: np.ndarray) -> np.ndarray:
    return 1 + (mix(doc.astype(np.uint64)) & np.uint64(1023)).astype(np.int64)


def _sent_anchors(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """For each anchor its smallest document (several: not the only one), and for shared ones all documents as settled rows."""
    key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = _heads(key, doc)
    key, doc = key[new], doc[new]
    head = _heads(key)
    many = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1 if len(key) else head
    kind = np.concatenate([np.where(many[head], SEVERAL, SINGLE), np.full(int(many.sum()), SETTLED)])
    key, doc = np.concatenate([key[head], key[many]]), np.concatenate([doc[head], doc[many]])
    salt = np.where(kind == SETTLED, _spread(doc), 0)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(kind.astype(np.int8)), pa.array(salt.astype(np.int16))], ["key", "doc_id", "kind", "salt"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key of the rows (key, doc_id, kind), sorted by key, whose key has another row or is known to have one."""

    def out(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key)], ["doc_id", "key"])

    last = None  # the row before, which waits for the next one's key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, kind = _arrays(batch)
        fine = kind != SINGLE
        if last is not None:
            key, doc, fine = (np.append(a, b) for a, b in zip(last, (key, doc, fine), strict=True))
        same = key[1:] == key[:-1]
        fine[1:] |= same
        fine[:-1] |= same
        last = key[-1:], doc[-1:], fine[-1:]
        yield out(doc[:-1][fine[:-1]], key[:-1][fine[:-1]])
    if last is not None:
        yield out(last[1][last[2]], last[0][last[2]])


def _sent_runs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Runs once for each document: the smallest document's without an owner, the others' with that one as owner."""
    key, check, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((pos, doc, check, key))
    key, check, doc, pos = key[order], check[order], doc[order], pos[order]
    new = _heads(key, check, doc)
    key, check, doc, pos = key[new], check[new], doc[new], pos[new]
    head = _heads(key, check)
    at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int32)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(doc[at], mask=head), pa.array(pos[at].astype(np.int32), mask=head)], _RUN)


_RUN = ["key", "check", "doc_id", "pos", "owner", "opos"]


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, pos, owner, opos of the rows (key, check, doc_id, pos), in this order, but for each key's first document."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _arrays(batch)
        if last is not None:
            columns = [np.append(a, b) for a, b in zip(last, columns, strict=True)]
        key, check, doc, pos = columns
        head = _heads(key, check)
        at = np.flatnonzero(head)[np.cumsum(head) - 1]
        out = doc > doc[at]
        if last is not None:
            out[0] = False
        last = [x[at[-1] : at[-1] + 1] for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[out], pos[out], doc[at][out], pos[at][out])], _RUN[2:])


def _among(doc: np.ndarray, key: np.ndarray, lists: pa.Array, row: int, n: int) -> np.ndarray:
    """Whether each key is in its document's list."""
    part = lists.slice(row, n)
    sizes = np.array(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    own = np.repeat(np.arange(n), sizes).astype(np.uint64)
    held = mix(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + own * _SALT)
    return np.isin(mix(key + doc.astype(np.uint64) * _SALT), held)


def repeats(own: list[bytes], others: list[list[bytes]], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) of own of at least span words that occur in one of others, in order; they may overlap."""
    seeds: dict[tuple[bytes, ...], tuple[list[bytes], int]] = {}
    for other in others:
        for j in range(len(other) - span + 1):
            seeds.setdefault(tuple(other[j : j + span]), (other, j))
    out, i = [], 0
    while i + span <= len(own):
        seed = seeds.get(tuple(own[i : i + span]))
        if seed is None:
            i += 1
            continue
        other, j = seed
        # to the left it can't go on: the run before is no seed, or within the stretch before
        stop, end = i + span, j + span
        while stop < len(own) and end < len(other) and own[stop] == other[end]:
            stop, end = stop + 1, end + 1
        out.append((i, stop))
        i = stop - span + 1
    return out


def _anchors(rows: DataFrame, span: int, anchor: int) -> DataFrame:
    """doc_id, anchors: of each document the anchors that another document has."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1), GRAPHIC, SAME):
                _, doc, _, least = runs(w, span, anchor)
                keep = _heads(doc, least)
                held.append((least[keep], ids[w.row + doc[keep]].astype(np.int64)))
                size += int(keep.sum())
                if size > HELD:
                    yield _sent_anchors(held)
                    held, size = [], 0
        if held:
            yield _sent_anchors(held)

    sent = rows.mapInArrow(seeds, "key long, doc_id long, kind byte, salt short").repartition("key", "salt").sortWithinPartitions("key").select("key", "doc_id", "kind")
    return cut(sent.mapInArrow(_shared, "doc_id long, key long").groupBy("doc_id").agg(F.collect_set("key").alias("anchors")))


def _stretches(rows: DataFrame, span: int, anchor: int, bits: int) -> DataFrame:
    """doc_id, owner, low, high: stretches of an owner's words that runs of the document are among."""
    anchors = _anchors(rows, span, anchor)
    mask = np.uint64((1 << bits) - 1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1), GRAPHIC, SAME):
                start, doc, whole, least = runs(w, span, anchor)
                fine = _among(doc, least, batch.column(2), w.row, len(w.first) - 1)
                start, doc = start[fine], doc[fine]
                check = (ngrams(w.hash ^ _SALT, span, w.first)[0][start] & mask).astype(np.uint32)
                held.append((whole[fine] & mask, check, ids[w.row + doc].astype(np.int64), start - w.first[doc]))
                size += len(start)
                if size > HELD:
                    yield _sent_runs(held)
                    held, size = [], 0
        if held:
            yield _sent_runs(held)

    found = cut(rows.join(anchors.hint("merge"), "doc_id").select("doc_id", "text", "anchors").mapInArrow(near, "key long, check int, doc_id long, pos int, owner long, opos int"))
    drop(anchors)
    tied, parts = found.where("owner IS NOT NULL").select(*_RUN[2:]), []
    for k in range(SLICES):  # each slice's shuffle is deleted before the next; a key is in one slice
        alone = found.where(f"owner IS NULL AND pmod(key, {SLICES}) = {k}").select(*_RUN[:4]).repartition("key").sortWithinPartitions(*_RUN[:4])
        owned = alone.mapInArrow(_owned, "doc_id long, pos int, owner long, opos int")
        owned = owned.unionByName(tied) if k == 0 else owned
        parts.append(cut(owned.groupBy("doc_id", "owner", (F.col("pos") - F.col("opos")).alias("diagonal")).agg(F.min("opos").alias("low"), F.max("opos").alias("high"))))
    drop(found)
    every = functools.reduce(DataFrame.unionByName, parts)
    out = cut(every.groupBy("doc_id", "owner", "diagonal").agg(F.min("low").alias("low"), (F.max("high") + span).alias("high")).drop("diagonal").distinct())
    for part in parts:
        drop(part)
    return out


def _evidence(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """owner, low, high, words of every stretch that is asked for: words in UTF-8, joined by a space."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].as_py().encode().split()
                for one in batch.column(2)[k].as_py():
                    for x, v in zip(out, (batch.column(0)[k].as_py(), one["low"], one["high"], b" ".join(own[one["low"] : one["high"]])), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["owner", "low", "high", "words"])

    asked = stretches.groupBy("owner").agg(F.collect_set(F.struct("low", "high")).alias("asked"))
    return cut(rows.join(asked.hint("merge"), F.col("doc_id") == F.col("owner")).select("doc_id", "text", "asked").mapInArrow(fetch, "owner long, low int, high int, words binary"))


def remove(documents: DataFrame, span: int = SPAN, anchor: int = ANCHOR, texts: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with texts the kept words as text) for each row of documents.

    bits: how many bits of each of the two hashes of a run are used (fewer in tests).
    """
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = every.where("doc_id IS NOT NULL AND text IS NOT NULL")
    stretches = _stretches(rows, span, anchor, bits)
    evidence = _evidence(rows, stretches)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sha, kept = [], [], [], []
            for k in range(batch.num_rows):
                own = stay = (batch.column(1)[k].as_py() or "").encode().split()
                if batch.column(2)[k].is_valid:
                    stay, at = [], 0
                    for low, high in repeats(own, [x.split(b" ") for x in batch.column(2)[k].as_py()], span):
                        stay += own[at:low]
                        at = high
                    stay += own[at:]
                raw = b" ".join(stay)
                total.append(len(own))
                removed.append(len(own) - len(stay))
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    others = stretches.hint("merge").join(evidence, ["owner", "low", "high"]).groupBy("doc_id").agg(F.collect_set("words").alias("others"))
    out = every.join(others.hint("merge"), "doc_id", "left").select("doc_id", "text", "others").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
