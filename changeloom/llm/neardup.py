"""Near-duplicate documents by a Jaccard self-join over word shingles.

1. Word frequencies: words seen twice or more in a task, the most frequent RANKED of them; a
   table of fixed size that only orders shingles, never decides about one.
2. A document is the set of its distinct shingle hashes.  Documents with equal sets (same
   128-bit sum) become one class, so groups of copies cost one member.
3. Shingles are ordered rare first, by the rarest word in each, then by hash.  Two sets
   with Jaccard coefficient t or more share one in their prefixes of n - ceil(t n) + 1.
4. Classes meet on prefix shingles.  Filters: length (t times the larger at most the
   smaller); position (what can follow in both at that place); suffix (a lower bound of
   the symmetric difference from the parities of hashed cells).
5. First every class of a shingle is compared with PIVOTS of them, the same for all shingles of
   a group, which joins most of a group of near copies by stars.  Then classes that still are in different components meet again, each
   pair of them once and only with those of a size class that allows the similarity; pairs that are linked already aren't formed, so a large group
   doesn't cost all its pairs, and no link between components is missed.
6. A pair that passes meets the suffix filter again with cells in proportion to the set; what passes
   is verified once, by the exact size of the intersection.

Defined results: null text, text without words, and rows without an id have an empty set
or no part in linking; fewer words than a shingle are one shingle; rows that share
an id count as one document when linking, and every input row gives one result row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.components import components
from changeloom.llm.frames import cut, drop, forget_plans, fresh
from changeloom.llm.words import GRAPHIC, LOWER, Words, mix, ngrams, ragged, words

SHINGLE = 5
SIMILARITY = Fraction(8, 10)
RANKED = 1 << 18
PARITY = 8  # 64-bit words of parity cells for the suffix filter
PARITIES = [f"p{k}" for k in range(PARITY)]
CELLS = 4  # parity cells for each member of a set, at least, before sets are compared
PIVOTS = 4  # classes that every class of a shingle is compared with at first


def word_counts(documents: DataFrame, ranked: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words, ranked at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for w in words(batch.column(0), GRAPHIC, LOWER):
                held.append(np.unique(w.hash, return_counts=True))
                if sum(len(k) for k, _ in held) > 600_000:
                    held[:] = [merged()]
        keys, n = merged()
        keep = n >= 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(n[keep])], ["word", "n"])

    counted = cut(documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least, total = 1 << 62, 0  # above all counts
    steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    for r in sorted(steps.collect(), reverse=True):  # a row for each eighth of a power of two
        total += r["words"]
        if total > ranked:
            break
        least = r["least"]
    found = counted.where(F.col("n") >= least).toPandas()
    drop(counted)
    keys, n = found["word"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _sets(w: Words, shingle: int, table: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, rare first in each document (by hash without a table), the rank of each, and offsets."""
    found, inside = ngrams(w.hash, shingle, w.first)
    at = np.flatnonzero(inside)
    doc, key = w.doc[at] if len(at) else np.zeros(0, np.int64), found[at]
    rank = np.zeros(len(key), np.int64)
    if table is not None and len(table[0]) and len(key):
        place = np.minimum(np.searchsorted(table[0], w.hash), len(table[0]) - 1)
        often = np.where(table[0][place] == w.hash, table[1][place], 0)
        low = often[: len(found)].copy()
        for k in range(1, shingle):
            np.minimum(low, often[k : k + len(found)], out=low)
        rank = low[at]
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(shingle - 1):
            more = sizes[short] > k
            whole[more] = whole[more] * np.uint64(0xD1342543DE82EF95) + w.hash[w.first[short[more]] + k]
        doc, key, rank = np.concatenate([doc, short]), np.concatenate([key, mix(whole + sizes[short].astype(np.uint64))]), np.concatenate([rank, np.zeros(len(short), np.int64)])
    order = np.lexsort((key, rank, doc))
    doc, key, rank = doc[order], key[order], rank[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], rank[new], np.searchsorted(doc[new], np.arange(len(sizes) + 1))


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _parity(key: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """64-bit words for each set: bit c of all of them is the parity of the members in cell c."""
    cell = mix(key) >> np.uint64(55)
    out = []
    for part in range(PARITY):
        bits = np.where((cell >> np.uint64(6)) == part, np.uint64(1) << (cell & np.uint64(63)), np.uint64(0))
        total = np.zeros(len(key) + 1, np.uint64)
        np.bitwise_xor.accumulate(bits, out=total[1:])
        out.append(total[offsets[1:]] ^ total[offsets[:-1]])
    return out


def _signatures(documents: DataFrame, shingle: int, t: Fraction, table) -> DataFrame:
    """doc_id, n, the set's sums a and b, parities, and the hashes of the prefix, rare first."""
    held = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), GRAPHIC, LOWER):
                key, _, offsets = _sets(w, shingle, held.value)
                n = np.diff(offsets)
                prefix = np.where(n > 0, n - -(-n * t.numerator // t.denominator) + 1, 0)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(prefix)])), pa.array(key[ragged(offsets[:-1], prefix)].astype(np.int64)))
                longs = [pa.array(x.astype(np.int64)) for x in (n, _sum(mix(key), offsets), _sum(mix(key ^ np.uint64(0x5555555555555555)), offsets), *_parity(key, offsets))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, len(n)), *longs, lists.cast(pa.list_(pa.int64()))], ["doc_id", "n", "a", "b", *PARITIES, "prefix"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, a long, b long, {', '.join(f'{p} long' for p in PARITIES)}, prefix array<long>")


def _member_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, the parities of CELLS to twice as many cells a member as binary, and the sorted hashes of the set as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), GRAPHIC, LOWER):
                key, _, offsets = _sets(w, shingle, None)
                cell = mix(key)
                raw, bits = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    raw.append(key[a:b].tobytes())
                    size = 1 << max(6, (CELLS * int(b - a) - 1).bit_length())
                    at, n = np.unique(cell[a:b] & np.uint64(size - 1), return_counts=True)
                    odd = np.zeros(size, bool)
                    odd[at[n % 2 == 1]] = True
                    bits.append(np.packbits(odd).tobytes())
                sizes = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.row, len(raw)), sizes, pa.array(bits, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "n", "cells", "members"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cells binary, members binary")


def _differing(a: np.ndarray, b: np.ndarray) -> int:
    """Cells of odd difference of two sets: the difference has as many members at least. The larger table is folded to the smaller."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _allowed(n: int, t: Fraction) -> int:
    """Members in which two similar sets of n members together may differ at most."""
    return n - 2 * -(-t.numerator * n // (t.numerator + t.denominator))


def _by_shuffle(frame: DataFrame) -> DataFrame:
    """The frame as a side of sort-merge joins: one plan at all sizes, whatever the session broadcasts of itself."""
    return frame.hint("merge")


def _chosen(pairs: DataFrame, members: DataFrame, column: str, fine) -> DataFrame:
    """A table of u, v of the pairs for which fine(n, m, left, right) of both documents' columns.

    Each document's column is sent once for v and once for each pair it is u of.  The side of v is a table, so that both sides are dealt
    for the last join alone and Spark can split a v with very many pairs.
    """
    y = cut(members.join(_by_shuffle(pairs.select(F.col("v").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("v"), F.struct("n", column).alias("y")))
    x = members.select(F.col("doc_id").alias("u"), F.struct("n", column).alias("x")).join(_by_shuffle(pairs), "u")
    rows = x.join(_by_shuffle(y), "v").select("u", "v", "x.n", F.col("y.n").alias("m"), F.col(f"x.{column}").alias("left"), F.col(f"y.{column}").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                kept[k] = fine(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_buffer(), batch.column(5)[k].as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(kept))

    kind = rows.schema["u"].dataType.simpleString()
    found = cut(rows.mapInArrow(run, f"u {kind}, v {kind}"))
    drop(y)
    return found


def _possible(pairs: DataFrame, members: DataFrame, t: Fraction) -> DataFrame:
    """u, v of the pairs that many cells don't rule out; the tables are a sixteenth to an eighth of the sets."""

    def fine(n: int, m: int, left: pa.Buffer, right: pa.Buffer) -> bool:
        return _differing(np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)) <= _allowed(n + m, t)

    return _chosen(pairs, members, "cells", fine)


def _verified(pairs: DataFrame, members: DataFrame, t: Fraction) -> DataFrame:
    """u, v of the pairs whose sets reach the similarity."""

    def fine(n: int, m: int, left: pa.Buffer, right: pa.Buffer) -> bool:
        both = n + m - len(np.unique(np.concatenate([np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)])))
        return t.denominator * both >= t.numerator * (n + m - both)

    return _chosen(pairs, members, "members", fine)


def _near(t: Fraction) -> str:
    """Length and position filter for postings x and y; at counts what stands before the shingle."""
    a, b = t.numerator, t.denominator
    return f"{b} * least(x.n, y.n) >= {a} * greatest(x.n, y.n) AND least(x.n - x.at, y.n - y.at) >= ceil({a} * (x.n + y.n) / {a + b}) - least(x.at, y.at)"


def _small_rest(t: Fraction) -> str:
    """Suffix filter for x and y: their parities allow a symmetric difference as small as the similarity needs."""
    need = f"ceil({t.numerator} * (x.n + y.n) / {t.numerator + t.denominator})"
    return " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITIES) + f" <= x.n + y.n - 2 * {need}"


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("x.id", "y.id").alias("u"), F.least("x.id", "y.id").alias("v")).distinct()


def _toward_hubs(pairs: DataFrame) -> DataFrame:
    """The pairs, v the document that is in more of them (of equal ones the smaller id), so that few documents are a v."""
    degree = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    ends = [_by_shuffle(degree.select(F.col("id").alias(end), F.col("d").alias(f"d{end}"))) for end in ("u", "v")]
    both = pairs.join(ends[0], "u").join(ends[1], "v")
    turned = cut(both.select(F.expr("if(du > dv, v, u)").alias("u"), F.expr("if(du > dv, u, v)").alias("v")))
    drop(degree)
    return turned


def _links(pairs: DataFrame, documents: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """u, v of the pairs that are similar; only texts of documents in a pair are read again and turned into sets."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    members = cut(_member_sets(documents.select("doc_id", "text").join(_by_shuffle(ids), "doc_id", "left_semi"), shingle))
    turned = _toward_hubs(pairs)
    possible = _possible(turned, members, t)
    found = _verified(possible, members, t)
    for done in (members, turned, possible):
        drop(done)
    forget_plans(documents.sparkSession)
    return found


def classes(documents: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row of documents."""
    t = Fraction(similarity)
    signed = cut(_signatures(documents, shingle, t, word_counts(documents)))
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    kept = cut(known.groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.min_by(F.struct(*PARITIES, "prefix"), "doc_id").alias("s")))
    signs = kept.select("id", "n", *(f"s.{p}" for p in PARITIES))
    posted = kept.select("id", "n", F.posexplode("s.prefix").alias("at", "shingle"))
    pivots = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("order"), "id", "n", "at")).alias(f"y{k}") for k in range(PIVOTS)]
    many = posted.groupBy("shingle").count().where("count > 1").select("shingle")
    shared = cut(posted.join(many, "shingle", "left_semi"))
    chosen = shared.groupBy("shingle").agg(*pivots).select("shingle", F.array_distinct(F.array(*(f"y{k}" for k in range(PIVOTS)))).alias("pivots"))
    met = shared.join(chosen, "shingle").select(F.struct("id", "n", "at").alias("x"), F.explode("pivots").alias("y")).where("x.id <> y.id").where(_near(t))
    x, y = (signs.select(F.col("id").alias(k), F.struct("id", "n", *PARITIES).alias(s)) for k, s in (("u", "x"), ("v", "y")))
    first = cut(_pairs(_pairs(met).join(x, "u").join(y, "v").where(_small_rest(t))))
    forget_plans(documents.sparkSession)
    links = _links(first, documents, shingle, t)
    near = components(links)
    forget_plans(documents.sparkSession)
    placed = shared.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    width = math.log(1 / t) * (1 + 1e-9) if t < 1 else 1.0  # sizes of similar sets are of one class or of neighbours
    size = F.floor(F.log("n") / width) if t < 1 else F.col("n")
    open_ = cut(placed.join(mixed.select("shingle"), "shingle", "left_semi").join(signs.drop("n"), "id").withColumn("size", size))
    other = open_.withColumn("meets", F.explode(F.array("size", F.col("size") - 1)))
    once = "x.component <> y.component AND (x.size < y.size OR x.component < y.component)"
    rest = open_.alias("x").join(other.alias("y"), F.expr(f"x.shingle = y.shingle AND x.size = y.meets AND {once} AND {_near(t)} AND {_small_rest(t)}"))
    rest = cut(_pairs(rest).join(first, ["u", "v"], "left_anti"))
    for done in (shared, open_, first):
        drop(done)
    forget_plans(documents.sparkSession)
    ends = near if rest.isEmpty() else components(links.unionByName(_links(rest, documents, shingle, t)))
    named = kept.select("n", "a", "b", "id").join(ends, "id", "left").select("n", "a", "b", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    out = cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
    for done in (signed, kept, rest):
        drop(done)
    forget_plans(documents.sparkSession)
    return out


def keep_one(documents: DataFrame, shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """documents, with all columns, without those that link to a smaller id; of repeated ids every row stays or goes together."""
    name = fresh(documents.columns, "gone_id")
    gone = classes(documents, shingle, similarity).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(_by_shuffle(gone), documents["doc_id"] == gone[name], "left_anti")
