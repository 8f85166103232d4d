"""Language identification by interpolated Kneser-Ney character trigram models.

Texts are lower-cased and runs of anything but letters become one space.  Trigram counts of each
language are taken over every training document and summed in Spark; nothing is pruned.  What the
model needs of them (counts of trigrams, for bigrams and single characters the number of distinct characters before
them, and the sums of both over each context) is aggregated in Spark too, per language, and lies in the shared folder
in sorted hash arrays, dealt by ranges of the hashes to files of bounded size whose number grows with the input.
Workers map the files and look up the distinct trigrams of a chunk.  The driver holds a few numbers a language.

P(c | ab) = max(n(abc) - D, 0) / n(ab) + D types(ab) / n(ab) P(c | b), the same below with the numbers of distinct
characters before, and a uniform share at the bottom; D = n1 / (n1 + 2 n2) for each order and language.
A document goes to the language with the lowest cross-entropy per character, the first by name of equal ones.

Rejection is calibrated for each language on every training document that the model gives its own language: the excess of a
document's cross-entropy over its language's mean, times the root of its length up to 400, must
not pass REJECT times the 0.999 quantile of that excess.  Sums and the quantile are exact, whatever the number of documents:
values are ranked by counts of one byte of theirs after the other, so the driver holds 256 numbers for each language and rank.
A language with fewer than 20 such documents takes the limit of all languages together, and its mean from what it has.

Defined results: null text and text without a letter is "und" with score 0 and is rejected; rows with
null text or null language are not learned from; repeated rows count as often as they occur;
without any training row every document is "und"; equal cross-entropies go to the first language by name.
Whole texts are read, however long.  Other columns are kept by keep_known(), whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import Files, part_of, small
from changeloom.llm.frames import cut, drop, shared_path
from changeloom.llm.words import mix

KEYS_IN_FILE = 1 << 20
REJECT = 2.0
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point that is a letter as itself, any other as 0."""
    return np.array([k if chr(k).isalpha() else 0 for k in range(0x110000)], np.int32)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single zeros between them, of all texts; a text starts with a zero, and ends with one if its last character is no letter. Offsets."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\0".join(["", *lowered, ""])
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    border = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[border] = True  # each text begins with a zero of its own
    at = np.cumsum(keep)
    return codes[keep], at[border] - 1


def trigrams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams whose last symbol is in the text, and their offsets by text; a text without letters has none."""
    a = np.concatenate([[0], codes[:-2]]).astype(np.uint64)
    b, c = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    keys = (a << np.uint64(2 * _BITS)) | (b << np.uint64(_BITS)) | c
    inside = np.ones(len(keys), bool)
    inside[offsets[1:] - 1] = False  # those that end with the zero that begins the next text
    keys[offsets[:-1]] &= np.uint64((1 << (2 * _BITS)) - 1)
    return keys[inside], offsets - np.arange(len(offsets))


def _by_size(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    row = 0
    while row < len(texts):
        some, size = [], 0
        while row + len(some) < len(texts) and size < limit:
            some.append(texts[row + len(some)].as_py())
            size += len(some[-1] or "")
        yield row, some
        row += len(some)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


_LOW = [np.uint64((1 << _BITS * k) - 1) for k in range(4)]


@dataclass
class Model:
    """Where the arrays are, and a few numbers for each language.

    Array n<order>.<language> has the counts of n-grams, array t<order>.<language> the sums over the contexts of this order's n-grams.
    """

    folder: str
    parts: int
    languages: list[str]
    discount: np.ndarray  # languages x orders 1 to 3
    total: np.ndarray  # bigrams of each language
    types: np.ndarray  # characters of each language
    size: int  # characters of all languages
    mean: np.ndarray
    limit: np.ndarray

    @cached_property
    def files(self) -> Files:
        return Files(self.folder)

    def _found(self, kind: str, grams: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
        """Values at distinct n-grams, each 0 where the kind has none."""
        hashes = mix(grams)
        order = np.argsort(hashes)
        out = [np.empty(len(grams)) for _ in values]
        got = self.files.find(kind, self.parts, hashes[order], tuple(f"{kind}.{v}" for v in values))[1:]
        for x, y in zip(out, got, strict=True):
            x[order] = y
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities (n-grams x languages) of the last symbol of distinct trigrams."""
        out = np.empty((len(grams), len(self.languages)))
        one, at_one = np.unique(grams & _LOW[1], return_inverse=True)
        two, at_two = np.unique(grams & _LOW[2], return_inverse=True)
        in_two, at_in_two = np.unique(two >> np.uint64(_BITS), return_inverse=True)
        in_three, at_in_three = np.unique(grams >> np.uint64(_BITS), return_inverse=True)
        one_of_two = np.searchsorted(one, two & _LOW[1])
        for j in range(len(self.languages)):
            cut = self.discount[j]
            (n,) = self._found(f"n1.{j}", one, ("n",))
            p = np.maximum((np.maximum(n - cut[0], 0) + cut[0] * self.types[j] / (self.size + 1)) / max(self.total[j], 1), 1e-9)[one_of_two]
            for order, grams_of, contexts, at in ((2, two, in_two, at_in_two), (3, grams, in_three, at_in_three)):
                (n,) = self._found(f"n{order}.{j}", grams_of, ("n",))
                total, types = (x[at] for x in self._found(f"t{order}.{j}", contexts, ("n", "types")))
                lower = p if order == 2 else p[at_two]
                p = np.where(total > 0, (np.maximum(n - cut[order - 1], 0) + cut[order - 1] * types * lower) / np.maximum(total, 1), lower)
            out[:, j] = np.log(np.maximum(p, 1e-12))
        return out

    def entropies(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Cross-entropy per symbol (documents x languages); zero for no symbol."""
        known, where = np.unique(grams, return_inverse=True) if len(grams) < 1 << 14 else self._direct(grams)
        table = self.rows(known)
        lengths = np.diff(offsets)
        full = np.flatnonzero(lengths)
        out = np.zeros((len(lengths), len(self.languages)))
        if len(full):
            for k in range(len(self.languages)):
                out[full, k] = -np.add.reduceat(table[:, k][where], offsets[full]) / lengths[full]
        return out

    def _direct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and where each is: by a dense table over the alphabet of the chunk where that is small."""
        mask = np.uint64((1 << _BITS) - 1)
        parts = [(grams >> np.uint64(_BITS * k)) & mask for k in (2, 1, 0)]
        seen = np.zeros(0x110000, bool)
        for p in parts:
            seen[p] = True
        letters = np.flatnonzero(seen).astype(np.uint64)
        n = len(letters)
        if n > 160:
            return np.unique(grams, return_inverse=True)
        number = np.zeros(0x110000, np.int32)
        number[letters] = np.arange(n)
        dense = (number[parts[0]] * n + number[parts[1]]) * n + number[parts[2]]
        there = np.zeros(n**3, bool)
        there[dense] = True
        found = np.flatnonzero(there).astype(np.uint64)
        place = np.zeros(n**3, np.int32)
        place[found] = np.arange(len(found))
        m = np.uint64(n)
        known = (letters[found // (m * m)] << np.uint64(2 * _BITS)) | (letters[found // m % m] << np.uint64(_BITS)) | letters[found % m]
        return known, place[dense]


def _counts(documents: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, n = _sum_by(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, some in _by_size(batch.column(0)):
                codes, offsets = symbols(some)
                grams, offsets = trigrams(codes, offsets)
                own = np.array(langs[row : row + len(some)], object)
                for lang in set(own):
                    rows = np.flatnonzero(own == lang)
                    picked = np.concatenate([grams[offsets[k] : offsets[k + 1]] for k in rows])
                    keys, n = np.unique(picked, return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    size += len(keys)
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(counted: DataFrame) -> DataFrame:
    """order, lang, whole (an n-gram, or else a context), key, n, types (of a context: how many n-grams it begins)."""
    shift, mask = f"shiftright({{}}, {_BITS})", f"({{}} & {(1 << 2 * _BITS) - 1}L)"
    three = counted.select("lang", F.col("gram").alias("key"), "n")
    two = three.groupBy("lang", F.expr(mask.format("key")).alias("key")).agg(F.count("*").alias("n"))
    one = two.groupBy("lang", F.expr(f"key & {(1 << _BITS) - 1}L").alias("key")).agg(F.count("*").alias("n"))
    out = one.select(F.lit(1).alias("order"), "lang", F.lit(True).alias("whole"), "key", "n", F.lit(0).cast("long").alias("types"))
    for order, grams in ((2, two), (3, three)):
        out = out.unionByName(grams.select(F.lit(order).alias("order"), "lang", F.lit(True).alias("whole"), "key", "n", F.lit(0).cast("long").alias("types")))
        sums = grams.groupBy("lang", F.expr(shift.format("key")).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
        out = out.unionByName(sums.select(F.lit(order).alias("order"), "lang", F.lit(False).alias("whole"), "key", "n", "types"))
    return out


def train(documents: DataFrame, reject: float = REJECT, keys_in_file: int = KEYS_IN_FILE) -> Model | None:
    """A model of every language in documents; None if there is nothing to learn from."""
    spark = documents.sparkSession
    counted = cut(_counts(documents))
    tables = cut(_tables(counted))
    drop(counted)
    few = tables.where("whole").groupBy("lang", "order").agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2)), F.sum("n").alias("total"), F.count("*").alias("types")).collect()  # three rows a language
    languages = sorted({r["lang"] for r in few})
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    discount, total, types, most = np.full((len(languages), 3), 0.5), np.zeros(len(languages)), np.zeros(len(languages)), 0
    for r in few:
        j = number[r["lang"]]
        if r["n1"]:
            discount[j, r["order"] - 1] = r["n1"] / (r["n1"] + 2 * r["n2"])
        if r["order"] == 1:
            total[j], types[j] = r["total"], r["types"]
        most = max(most, r["types"])
    size = tables.where("order = 1 AND whole").select("key").distinct().count()
    parts, folder = max(1, -(-most // keys_in_file)), shared_path(spark, f"loom-lang-{uuid.uuid4().hex}")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = mix(b.column(2).to_numpy().view(np.uint64))
            kind = pa.array([f"{'n' if w else 't'}{o}.{number[x]}" for o, x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(part_of(key, parts).astype(np.int32)), kind, pa.array(key.view(np.int64)), b.column(3), b.column(4)], ["part", "kind", "key", "n", "types"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, held = Files(folder), (0, ""), []

        def save() -> None:
            if held:
                key, n, types = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(key)
                for name, x in ((now[1], key), (f"{now[1]}.n", small(n)), (f"{now[1]}.types", small(types))):
                    out.save(name, now[0], x[order])
                held.clear()

        for b in batches:  # sorted by part and kind: the rows of a file follow each other
            part, kinds, columns = b.column(0).to_numpy(), b.column(1).dictionary_encode(), [c.to_numpy() for c in b.columns[2:]]
            code = kinds.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (code[1:] != code[:-1]))) if len(part) else []
            for low, high in zip(starts, [*starts[1:], len(part)], strict=True):
                name = int(part[low]), kinds.dictionary[int(code[low])].as_py()
                if name != now:
                    save()
                    now = name
                held.append((columns[0][low:high].view(np.uint64), columns[1][low:high], columns[2][low:high]))
        save()
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["done"])

    rows = tables.select("order", "lang", "key", "n", "types", "whole").mapInArrow(dealt, "part int, kind string, key long, n long, types long")
    rows.repartition(parts, "part", "kind").sortWithinPartitions("part", "kind").mapInArrow(store, "done long").collect()
    drop(tables)
    model = Model(folder, parts, languages, discount, total, types, size, np.zeros(len(languages)), np.full(len(languages), np.inf))
    _calibrate(documents.where("text IS NOT NULL AND lang IS NOT NULL"), model, reject)
    return model


def _ranked(rows: DataFrame, wanted: list[tuple[int, int]]) -> list[int]:
    """For each wanted (group, rank from 0) the key of that rank among the rows (group, key) of the group, of all rows for group -1; keys are unsigned."""
    spark, found, left = rows.sparkSession, [0] * len(wanted), [rank for _, rank in wanted]
    for shift in range(56, -8, -8):
        held = spark.sparkContext.broadcast([(group, high) for (group, _), high in zip(wanted, found, strict=True)])

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, held=held) -> Iterator[pa.RecordBatch]:
            asked = sorted(set(held.value))
            n = np.zeros((len(asked), 256), np.int64)
            for batch in batches:
                group, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64) >> np.uint64(shift)
                high, byte = key >> np.uint64(8), (key & np.uint64(255)).astype(np.int64)
                for x, (g, h) in zip(n, asked, strict=True):
                    x += np.bincount(byte[(high == np.uint64(h)) & ((group == g) | (g < 0))], minlength=256)
            at, byte = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([asked[k][0] for k in at], pa.int32()), pa.array(np.array([asked[k][1] for k in at], np.uint64).view(np.int64)), pa.array(byte.astype(np.int32)), pa.array(n[at, byte])], ["group", "high", "byte", "n"])

        counts: dict[tuple[int, int], np.ndarray] = {}
        for r in rows.mapInArrow(count, "group int, high long, byte int, n long").groupBy("group", "high", "byte").agg(F.sum("n").alias("n")).collect():  # 256 rows for each key wanted
            counts.setdefault((r["group"], r["high"] % (1 << 64)), np.zeros(256, np.int64))[r["byte"]] = r["n"]
        for k, (group, _) in enumerate(wanted):
            below = np.cumsum(counts[group, found[k]])
            byte = int(np.searchsorted(below, left[k], "right"))
            left[k] -= int(below[byte - 1]) if byte else 0
            found[k] = found[k] << 8 | byte
        held.destroy()
    return found


_SIGN = np.uint64(1 << 63)


def _calibrate(rows: DataFrame, model: Model, reject: float) -> None:
    """Sets the model's means and limits from all rows that it gives their own language."""
    seen = cut(predict(rows, model).where("letters > 0 AND lang_pred = lang_given").select("lang_pred", "entropy", F.expr("least(letters, 400)").alias("weight")))
    whole = F.expr("CAST(entropy * weight AS DECIMAL(28, 15))")  # sums of decimals don't depend on the order of the rows
    sums = {r["lang_pred"]: r for r in seen.groupBy("lang_pred").agg(F.sum(whole).alias("entropy"), F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()}  # a row a language
    if sums:
        model.mean[:] = float(sum(r["entropy"] for r in sums.values())) / sum(r["weight"] for r in sums.values())
        for k, lang in enumerate(model.languages):
            if lang in sums:
                model.mean[k] = float(sums[lang]["entropy"]) / sums[lang]["weight"]
        mean, names = model.mean.copy(), np.array(model.languages, object)

        def excess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = np.searchsorted(names, batch.column(0).to_numpy(zero_copy_only=False))
                bits = ((batch.column(1).to_numpy() - mean[k]) * np.sqrt(batch.column(2).to_numpy())).view(np.uint64)
                key = np.where(bits & _SIGN, ~bits, bits | _SIGN)  # unsigned, in the order of the numbers
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(key.view(np.int64))], ["group", "key"])

        keys = cut(seen.mapInArrow(excess, "group int, key long"))
        sizes = {-1: sum(r["n"] for r in sums.values())} | {k: sums[x]["n"] for k, x in enumerate(model.languages) if x in sums and sums[x]["n"] >= 20}
        wanted = [(g, f(0.999 * (n - 1))) for g, n in sizes.items() for f in (math.floor, math.ceil)]
        bits = np.array(_ranked(keys, wanted), np.uint64)
        low, high = np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64).reshape(-1, 2).T
        at = np.array([0.999 * (n - 1) % 1 for n in sizes.values()])
        quantile = dict(zip(sizes, low + (high - low) * at, strict=True))
        for k in range(len(model.languages)):
            model.limit[k] = reject * max(float(quantile.get(k, quantile[-1])), 1.0)
        drop(keys)
    drop(seen)


def _assess(model: Model, some: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of each text: language number, confidence, entropy, letters, and whether it is accepted."""
    codes, offsets = symbols(some)
    letters = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[offsets])
    grams, offsets = trigrams(codes, offsets)
    h = model.entropies(grams, offsets)
    best = np.argmin(h, axis=1)
    low = h[np.arange(len(some)), best]
    odds = np.exp(-(h - low[:, None]) * np.minimum(np.diff(offsets), 60)[:, None])
    excess = (low - model.mean[best]) * np.sqrt(np.minimum(letters, 400))
    return best, 1 / odds.sum(axis=1), low, letters, (letters > 0) & (excess <= model.limit[best])


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, letters, accepted and lang_given (the row's own lang, if any) for each row."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            n = batch.num_rows
            best, score, entropy, letters, fine = np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
            for row, some in _by_size(batch.column(1)) if model else ():
                at = slice(row, row + len(some))
                k, p, entropy[at], letters[at], fine[at] = _assess(model, some)
                best[at], score[at] = np.where(letters[at] > 0, k, -1), np.where(letters[at] > 0, p, 0)
            names = np.array([*(model.languages if model else []), "und"], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(entropy), pa.array(letters), pa.array(fine), batch.column(2)], out)

    out = ["doc_id", "lang_pred", "score", "entropy", "letters", "accepted", "lang_given"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    given = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", "text", given.alias("lang_given")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, letters long, accepted boolean, lang_given string")


def keep_known(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of documents, with all their columns, that the model accepts."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            fine = np.zeros(batch.num_rows, bool)
            for row, some in _by_size(batch.column(at)) if model else ():
                fine[row : row + len(some)] = _assess(model, some)[4]
            yield batch.filter(pa.array(fine))

    return documents.mapInArrow(run, documents.schema)


def learn_and_predict(documents: DataFrame, held_out: Column) -> DataFrame:
    """predict() on all rows with a model of those that aren't held out, with the column held_out."""
    model = train(documents.where(~held_out))
    return predict(documents, model).withColumn("held_out", held_out)
