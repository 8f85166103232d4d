"""Benchmark decontamination with DataFrame operations only.

A window is eight consecutive words of a benchmark item (all its words, if it has fewer).  What is
broadcast is a set of hashes: a 64-bit hash, a SHA-256 digest and a length for each distinct window, in blocks
of at most BLOCK windows, so its bytes have a fixed bound however large the benchmark and however long
its words are; every document's words are scanned once for each block.  A probe compares the hash, and where that
is in the set the digest of the words themselves.  Scan, generate, probe and partial aggregation are one
code-generated stage; only hits and one row per document are shuffled.

Documents carry the digests of the windows that hit them.  The items of a window are looked up
afterwards, once for each distinct set of windows, so a passage that many items or many documents share is
neither broadcast with its items nor joined once for each document.

Defined results: null text has no words; null item text or item_id takes no part; items
that share an id are one item; repeated rows of documents give one result row each; an
empty benchmark hits nothing; a text of any length is one row, with its words as one array.  Other columns of
documents are kept by remove(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.frames import cut, fresh

WINDOW = 8
BLOCK = 200_000
_OTHER = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "".join(map(chr, range(0x41, 0x5B)))


def word_array(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, with A-Z in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " "), "")


def _digest(words: Column) -> Column:
    """Of a run of words; no word has a space in it."""
    return F.unhex(F.sha2(F.array_join(words, " ").cast("binary"), 256))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """key (hash), digest, span (words) and item of every window of every item, each once."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("words"))
    long = F.greatest(F.lit(1), F.size("words") - window + 1)
    spread = items.where(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(1), long)).alias("at"))
    whole = spread.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("window"))
    return whole.select(F.xxhash64("window").alias("key"), _digest(F.col("window")).alias("digest"), F.size("window").alias("span"), "item").distinct()


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each distinct (doc_id, text): doc_id, text_key, copies, n_words, spans (at, span) that hit and the items hit."""
    found = _windows(benchmark, window)
    known = found.select("key", "digest", "span").distinct()
    sizes = known.groupBy("span").count().collect()  # at most one row for each window length
    spans, total = sorted(r["span"] for r in sizes) or [window], sum(r["count"] for r in sizes)
    blocks = max(1, -(-total // block))
    base = documents.select("doc_id", F.xxhash64("text").alias("text_key"), word_array(F.col("text")).alias("words"))
    hashed = base.withColumn("n_words", F.size("words"))
    out = None
    for k in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod("key", F.lit(blocks)) == k)
        # step -1 stands for the document itself, each other one for a place and a window length
        rows = hashed.select("doc_id", "text_key", "words", "n_words", F.explode(F.sequence(F.lit(-1), F.col("n_words") * len(spans) - 1)).alias("step"))
        long = F.lit(spans[0]) if len(spans) == 1 else F.element_at(F.array(*map(F.lit, spans)), F.pmod("step", F.lit(len(spans))) + 1)
        at = F.when(F.col("step") >= 0, F.floor(F.col("step") / len(spans)).cast("int") + 1).otherwise(0)
        rows = rows.withColumns({"at": at, "long": long})
        whole = F.slice("words", F.greatest("at", F.lit(1)), F.col("long"))
        rows = rows.withColumn("probe", F.when((F.col("at") > 0) & (F.col("at") + F.col("long") - 1 <= F.col("n_words")), F.xxhash64(whole)))
        same = _digest(F.slice("words", F.greatest("at", F.lit(1)), F.col("span"))) == F.col("digest")  # with the window's length, so only computed where the hash is equal
        joined = rows.join(F.broadcast(part), (F.col("probe") == F.col("key")) & same, "left")
        kept = joined.where("at = 0 OR key IS NOT NULL").select(
            "doc_id", "text_key", "n_words", F.when((F.col("at") == 0) & (F.lit(k) == 0), 1).otherwise(0).alias("row"),
            F.when(F.col("at") > 0, F.struct("at", "span")).alias("hit"), F.col("digest"),
        )
        out = kept if out is None else out.unionByName(kept)
    each = cut(out.groupBy("doc_id", "text_key", "n_words").agg(F.sum("row").alias("copies"), F.collect_set("hit").alias("spans"), F.array_sort(F.collect_set("digest")).alias("windows")))
    sets = each.where(F.size("windows") > 0).select("windows").distinct()
    listed = sets.select("windows", F.explode("windows").alias("digest")).join(found.select("digest", "item"), "digest")
    items = listed.groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    clean = each.where(F.size("windows") == 0).withColumn("items", F.array().cast("array<string>"))  # most documents, which have no key to join by
    return each.where(F.size("windows") > 0).join(items, "windows").unionByName(clean).drop("windows")


def covered(spans: Column) -> Column:
    """Positions (from 1) of the words in any hit window, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["at"], x["at"] + x["span"] - 1))))


def scan(documents: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (min_items items or more) for each document row."""
    found = hits(documents, benchmark, window, block)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(covered(F.col("spans"))).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove(documents: DataFrame, benchmark: DataFrame, how: str = "documents", min_items: int = 1, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """documents without those hit by min_items items or more, or ("spans") with the hit words replaced by one space each.

    All columns of documents are returned.  In "spans" mode the words that stay are written
    in the normal form of the scan, joined by one space, in documents that are hit; other
    documents keep their text as it is.
    """
    found = hits(documents, benchmark, window, block).where(F.size("items") >= min_items)
    name, key, at = (fresh(documents.columns, x) for x in ("id", "key", "at"))
    found = found.select(F.col("doc_id").alias(name), F.col("text_key").alias(key), covered(F.col("spans")).alias(at))
    match = documents["doc_id"].eqNullSafe(found[name]) & (F.xxhash64(documents["text"]) == found[key])
    if how == "documents":
        return documents.join(found, match, "left_anti")
    words = word_array(documents["text"])
    rest = F.array_join(F.filter(words, lambda w, k: ~F.array_contains(found[at], (k + 1).cast("int"))), " ")
    joined = documents.join(found, match, "left")
    return joined.select(*(F.when(found[at].isNull(), documents[c]).otherwise(rest).alias(c) if c == "text" else documents[c] for c in documents.columns))
