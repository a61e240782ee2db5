"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every few consecutive grams of ``GRAM`` words the one with the smallest hash is a fingerprint, chosen so that every span
of ``WINDOW`` words has one. Both sides choose alike, so joining the fingerprints of documents and items misses no shared
window. Every match fixes an alignment of a document and an item; along it the hit is extended: the item's windows are
compared with the words of the document. Items too short for a window are one window each and are looked for by the hash of
all their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.staging import stage

WINDOW = 10
GRAM = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a text column with A to Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _GAPS), "")


def _but_last(array: Column, short: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element and its index, but for the last ``short``."""
    return F.transform(F.slice(array, 1, F.greatest(F.size(array) - short, F.lit(0))), f)


def grams(df: DataFrame, words: str, size: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``_g``, the hashes of every ``size`` consecutive words."""
    hashed = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    if size == 1:
        return hashed.withColumnRenamed("_h", "_g")
    h = F.col("_h")
    return hashed.select(*keep, _but_last(h, size - 1, lambda x, i: F.xxhash64(x, *[F.get(h, i + n) for n in range(1, size)])).alias("_g"))


def fingerprints(df: DataFrame, words: str, keep: list[str], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``keep``, ``h`` and ``pos`` of the fingerprints of each row."""
    width = window - gram + 1
    g, m = F.col("_g"), F.col("_m")
    least = _but_last(g, width - 1, lambda x, i: F.least(x, *[F.get(g, i + n) for n in range(1, width)]))
    both = grams(df, words, gram, keep).select(*keep, "_g", least.alias("_m"))
    # A gram is the least of some window that covers it if it is the greatest of the least of all those windows.
    chosen = F.transform(g, lambda x, i: F.when(x == F.greatest(*[F.get(m, i - n) for n in range(width)]), F.struct(x.alias("h"), i.alias("pos"))))
    return both.select(*keep, F.inline(F.filter(chosen, lambda x: x.isNotNull())))


def every_gram(df: DataFrame, words: str, size: int, keep: list[str]) -> DataFrame:
    """``keep``, ``h`` and ``pos`` of all grams of ``size`` words of each row."""
    return grams(df, words, size, keep).select(*keep, F.inline(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("pos")))))


def alignments(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_dc_id`` of documents and ``_dc_found``: structs of an item, its words, and how far the document is ahead of it.

    The items' fingerprints are written first, so that the planner knows their size: it broadcasts them if they are small
    and shuffles both sides if not.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words"))
    items = stage(words.filter(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct().withColumn("key", F.xxhash64("words")))
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_dc_id"), words_of("text").alias("words"))
    sizes = items.groupBy(F.least(F.size("words"), F.lit(window)).alias("size")).count()
    parts = []
    for size in sorted(r["size"] for r in sizes.collect()):  # at most ``window`` of them
        alike = items.filter(F.least(F.size("words"), F.lit(window)) == size)
        if size == window:
            marks, probes = fingerprints(alike, "words", ["item_id", "key"], window), fingerprints(texts, "words", ["_dc_id"], window)
        else:
            marks, probes = every_gram(alike, "words", size, ["item_id", "key"]), every_gram(texts, "words", size, ["_dc_id"])
        met = probes.join(stage(marks.withColumnRenamed("pos", "at")), "h")
        parts.append(met.select("_dc_id", "item_id", "key", (F.col("pos") - F.col("at")).alias("ahead")).distinct())
    if not parts:
        return texts.select("_dc_id", F.array().cast("array<struct<item_id:string,words:array<string>,ahead:int>>").alias("_dc_found")).limit(0)
    found = reduce(DataFrame.unionByName, parts).distinct().join(items, ["item_id", "key"])
    return found.groupBy("_dc_id").agg(F.collect_list(F.struct("item_id", "words", "ahead")).alias("_dc_found"))


def _starts(found: Column, words: Column, window: int) -> Column:
    """Places in the document where a window of the item stands along the alignment, and the window's length."""
    item, ahead = found["words"], found["ahead"]
    size = F.least(F.size(item), F.lit(window))
    from_item = F.sequence(F.greatest(F.lit(0), -ahead), F.greatest(F.lit(0), -ahead, F.size(item) - size))
    fits = F.filter(from_item, lambda q: (q + size <= F.size(item)) & (q + ahead + size <= F.size(words)))
    equal = F.filter(fits, lambda q: F.slice(item, q + 1, size) == F.slice(words, q + ahead + 1, size))
    return F.transform(equal, lambda q: F.sequence(q + ahead, q + ahead + size - 1))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_dc_words``, ``_dc_hits`` and ``_dc_items``: number of words and of hit words, sorted ids of the items met."""
    found = alignments(docs, benchmark, window)
    joined = docs.join(found, F.col("doc_id") == F.col("_dc_id"), "left").drop("_dc_id").withColumn("_dc_w", words_of("text"))
    words = F.col("_dc_w")
    met = F.transform("_dc_found", lambda x: F.struct(x["item_id"].alias("item_id"), F.flatten(_starts(x, words, window)).alias("places")))
    met = F.filter(met, lambda x: F.size(x["places"]) > 0)
    kept = [c for c in docs.columns]
    judged = joined.select(*kept, F.size(words).cast("long").alias("_dc_words"), F.when(F.col("_dc_found").isNotNull(), met).alias("_dc_met"))
    places = F.array_distinct(F.flatten(F.transform("_dc_met", lambda x: x["places"])))
    items = F.array_sort(F.array_distinct(F.transform("_dc_met", lambda x: x["item_id"])))
    verdict = F.struct(
        F.col("_dc_words"),
        F.when(F.col("_dc_met").isNotNull(), F.size(places)).otherwise(0).cast("long").alias("_dc_hits"),
        F.coalesce(items, F.array().cast("array<string>")).alias("_dc_items"),
    )
    # A generator of one row: filters on the verdict stay above it, and so do not repeat the work inside the join.
    return judged.select(*kept, F.inline(F.array(verdict)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: words, words hit, items with a window in the document, digest of their sorted ids, verdict.

    A word is hit if it stands inside a window of ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. Null and empty texts have no words. Rows without an id are never hit. Items without an id or without
    words are left out; rows that repeat an item count once. With an empty benchmark nothing is hit.
    """
    judged = judge(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window)
    return judged.select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        F.col("_dc_hits").alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dc_items", ","), 256).alias("items_sha256"),
        (F.col("_dc_hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no window of the benchmark stands in."""
    return judge(docs, benchmark.select("item_id", "text"), window).filter("_dc_hits = 0").select(*docs.columns)
