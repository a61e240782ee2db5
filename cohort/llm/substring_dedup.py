"""Removal of long repeated passages by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``window // 2`` words, so any passage of ``window`` words holds a
whole block of each document that has it. The blocks are indexed by hash; every rolling window of a block's length probes
the index, and a hit extends to the passages around it, whose hashes decide what repeats and who has it first.

Before that, a screen keeps the probes few: each stretch of ``window`` words has a content-chosen mark (a winnowed short
word gram), and a stretch none of whose marks occurs in another document cannot repeat. The screen loses nothing. Copies of
a whole word sequence are settled by one hash each and take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.words import signed, window_hashes, word_hashes
from cohort.operators.staging import stage

WINDOW = 50
MARK = 8

NOTHING = hashlib.sha256(b"").hexdigest()

SCREEN = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32()), ("n_words", pa.int64()), ("sha", pa.string())])
SPOTS = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
PASSAGES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
REDUCED = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string())])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of some ``width`` consecutive ones; ties are all taken, so equal stretches agree."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1)
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(padded, width).max(axis=1) == hashes)


def spread(places: np.ndarray, before: int, after: int, size: int) -> np.ndarray:
    """Flags of the ``size`` places that lie from ``before`` places before to ``after`` after one of ``places``."""
    size = max(0, size)
    turns = np.zeros(size + 1, dtype=np.int32)
    np.add.at(turns, np.clip(places - before, 0, size), 1)
    np.add.at(turns, np.clip(places + after + 1, 0, size), -1)
    return np.cumsum(turns[:size]) > 0


def _firsts(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of the places that have their hash first, so that a text which repeats itself sends each hash once."""
    return np.sort(places[np.unique(hashes[places], return_index=True)[1]])


def _equals(hashes: np.ndarray, places: list[int]) -> np.ndarray:
    """All places with the hash of one of the given places."""
    given = np.array(places, dtype=np.int64)
    return np.flatnonzero(np.isin(hashes, hashes[given[given < len(hashes)]]))


def _whole(words: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole word sequence."""
    if not len(words):
        return 0, 0
    return int(signed(window_hashes(words, len(words)))[0]), int(signed(window_hashes(words, len(words), 1))[0])


def screen(docs: DataFrame, window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """A row per document (``pos`` null) with the hash and digest of its words, and a row per mark (``n_words`` null)."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            columns: list[list] = [[] for _ in SCREEN]
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = word_hashes(text or "")
                joined = b" ".join((text or "").encode().split())
                rows = [(doc_id, *_whole(words), None, len(words), hashlib.sha256(joined).hexdigest())]
                if len(words) >= window and doc_id is not None:
                    grams = window_hashes(words, mark)
                    places = winnow(grams, window - mark + 1)
                    rows += [(doc_id, h, None, p, None, None) for h, p in zip(signed(grams[places]).tolist(), places.tolist(), strict=True)]
                for column, values in zip(columns, zip(*rows, strict=True), strict=True):
                    column += values
            yield dict(zip(SCREEN.names, columns, strict=True))

    return over_batches(texts_of(docs), work, SCREEN)


def _rolling(candidates: DataFrame, window: int, blocks_only: bool) -> DataFrame:
    """``h, doc_id, pos`` of the rolling windows of a block's length near the marks, or of the aligned ones among them."""
    block = window // 2

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            found, ids, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, text, spots in zip(batch["doc_id"], batch["text"], batch["spots"], strict=True):
                words = word_hashes(text or "")
                starts = spread(np.array(spots, dtype=np.int64), window - MARK, 0, len(words) - window + 1)
                near = spread(np.flatnonzero(starts), 0, window - block, len(words) - block + 1)
                if blocks_only:
                    near &= np.arange(len(near)) % block == 0
                hashes = window_hashes(words, block)
                at = _firsts(hashes, np.flatnonzero(near))
                found.append(signed(hashes)[at])
                ids.append(np.full(len(at), doc_id))
                places.append(at)
            yield {"h": np.concatenate(found), "doc_id": np.concatenate(ids), "pos": np.concatenate(places)}

    return over_batches(candidates, work, SPOTS)


def _passages(candidates: DataFrame, window: int) -> DataFrame:
    """``h1, h2, doc_id, row, pos`` of the passages that hold a hit; ``row`` tells rows of one id apart."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            empty = np.zeros(0, np.int64)
            parts: list[list[np.ndarray]] = [[empty] for _ in PASSAGES]
            for doc_id, row, text, hits in zip(batch["doc_id"], batch["row"], batch["text"], batch["hits"], strict=True):
                words = word_hashes(text or "")
                block, first, second = window_hashes(words, window // 2), window_hashes(words, window), window_hashes(words, window, 1)
                at = _firsts(first, np.flatnonzero(spread(_equals(block, hits), window - window // 2, 0, len(words) - window + 1)))
                for part, values in zip(parts, (signed(first)[at], signed(second)[at], np.full(len(at), doc_id), np.full(len(at), row), at), strict=True):
                    part.append(values)
            yield {name: np.concatenate(part) for name, part in zip(PASSAGES.names, parts, strict=True)}

    return over_batches(candidates, work, PASSAGES)


def _reduced(candidates: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            columns: list[list] = [[] for _ in REDUCED]
            for doc_id, text, starts in zip(batch["doc_id"], batch["text"], batch["starts"], strict=True):
                words = (text or "").encode().split()
                hashes = word_hashes(text or "")
                gone = spread(_equals(window_hashes(hashes, window), starts), 0, window - 1, len(words))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                values = (doc_id, *_whole(hashes), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield dict(zip(REDUCED.names, columns, strict=True))

    return over_batches(candidates, work, REDUCED)


def dedup_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: words, words removed, and the digest of the kept words joined by one space.

    A word goes if a passage of ``window`` words that covers it also starts in a document with a smaller id. Passages are
    judged on the input. Null and empty texts and texts of fewer than ``window`` words lose nothing; rows that share an id
    do not count against each other, and rows without an id neither lose words nor count against others.

    Whoever has a passage first comes from one minimum per passage hash, combined before the shuffle: no pairs of
    documents are made, however many share a passage. Per document, only places in its own text are gathered.
    """
    docs = texts_of(docs)
    seen = stage(screen(docs, window))
    whole = seen.filter("pos is null").drop("pos")
    key = ["h1", "h2", "n_words"]
    firsts = whole.filter(F.col("n_words") >= window).groupBy(*key).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    whole = whole.join(firsts, key, "left").withColumn("_copy", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    whole = stage(whole.select("doc_id", "h1", "h2", "n_words", "sha", "_copy"))

    marks = seen.filter("pos is not null").select("doc_id", F.col("h1").alias("h"), "pos")
    copies = whole.groupBy("doc_id").agg(F.min("_copy").alias("_all")).filter("_all").select("doc_id")
    marks = marks.join(copies, "doc_id", "left_anti")
    common = marks.groupBy("h").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last").select("h")
    spots = marks.join(common, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("spots"))
    candidates = stage(docs.join(spots, "doc_id").withColumn("row", F.xxhash64("text")))

    blocks = stage(_rolling(candidates, window, True))
    index = blocks.groupBy("h").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    hits = _rolling(candidates, window, False).join(index, "h").filter("_first <> doc_id or _last <> doc_id")
    hits = stage(hits.select("h", "doc_id", "pos"))
    referred = blocks.join(hits.select("h").distinct(), "h", "left_semi")
    places = hits.unionByName(referred).groupBy("doc_id").agg(F.collect_set("pos").alias("hits"))

    passages = stage(_passages(candidates.select("doc_id", "row", "text").join(places, "doc_id"), window))
    first = passages.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    repeats = passages.join(first.select("h1", "h2", "_first"), ["h1", "h2"]).filter("_first < doc_id")
    starts = repeats.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("starts"))
    reduced = _reduced(candidates.select("doc_id", "row", "text").join(starts, ["doc_id", "row"]), window).dropDuplicates(["doc_id", "h1", "h2"])
    reduced = reduced.select("doc_id", "h1", "h2", "n_removed", F.col("sha").alias("_sha"))
    joined = whole.join(reduced, ["doc_id", "h1", "h2"], "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.lit(NOTHING)).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )
