"""Line deduplication over levelled sorted runs of line hashes.

The lines seen so far live in runs: Parquet tables of 128-bit line hashes, sorted, each with the number of documents that
hold the line and the document that keeps it. A batch of documents merge-anti-joins the runs: lines that no run has are
new and get their keeper from the batch; lines that some run has only add to the count. The batch's own run goes to level
0, and when a level has ``FANOUT`` runs they are merged into one run of the next level, so a hash is rewritten a
logarithmic number of times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.operators.staging import stage

LEAST_CHARS = 40
LEAST_DOCS = 5
FANOUT = 3
BATCHES = 4

KEY = ["h1", "h2"]
LINES = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> tuple[int, int] | None:
    """Hash of a line without white space at its ends and with A to Z lower-cased; None if it is too short to count."""
    key = line.strip().lower()  # of bytes: ASCII white space and letters only
    if len(key) < least_chars or len(key.decode()) < least_chars:
        return None
    digest = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, h1, h2``: each long enough line of a document, once."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            ids, first, second = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys = {line_key(line, least_chars) for line in (text or "").encode().split(b"\n")} - {None}
                ids += [doc_id] * len(keys)
                first += [k[0] for k in keys]
                second += [k[1] for k in keys]
            yield {"doc_id": ids, "h1": first, "h2": second}

    return over_batches(texts_of(docs), work, LINES)


class LineRuns:
    """The lines of all batches added so far. Batches come in descending order of document, so that the first holder of a
    line, which keeps it, is the largest."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def seen(self) -> DataFrame | None:
        """All hashes of all runs."""
        return reduce(DataFrame.unionByName, [r.select(*KEY) for r in self.runs]).distinct() if self.runs else None

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge a batch of ``doc_id, h1, h2`` and return its run: ``h1, h2, n_docs, keeper`` (no keeper for lines seen before)."""
        own = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        seen = self.seen()
        if seen is not None:
            new = own.join(seen, KEY, "left_anti")
            old = own.join(seen, KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            own = new.unionByName(old)
        run = self._write(own)
        self.levels[0].append(run)
        self._compact()
        return run

    def _write(self, run: DataFrame) -> DataFrame:
        return stage(run.repartitionByRange(*KEY).sortWithinPartitions(*KEY))

    def _compact(self) -> None:
        for n, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n + 1].append(self._write(self._merged(level)))
            self.levels[n] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        return every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame | None:
        """``h1, h2, keeper`` of the lines that at least ``least_docs`` documents hold."""
        return self._merged(self.runs).filter(F.col("n_docs") >= least_docs).select(*KEY, "keeper") if self.runs else None


def doomed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """``doc_id, lines``: the hashes that a document loses, for documents that lose any.

    The table goes through the runs in ``batches`` slices of the ids, largest first. Counts and keepers are combined before
    they are shuffled, so a line of very many documents costs a row per task.
    """
    lines = stage(line_hashes(docs, least_chars))
    runs = LineRuns()
    for part in _slices(lines, batches):
        runs.add(lines.filter(part))
    repeated = stage(runs.repeated(least_docs))
    lost = lines.join(repeated, KEY).filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("lines"))


def _slices(lines: DataFrame, batches: int) -> list[Column]:
    """Filters that cut the ids into slices of like size, largest ids first; rows without an id come last."""
    cuts = sorted(set(lines.approxQuantile("doc_id", [n / batches for n in range(1, batches)], 0.01)), reverse=True)
    edges = [None, *[int(c) for c in cuts], None]
    parts = []
    for high, low in zip(edges, edges[1:], strict=False):
        part = F.lit(True)
        if high is not None:
            part = part & (F.col("doc_id") <= high) if low is not None else F.coalesce(F.col("doc_id") <= high, F.lit(True))
        if low is not None:
            part = part & (F.col("doc_id") > low)
        parts.append(part)
    return parts


def kept_lines(text: str | None, lost: set[tuple[int, int]], least_chars: int = LEAST_CHARS) -> tuple[str, int, int]:
    """The text without its lost lines, the number of its lines, and how many were lost."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    kept = [line for line in lines if line_key(line.encode(), least_chars) not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_lost(docs: DataFrame, least_chars: int, least_docs: int, batches: int, *more: str) -> DataFrame:
    lost = doomed_lines(docs, least_chars, least_docs, batches).withColumnRenamed("lines", "_lost")
    return docs.select("doc_id", *more).join(lost, "doc_id", "left")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: lines, lines dropped, and the digest of the kept text.

    A line of at least ``least_chars`` code points (ends stripped, A to Z lower-cased) found in at least ``least_docs``
    documents stays only in the document with the largest id. A null or empty text is one empty line. Every row counts as a
    document, so a repeated row counts again, and rows that share the largest id all keep the line. Rows without an id
    count, but keep their lines.
    """

    def work(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in rows:
            out: dict[str, list] = {f.name: [] for f in SCHEMA}
            for doc_id, text, lost in zip(batch["doc_id"], batch["text"], batch["_lost"], strict=True):
                kept, lines, dropped = kept_lines(text, {(k["h1"], k["h2"]) for k in lost or ()}, least_chars)
                for name, value in zip(out, (doc_id, lines, dropped, hashlib.sha256(kept.encode()).hexdigest()), strict=True):
                    out[name].append(value)
            yield out

    return over_batches(_with_lost(texts_of(docs), least_chars, least_docs, batches, "text"), work, SCHEMA)


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` with the same columns, their texts without the lines that ``dedup_lines`` drops."""
    lost = doomed_lines(docs, least_chars, least_docs, batches).select(F.col("doc_id").alias("_llm_lost_id"), F.col("lines").alias("_llm_lost"))
    joined = docs.join(lost, F.col("doc_id") == F.col("_llm_lost_id"), "left").drop("_llm_lost_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                kept_lines(t, {(k["h1"], k["h2"]) for k in lost}, least_chars)[0] if lost else t
                for t, lost in zip(batch.column("text").to_pylist(), batch.column("_llm_lost").to_pylist(), strict=True)
            ]
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_llm_lost"]
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "_llm_lost"])

    return joined.mapInArrow(work, docs.schema)
