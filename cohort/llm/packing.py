"""Best-fit packing of documents into token sequences, planned on the histogram of lengths.

Documents are tokenized once, cut into pieces of at most the capacity, and written as lengths and checksums. The plan is
made over counts of lengths, not over pieces, so its size depends on the capacity alone. Every piece then finds its slot by
its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.tokens import encoder
from cohort.operators.staging import stage

CAPACITY = 2048
END_ID = 0

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("_task", pa.int64()), ("_rank", pa.int64()),
])
PLACED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """Pieces of every row of ``docs``, each with the task that made it and its rank among that task's pieces of its length.

    A null text counts as empty; every document ends with one end id, so none is without a piece.
    """

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encode, task = encoder(ranks).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for n, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    values = (doc_id, n, start, end - start, zlib.crc32(ids[start:end].tobytes()), task, int(seen[end - start]))
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    seen[end - start] += 1
            yield out

    return over_batches(texts_of(docs), work, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit, longest first, over ``{length: count}``: rows ``length, first rank, first sequence, per sequence, offset``.

    Pieces of one length from ``first rank`` up to the next row's go to consecutive sequences from ``first sequence``,
    ``per sequence`` of them in each, one after the other from ``offset``. Open sequences are kept as groups with equal room;
    a group is split at most once for each length, so there are a few rows for each length whatever the counts are.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, number)
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        space = length
        while left and space <= capacity:
            if not room[space]:
                space += 1
                continue
            first, number = room[space].pop()
            each = space // length
            full = min(number, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - space))
                rank, left = rank + full * each, left - full * each
                room[space - each * length].append((first, full))
            if full < number and left < each and left:
                rows.append((length, rank, first + full, left, capacity - space))
                room[space - left * length].append((first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < number:
                room[space].append((first + full, number - full))
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                rows.append((length, rank, used, each, 0))
                room[capacity - each * length].append((used, full))
                rank, used = rank + full * each, used + full
            if rest:
                rows.append((length, rank, used, rest, 0))
                room[capacity - rest * length].append((used, 1))
                used += 1
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Offsets within a sequence are without gaps from 0, and no sequence is longer than ``capacity``. Repeated rows are packed
    as often as they occur; an empty table gives no rows. The driver sees the histogram, at most ``capacity`` counts, and the
    plan; the pieces of a length, however many, are numbered by adding counts of tasks, so no task meets them all.
    """
    made = stage(pieces(docs, capacity, ranks))
    per_task = made.groupBy("length", "_task").count()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = made.join(bases, ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    slots = docs.sparkSession.sparkContext.broadcast(_ordered(plan(counts, capacity)))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        table = slots.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = np.array(batch["length"], dtype=np.int64), np.array(batch["_rank"], dtype=np.int64)
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            within = rank - row[:, 1]
            yield {
                **{name: batch[name] for name in PIECES.names[:5]},
                "sequence_id": row[:, 2] + within // row[:, 3],
                "offset": row[:, 4] + within % row[:, 3] * length,
            }

    return over_batches(ranked.select(*PIECES.names), work, PLACED)


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]
