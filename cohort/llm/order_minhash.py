"""Order MinHash fingerprints: sketches of a text that follow its edit distance.

The units are words. Every gram of ``GRAM`` consecutive words is numbered by how often it stood before, so repeats count.
Each of ``TUPLES`` hash functions picks the ``LENGTH`` smallest of these numbered grams, puts them back into text order, and
hashes them as a tuple. Two texts agree in a place of their fingerprints if they share the picked grams in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.words import mixed, window_hashes, word_hashes

GRAM = 2
LENGTH = 2
TUPLES = 40
DIGITS = 8  # hexadecimal digits kept of each tuple
ROWS_PER_SLICE = 5_000
FEWEST_SLICES, MOST_SLICES = 8, 65_536

_SALTS = mixed(np.arange(1, TUPLES + 1, dtype=np.uint64)) | np.uint64(1)


def _numbered(grams: np.ndarray) -> np.ndarray:
    """Hashes of the grams together with how many equal ones stand before each."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(grams))
    nth = np.empty(len(grams), dtype=np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mixed(grams + nth * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: str, tuples: int = TUPLES, length: int = LENGTH, gram: int = GRAM) -> str:
    """``tuples`` groups of hexadecimal digits; texts of fewer than ``gram`` words are one gram, and the empty text is zeros.

    With fewer than ``length`` numbered grams all of them are picked.
    """
    words = word_hashes(text)
    if not len(words):
        return "0" * (tuples * DIGITS)
    grams = _numbered(window_hashes(words, min(gram, len(words))))
    out = np.empty(tuples, dtype=np.uint64)
    some = max(1, (1 << 21) // len(grams))  # hash functions at once, so that a long text stays within some megabytes
    for lo in range(0, tuples, some):
        values = grams * _SALTS[lo : lo + some, None]
        rows = np.arange(len(values))
        picked = []
        for _ in range(min(length, len(grams))):
            least = values.argmin(axis=1)
            picked.append(least)
            values[rows, least] = np.uint64(2**64 - 1)
        state = np.zeros(len(values), dtype=np.uint64)
        for places in np.sort(np.array(picked), axis=0):
            state = mixed(state * np.uint64(0xC2B2AE3D27D4EB4F) + grams[places])
        out[lo : lo + some] = state
    return (out >> np.uint64(64 - 4 * DIGITS)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of the places in which two fingerprints agree, 0 to 1."""
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=">u4") for f in (a, b))
    return float((x == y).mean())


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def in_order(docs: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``doc_id, text`` with ``_slice`` and ``_ahead``: slices of the id range, each followed by the head of the next one.

    Slices are cut near approximate quantiles, which are doubles and need not be ids, and then begin at the least id that each
    of them holds; their number follows the rows, up to a bound, which also bounds the list of cuts. The head of a slice goes to the slice before it as well, as a guest (``_ahead``), and the first of all
    to the last slice. So every document meets its successor in one shuffle, and no task sorts more than its slices.
    """
    docs = texts_of(docs)
    ids = docs.select("doc_id")
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least")).first()
    slices = min(MOST_SLICES, max(FEWEST_SLICES, row["n"] // rows_per_slice))
    cuts = ids.approxQuantile("doc_id", [n / slices for n in range(1, slices)], 0.2 / slices) if row["known"] else []
    rough = np.array(sorted({min(int(c), 2**63 - 1) for c in cuts}), dtype=np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(rough, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    heads = ids.filter("doc_id is not null").groupBy(part("doc_id").alias("_part")).agg(F.min("doc_id").alias("head"))
    inner = sorted({r["head"] for r in heads.collect()} - {row["least"]})
    first = None if row["known"] < row["n"] else row["least"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(inner, dtype=np.int64))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        bounds, out = shared.value, []
        for doc_id in ids:
            if pd.isna(doc_id):
                out.append([0] if first is not None else [0, len(bounds)])
                continue
            doc_id = int(doc_id)  # a string, as longs with nulls would come as doubles
            at = int(np.searchsorted(bounds, doc_id, side="right"))
            guest = [at - 1] if at and bounds[at - 1] == doc_id else [len(bounds)] if doc_id == first else []
            out.append([at, *guest])
        return pd.Series(out)

    dealt = docs.select("doc_id", "text", F.posexplode(places(F.col("doc_id").cast("string"))).alias("_guest", "_slice"))
    dealt = dealt.select("doc_id", "text", "_slice", (F.col("_guest") == 1).alias("_ahead"))
    return dealt.repartitionById(len(inner) + 1, "_slice").sortWithinPartitions("_slice", "_ahead", "doc_id", F.xxhash64("text"))


def _neighbours(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """A row's result comes when its successor is seen; guests are only successors."""
    held: tuple | None = None
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        for part, ahead, doc_id, text in zip(batch["_slice"], batch["_ahead"], batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            own = (part, ahead, doc_id, text, fingerprint(text))
            if held and held[0] == part and not held[1]:
                _, _, before, old, mark = held
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                other = fingerprint(edited)
                values = (before, len(old), hashlib.sha256(edited.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, own[4]))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            held = own
        yield out


def fingerprint_neighbours(docs: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last half of the code points replaced by as many from the start of the next document in order of
    ids (the first follows the last; a document alone follows itself). Null texts count as empty, rows without an id come
    first, and rows that share an id follow each other in an order fixed by their texts.
    """
    return over_batches(in_order(docs, rows_per_slice), _neighbours, SCHEMA)
