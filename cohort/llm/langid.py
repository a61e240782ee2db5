"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of each order, hashed into a fixed number of columns. The kernel of two
texts is the mean over the orders of the cosine of their sets. A Nyström map onto landmark texts turns one-versus-rest
kernel ridge regression into a small linear system, solved on the driver from a bounded sample of labelled rows. Because
the kernel is linear in the presence vectors, landmarks and solution fold into one matrix of columns x languages, and
texts are scored by products of presence matrices with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.batches import ROWS_AT_ONCE, over_batches, texts_of

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
COLUMNS = 1 << 13  # hashed n-grams of one order
SAMPLE_PER_LANGUAGE = 256  # bound of the training sample; LANDMARKS of them are landmarks
LANDMARKS = 32
SAMPLE_SLICES = 16
MOST_LABELS = 512
RIDGE = 1e-2
SCORED_AT_ONCE = 32

_MIX = np.uint32(0x9E3779B1)


def presence(text: str, out: np.ndarray) -> None:
    """Mark the n-grams of the lower-cased text in ``out``, one row of flags for each order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rolled = np.zeros(len(codes), dtype=np.uint32)
    for n, row in zip(ORDERS, out, strict=True):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :]) * _MIX
        row[(rolled ^ (rolled >> np.uint32(15))) * _MIX >> np.uint32(32 - 13)] = True


def _vectors(flags: np.ndarray) -> np.ndarray:
    """Rows of norm 1: each order scaled to norm 1, then all by the root of the number of orders that have n-grams."""
    x = flags.astype(np.float32)
    sizes = x.sum(axis=2, keepdims=True)
    held = (sizes > 0).sum(axis=1, keepdims=True)
    x /= np.sqrt(np.maximum(sizes, 1) * np.maximum(held, 1))
    return x.reshape(len(x), -1)


@dataclass(frozen=True)
class Model:
    """Languages in the order of the columns of ``weights`` (hashed n-grams x languages)."""

    languages: tuple[str, ...]
    weights: np.ndarray


def _bits(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        packed = []
        for text in batch["text"]:
            flags = np.zeros((len(ORDERS), COLUMNS), dtype=bool)
            presence(text or "", flags)
            packed.append(np.packbits(flags).tobytes())
        yield {"doc_id": batch["doc_id"], "lang": batch["lang"], "bits": packed}


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """Packed presence sets of about ``per_language`` rows of each language and no more, spread by the hashes of their ids.

    The ids are chosen without reading texts, by the smallest hashes of each of ``SAMPLE_SLICES`` slices of a language, so
    that a language with most of the rows meets in no one task.
    """
    order = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_SLICES))).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(1, per_language // SAMPLE_SLICES))
    ids = ids.select("doc_id", "lang").distinct()
    picked = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])
    bits = over_batches(picked, _bits, schema).groupBy("doc_id", "lang").agg(F.min("bits").alias("bits"))
    return [(r["lang"], bytes(r["bits"])) for r in bits.orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()]


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from rows of ``docs`` that have an id, a text and a language.

    The sample, at most ``per_language`` rows for each of at most ``MOST_LABELS`` languages and 8,192 in all, is the only thing
    that reaches the driver. Without labelled rows the model knows no language.
    """
    labelled = docs.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    labels = [r["lang"] for r in labelled.groupBy("lang").count().limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not labels:
        return Model((), np.zeros((len(ORDERS) * COLUMNS, 0), dtype=np.float32))
    rows = sample(labelled, max(1, min(per_language, 8192 // len(labels))))
    languages = tuple(sorted({lang for lang, _ in rows}))
    flags = [np.unpackbits(np.frombuffer(b, dtype=np.uint8)).reshape(len(ORDERS), COLUMNS) for _, b in rows]
    seen: dict[str, int] = {}
    marks = []
    for n, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            marks.append(n)
    base = _vectors(np.array([flags[n] for n in marks]))
    kernel = np.concatenate([_vectors(np.array(flags[at : at + SCORED_AT_ONCE])) @ base.T for at in range(0, len(flags), SCORED_AT_ONCE)]).astype(np.float64)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ whiten
    target = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in rows])
    weight = 1.0 / np.array([seen[lang] for lang, _ in rows])[:, None]  # languages count alike
    beta = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]) * weight.sum() / len(rows), z.T @ (target * weight))
    return Model(languages, (base.T.astype(np.float64) @ (whiten @ beta)).astype(np.float32))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The best language of each text and its score; ``und`` and 0 for a text that is null or has no letter."""
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [n for n, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(known), SCORED_AT_ONCE):
        part = known[at : at + SCORED_AT_ONCE]
        flags = np.zeros((len(part), len(ORDERS), COLUMNS), dtype=bool)
        for row, n in zip(flags, part, strict=True):
            presence(texts[n], row)
        values = _vectors(flags) @ model.weights
        for n, row in zip(part, values, strict=True):
            best = int(row.argmax())
            names[n], scores[n] = model.languages[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``, from its whole text alone; one pass, no shuffle.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # columns x languages: fixed by the parameters

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            names, scores = score_texts(batch["text"], shared.value)
            yield {"doc_id": batch["doc_id"], "lang_pred": names, "score": scores}

    return over_batches(texts_of(docs), work, SCHEMA)


def keep_determined(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language; one pass, no shuffle.

    Only null texts and texts without a letter go. Scores never reject: a text with a letter is given the best language, and
    it stays as well when the model knows no language, since then nothing speaks against it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column("text").to_pylist()
                if shared.value.languages:
                    keep = [name != UNDETERMINED for name in score_texts(texts, shared.value)[0]]
                else:
                    keep = [has_letter(text) for text in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
