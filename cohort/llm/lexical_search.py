"""Ranked lexical search with pipelined term partitioning.

The terms of all items are dealt to owners by falling weight. Bundles of items travel from owner to owner and carry sparse
accumulators: an integer score for each item and document that can still be among the best. At each owner a bundle is
cogrouped with the postings of that owner's terms, adds their contributions, and goes on. Both sides are cut by document
into shards of bounded size, so a term that most documents hold is spread like any other.

Before an owner adds, an item's weakest wanted score so far and the most that the terms still to come can give are known.
A document that cannot reach the weakest wanted score any more is not carried on, which changes no result: owners with heavy,
rare terms come first, and when the frequent terms' turn comes few documents are left. Only scores that are certain to be
beaten by enough others go, so ties are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.operators.staging import stage

BEST = 10
OWNERS = (3000, 1500, 700, 0)  # the least weight of each owner's terms, in thousandths
ITEMS_IN_BUNDLE = 256
DOCUMENTS_IN_SHARD = 4096
SHIPPED_TERMS = 1 << 20  # so many terms of the items are known to the tasks that read texts; beyond, a join picks the postings

# Fixed values of the score: b = 0.75 and k1 = 0.8 in hundredths and thousandths.
SATURATION, FLAT, STEEP = 8, 25, 75

_OUT = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if c in set(_OUT) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A to Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


POSTINGS = pa.schema([("term", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("tf", pa.int64()), ("n", pa.int64())])
ITEM_TERMS = pa.schema([("item_id", pa.string()), ("term", pa.string()), ("times", pa.int64())])


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` (as text)``, term, times``; rows with the same id add up."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = [(i, t.decode(), n) for i, text in zip(batch["item_id"], batch["text"], strict=True) for t, n in Counter(terms_of(text)).items()]
            yield {name: [f[k] for f in found] for k, name in enumerate(ITEM_TERMS.names)}

    texts = items.filter("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text"))
    return over_batches(texts, work, ITEM_TERMS).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _postings(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """A row for each document and each of its terms (of those ``wanted``), and one without a term for each document that has any."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # at most SHIPPED_TERMS terms

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        needed = shared.value
        for batch in batches:
            terms, sizes, tfs, totals = [], [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                held = [(t, n) for t, n in Counter(found).items() if needed is None or t in needed] if found else []
                sizes.append(len(held) + bool(found))
                if found:
                    terms += [None, *[t.decode() for t, _ in held]]
                    tfs += [0, *[n for _, n in held]]
                totals.append(len(found))
            again = [np.repeat(np.array(batch[c] if c in batch else totals, dtype=np.int64), sizes) for c in ("row", "doc_id", "n")]
            yield {"term": terms, "row": again[0], "doc_id": again[1], "tf": tfs, "n": again[2]}

    numbered = texts_of(docs).filter("doc_id is not null").withColumn("row", F.monotonically_increasing_id())
    return over_batches(numbered, work, POSTINGS)


CARRIED = pa.schema([("bundle", pa.int32()), ("shard", pa.int64()), ("item", pa.binary()), ("row", pa.binary()), ("doc_id", pa.binary()), ("score", pa.binary()),
                     ("best", pa.list_(pa.struct([("item", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])))])


def _best_of(scores: np.ndarray, docs: np.ndarray, rows: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` highest scores above 0, equal ones by id."""
    some = np.flatnonzero(scores > 0)
    if len(some) > best:  # all that reach the weakest wanted score, ties included
        some = some[scores[some] >= np.partition(scores[some], len(some) - best)[len(some) - best]]
    return some[np.lexsort((rows[some], docs[some], -scores[some]))][:best]


def _at_owner(left: pa.Table, right: pa.Table, best: int) -> pa.Table:
    """One bundle and shard at one owner: the accumulators that came, with the postings added, and the best of each item."""
    if not left.num_rows:  # a term that no item of the bundle has; none is sent
        return CARRIED.empty_table()
    carrier = left.to_pylist()[0]
    items = {c: np.array([x[c] for x in carrier["items"]], dtype=np.int64) for c in ("item", "before", "after", "weakest")}
    order = np.argsort(items["item"])
    items = {c: v[order] for c, v in items.items()}
    state = {c: np.frombuffer(carrier[c] or b"", dtype=np.int64) for c in ("item", "row", "doc_id", "score")}
    code, row, doc, gain = (right.column(c).to_numpy() for c in ("code", "row", "doc_id", "gain"))

    rows, first = np.unique(np.concatenate((state["row"], row)), return_index=True)
    docs = np.concatenate((state["doc_id"], doc))[first]
    scores = np.zeros((len(items["item"]), len(rows)), dtype=np.int64)
    may = np.repeat((items["before"] >= items["weakest"])[:, None], len(rows), axis=1)  # whether a new document can still matter
    held = np.searchsorted(items["item"], state["item"]), np.searchsorted(rows, state["row"])
    scores[held], may[held] = state["score"], True

    by_code = np.argsort(code, kind="stable")
    at, gain, code = np.searchsorted(rows, row[by_code]), gain[by_code], code[by_code]
    asked = sorted((x["code"], x["item"], x["weight"]) for x in carrier["terms"] or [])
    codes = np.array([x[0] for x in asked], dtype=np.int64)
    places, weights = np.searchsorted(items["item"], [x[1] for x in asked]), np.array([x[2] for x in asked], dtype=np.int64)
    for one in np.unique(code):
        p, q = slice(*np.searchsorted(codes, [one, one + 1])), slice(*np.searchsorted(code, [one, one + 1]))
        scores[places[p][:, None], at[q][None, :]] += weights[p][:, None] * gain[q][None, :]

    scores[~may] = 0
    out, top = {c: [] for c in state}, []
    for n, item in enumerate(items["item"]):
        mine = _best_of(scores[n], docs, rows, best)
        top += [{"item": int(item), "row": int(rows[k]), "doc_id": int(docs[k]), "score": int(scores[n, k])} for k in mine]
        weakest = max(int(items["weakest"][n]), int(scores[n, mine[-1]]) if len(mine) == best else 0)
        keep = np.flatnonzero((scores[n] > 0) & (scores[n] + items["after"][n] >= weakest))
        for c, v in zip(out, (np.full(len(keep), item), rows[keep], docs[keep], scores[n, keep]), strict=True):
            out[c].append(v)
    packed = {c: np.concatenate(v or [np.zeros(0, np.int64)]).astype(np.int64).tobytes() for c, v in out.items()}
    return pa.Table.from_pylist([{"bundle": carrier["bundle"], "shard": carrier["shard"], **packed, "best": top}], schema=CARRIED)


def _ranked(carried: DataFrame, best: int) -> DataFrame:
    """``item, rank, doc_id, score``: the best of the best of all shards; each task passes on ``best`` rows an item at most."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    return carried.select(F.explode("best").alias("b")).select("b.*").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _gain(n_docs: int, n_terms: int) -> Column:
    return F.expr(f"(1000000000L * tf) div (1000L * tf + {SATURATION}L * ({FLAT}L + ({STEEP}L * n * {n_docs}L) div {n_terms}L))")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents of each item with a score above 0, ranked from 1.

    Equal scores rank by ascending ``doc_id``. Every row of ``docs`` with an id is a document of its own, also where ids
    repeat; rows without one, null or empty texts and texts without terms are in no result and no statistic. Rows of
    ``items`` with the same id are one item, whose terms add up; rows without an id are none. Items without terms, or whose
    terms no document has, have no rows. Other columns of both tables are not read.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    asked = stage(_item_terms(items))
    vocabulary = stage(asked.select("term").distinct())
    small = vocabulary.count() <= SHIPPED_TERMS
    seen = stage(_postings(docs, frozenset(r["term"].encode() for r in vocabulary.toLocalIterator()) if small else None))
    sizes = seen.filter("term is null").agg(F.count("n").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).head()
    numbers = stage(asked.select("item_id").distinct()).withColumn("item", F.monotonically_increasing_id())

    # One row for each term that occurs: its number, weight, owner and the largest gain of any document.
    gained = seen.filter("term is not null").withColumn("gain", _gain(sizes["docs"], sizes["terms"]))
    heard = gained.groupBy("term").agg(F.count("gain").alias("df"), F.max("gain").alias("most")).join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log((2.0 * sizes["docs"] + 2) / (2 * F.col("df") + 1)))
    owner = F.lit(0)
    for least in OWNERS[:-1]:
        owner = owner + (F.col("weight") < least).cast("int")
    terms = stage(heard.withColumn("weight", weight).select("term", "most", "weight", owner.alias("owner"))).withColumn("code", F.monotonically_increasing_id())

    bundles = max(1, -(-numbers.count() // ITEMS_IN_BUNDLE))
    shards = max(1, -(-sizes["docs"] // DOCUMENTS_IN_SHARD))
    bundle = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int")
    wanted = stage(asked.join(numbers, "item_id").join(terms, "term").select(
        bundle.alias("bundle"), "item", "code", "owner", (F.col("weight") * F.col("times")).alias("weight"), (F.col("weight") * F.col("times") * F.col("most")).alias("most")))
    before = [F.coalesce(F.sum(F.when(F.col("owner") >= n, F.col("most"))), F.lit(0)).alias(f"from_{n}") for n in range(len(OWNERS) + 1)]
    bounds = stage(wanted.groupBy("bundle", "item").agg(*before))
    places = stage(gained.join(terms, "term").select("owner", "code", "row", "doc_id", "gain", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")))

    empty = [F.lit(None).cast("binary").alias(c) for c in ("item", "row", "doc_id", "score")]
    carried = bounds.select("bundle").distinct().select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), *empty)
    weakest = None
    for n in range(len(OWNERS)):
        lines = bounds.withColumn("weakest", F.lit(1).cast("long")) if weakest is None else bounds.join(weakest, "item", "left").fillna({"weakest": 1})
        about = lines.groupBy("bundle").agg(F.collect_list(F.struct("item", F.col(f"from_{n}").alias("before"), F.col(f"from_{n + 1}").alias("after"), "weakest")).alias("items"))
        own = wanted.filter(F.col("owner") == n)
        terms_here = own.groupBy("bundle").agg(F.collect_list(F.struct("code", "item", "weight")).alias("terms"))
        left = carried.select("bundle", "shard", "item", "row", "doc_id", "score").join(about.join(terms_here, "bundle", "left"), "bundle")
        right = places.filter(F.col("owner") == n).join(own.select("code", "bundle").distinct(), "code").select("bundle", "shard", "code", "row", "doc_id", "gain")
        carried = stage(left.groupBy("bundle", "shard").cogroup(right.groupBy("bundle", "shard")).applyInArrow(
            lambda a, b: _at_owner(a, b, best), "bundle int, shard long, item binary, row binary, doc_id binary, score binary, best array<struct<item:long,row:long,doc_id:long,score:long>>"))
        weakest = _ranked(carried, best).filter(F.col("rank") == best).select("item", F.col("score").alias("weakest"))
    found = _ranked(carried, best).join(numbers, "item")
    return found.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
