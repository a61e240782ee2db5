"""Self-join of documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

A document is the set of its shingle hashes in ascending order. Of a linked pair, the first ``l`` common shingles lie in the
first ``n - need + l`` shingles of both (``need``: the shingles that any partner must share). The join starts from a short
prefix with a requirement of some matches, which screens out nearly all documents. For the rest, shingles that many
documents hold are costly to match: each document lengthens its prefix until more matches are required than it has costly
shingles in the prefix, so that costly ones need not be matched at all.

Documents made almost only of costly shingles, such as large groups of near copies, never get there. They are compared
through their differences from one document of their group: what all share cancels out, links that follow from small
differences alone become a star, and other links must share something in the differences, which is matched as before,
group by group, until no costly shingles remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.words import mixed, signed, window_hashes, word_hashes
from cohort.operators.graph import components
from cohort.operators.staging import stage

SHINGLE = 3
PERCENT = 90
COSTLY = 50  # a shingle that more documents hold is costly
MATCH_SHARE = 20  # the screening prefix requires one match, and one more for each so many shingles
ROUNDS = 4  # of differences; costly lists that are left then are matched in full


@dataclass(frozen=True)
class Rule:
    """Which sets link: ``100 * intersection >= percent * union``."""

    shingle: int = SHINGLE
    percent: int = PERCENT

    def need(self, n: int) -> int:
        """Shingles that any partner of a set of ``n`` must share with it, which is also the least size of a partner."""
        return -(-self.percent * n // 100)

    def matches(self, n: int) -> int:
        """Matches that the screening prefix of a set of ``n`` requires."""
        return min(1 + n // MATCH_SHARE, self.need(n))

    def links(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def shingles(self, text: str | None) -> np.ndarray:
        words = word_hashes(text or "", lower=True)
        return np.unique(window_hashes(words, min(self.shingle, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


SCREEN = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("c2", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("c2", pa.int64()), ("tokens", pa.binary()), ("loads", pa.binary())])
CANDIDATES = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("least", pa.int32()), ("open", pa.bool_())])
DIFFERENCES = pa.schema([("family", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("gone", pa.int32()), ("base", pa.int32()), ("added", pa.binary()), ("removed", pa.binary())])
OPEN = 1 << 30  # the requirement of a document that no prefix serves


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    both = (mixed(tokens).sum(dtype=np.uint64), mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return tuple(int(signed(np.array([x]))[0]) for x in both)


def screen(docs: DataFrame, rule: Rule) -> DataFrame:
    """A row per document with the hash of its set (``h, c2``), and a row per shingle of its screening prefix (``c2`` null)."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            ids, sizes, hashes, second = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = rule.shingles(text)
                n = len(tokens)
                prefix = tokens[: n - rule.need(n) + rule.matches(n)] if doc_id is not None else tokens[:0]
                first, other = _set_hash(tokens)
                ids += [doc_id] * (1 + len(prefix))
                sizes += [n] * (1 + len(prefix))
                hashes += [first, *signed(prefix).tolist()]
                second += [other] + [None] * len(prefix)
            yield {"doc_id": ids, "n": sizes, "h": hashes, "c2": second}

    return over_batches(texts_of(docs), work, SCREEN)


def _loads(tokens: np.ndarray) -> bytes:
    """How many shingles fall on each of about n / 2 places; empty if one byte cannot say it."""
    size = 1 << max(4, (len(tokens) // 2).bit_length())
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 255 else b""


def sets_of(docs: DataFrame, rule: Rule) -> DataFrame:
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            sets = [rule.shingles(text) for text in batch["text"]]
            hashes = [_set_hash(s) for s in sets]
            yield {"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "h": [h for h, _ in hashes], "c2": [c for _, c in hashes], "tokens": [s.tobytes() for s in sets], "loads": [_loads(s) for s in sets]}

    return over_batches(docs.select("doc_id", "text"), work, SETS)


def _unpacked(sets: DataFrame, *more: str) -> DataFrame:
    """A row for each shingle of ``tokens``: ``h``, ``doc_id`` and other long or boolean columns."""
    names = ["doc_id", *more]
    kinds = {n: pa.bool_() if kind == "boolean" else pa.int64() for n, kind in sets.dtypes}

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            sizes = [len(t) // 8 for t in batch["tokens"]]
            yield {"h": np.frombuffer(b"".join(batch["tokens"]), dtype=np.int64), **{n: np.repeat(np.array(batch[n], dtype=kinds[n].to_pandas_dtype()), sizes) for n in names}}

    return over_batches(sets.select(*names, "tokens"), work, pa.schema([("h", pa.int64()), *[(n, kinds[n]) for n in names]]))


def _adapted(sets: DataFrame, rule: Rule) -> DataFrame:
    """Shingles to match, by document: those of its lengthened prefix that are not costly, and the matches it requires.

    ``costly`` holds the document's costly shingles. If no prefix requires more matches than it has costly shingles, the
    document is ``open``: all its other shingles are given, for partners whose own prefix serves.
    """

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            hashes, ids, sizes, least, opened = [np.zeros(0, np.int64)], [], [], [], []
            for doc_id, n, packed, costly in zip(batch["doc_id"], batch["n"], batch["tokens"], batch["costly"], strict=True):
                tokens = np.frombuffer(packed, dtype=np.int64)
                dear = np.isin(tokens, np.array(costly or [], dtype=np.int64))
                need, dears = rule.need(n), np.cumsum(dear)
                required = np.arange(1, n + 1) - (n - need)  # matches that a prefix of each length requires
                serves = np.flatnonzero((required >= rule.matches(n)) & (required > dears))
                end = int(serves[0]) + 1 if len(serves) else n
                some = tokens[:end][~dear[:end]]
                hashes.append(some)
                ids += [doc_id] * len(some)
                sizes += [n] * len(some)
                least += [int(required[end - 1] - dears[end - 1]) if len(serves) else OPEN] * len(some)
                opened += [not len(serves)] * len(some)
                if not len(serves):  # one row at least, to name it
                    hashes.append(tokens[:1])
                    ids, sizes, least, opened = [*ids, doc_id], [*sizes, n], [*least, OPEN], [*opened, True]
            yield {"h": np.concatenate(hashes), "doc_id": ids, "n": sizes, "least": least, "open": opened}

    return over_batches(sets, work, CANDIDATES)


def _pairs(rows: DataFrame, key: list[str], rule: Rule, both: str) -> DataFrame:
    """Pairs of rows with the same key, of fitting sizes, that meet the condition ``both`` on ``a`` and ``b``."""
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    fits = F.expr(f"a.doc_id < b.doc_id and 100 * a.n >= {rule.percent} * b.n and 100 * b.n >= {rule.percent} * a.n and {both}")
    return a.join(b, [*same, fits])


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``x, y`` that link. Loads, a small part of the sets, rule most of the others out before sets are moved."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def both(of: DataFrame, column: str) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col(column).alias("of_x"))
        y = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col(column).alias("of_y"))
        return of.join(x, "x").join(y, "y")

    def may_link(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            keep = []
            for n, m, a, b in zip(batch["nx"], batch["ny"], batch["of_x"], batch["of_y"], strict=True):
                if not a or not b:
                    keep.append(True)
                    continue
                p, q = np.frombuffer(a, dtype=np.uint8).astype(np.int64), np.frombuffer(b, dtype=np.uint8).astype(np.int64)
                size = min(len(p), len(q))
                most = np.minimum(p.reshape(-1, size).sum(axis=0), q.reshape(-1, size).sum(axis=0)).sum()
                keep.append(rule.links(int(most), n, m))
            yield {c: [v for v, k in zip(batch[c], keep, strict=True) if k] for c in ("x", "y")}

    def do_link(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            keep = []
            for n, m, a, b in zip(batch["nx"], batch["ny"], batch["of_x"], batch["of_y"], strict=True):
                common = np.intersect1d(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), assume_unique=True)
                keep.append(rule.links(len(common), n, m))
            yield {c: [v for v, k in zip(batch[c], keep, strict=True) if k] for c in ("x", "y")}

    likely = stage(over_batches(both(pairs, "loads"), may_link, schema))
    return over_batches(both(likely, "tokens"), do_link, schema)


def _costly(tokens: DataFrame, key: list[str]) -> DataFrame:
    return tokens.groupBy(*key).agg(F.count(F.lit(1)).alias("_held"), F.min("doc_id").alias("_leader")).filter(F.col("_held") > COSTLY)


def links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges ``src, dst`` that span the groups of linked representatives; ``doc_id, rep``; and ``doc_id, n_shingles`` of each row.

    ``rep`` is the smallest document with the same set, null without words; copies follow their representatives.
    """
    docs = texts_of(docs)
    seen = stage(screen(docs, rule))
    whole = seen.filter("c2 is not null")
    named = whole.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", "c2", "n")).alias("set"), F.count(F.lit(1)).alias("rows"))
    reps = named.filter("set.n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    named = stage(named.join(reps, "set", "left"))
    own = named.filter("doc_id = rep").select("doc_id")

    tokens = seen.filter("c2 is null").select("doc_id", "n", "h")
    common = tokens.groupBy("h").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("h")
    shared = stage(tokens.join(common, "h").join(own, "doc_id", "left_semi"))
    again = shared.groupBy("h").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("h")
    least = F.expr(f"least(1 + ceil({rule.percent} * n / 100) div {MATCH_SHARE}, ceil({rule.percent} * ceil({rule.percent} * n / 100) / 100))")
    met = shared.join(again, "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_met"), F.min("n").alias("n")).filter(F.col("_met") >= least)
    sets = sets_of(docs.join(met.select("doc_id"), "doc_id"), rule)
    if not named.filter("rows > 1").isEmpty():
        sets = sets.join(named.select("doc_id", "set.h", "set.c2"), ["doc_id", "h", "c2"], "left_semi").dropDuplicates(["doc_id"])
    sets = stage(sets)

    held = _unpacked(sets)
    costly = stage(_costly(held, ["h"]))
    dear = stage(held.join(costly.select("h", "_leader"), "h"))
    mine = dear.groupBy("doc_id").agg(F.collect_set("h").alias("costly"))
    rows = stage(_adapted(sets.select("doc_id", "n", "tokens").join(mine, "doc_id", "left"), rule))
    met_twice = _pairs(rows, ["h"], rule, "not (a.open and b.open)").groupBy(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"))
    pairs = met_twice.agg(F.count(F.lit(1)).alias("_met"), F.min(F.least("a.least", "b.least")).alias("_least")).filter("_met >= _least").select("x", "y")
    edges = [verified(pairs, sets, rule)]

    few = rows.filter("open").select("doc_id", F.lit(0).cast("long").alias("origin"), F.expr(f"n - ({rule.percent} * n + 99) div 100").alias("spare")).distinct()
    opened = stage(dear.join(few, "doc_id"))
    if not opened.isEmpty():
        edges += _by_differences(opened, sets, rule)
    every = reduce(DataFrame.unionByName, edges).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return every, named.select("doc_id", "rep"), whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"))


def _families(members: DataFrame) -> DataFrame:
    """``doc_id, family, _dear``: the families that each document needs, and how many costly shingles it has there.

    ``members`` has for each ``doc_id``, costly shingle ``h`` and ``origin`` the first holder ``_leader``, which names a family. A
    partner lacks at most ``spare`` of the shingles that a document has in the origin where the two are to meet. With all costly
    shingles in one order, largest families first, the first that two partners have in common is therefore among the first
    ``spare + 1`` of both, and families behind these are not needed.
    """
    found = members.groupBy("origin", "doc_id", F.col("_leader").alias("family")).agg(F.count(F.lit(1)).alias("_dear"), F.min("spare").alias("spare"))
    found = found.join(found.groupBy("family").agg(F.sum("_dear").alias("_weight")), "family")
    before = Window.partitionBy("origin", "doc_id").orderBy(F.desc("_weight"), "family").rowsBetween(Window.unboundedPreceding, -1)
    needed = found.withColumn("_before", F.coalesce(F.sum("_dear").over(before), F.lit(0))).filter("_before <= spare")
    return needed.groupBy("doc_id", "family").agg(F.sum("_dear").alias("_dear"))


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The difference of each member from the centre of its family: the member that has most costly shingles for its size.

    A family is whoever holds a costly shingle with the same first holder; so two documents with a common costly shingle
    meet in a family, and as most shingles of a group have the same first holder, a document needs few families.
    """
    in_family = stage(_families(members).join(sets.select("doc_id", "n"), "doc_id"))
    centres = in_family.groupBy("family").agg(F.max(F.struct((F.col("_dear") / F.col("n")).alias("share"), (-F.col("doc_id")).alias("id"))).alias("_top"))
    centre_sets = centres.select("family", (-F.col("_top.id")).alias("doc_id")).join(sets.select("doc_id", F.col("tokens").alias("centre")), "doc_id").drop("doc_id")
    joined = in_family.select("family", "doc_id").join(sets.select("doc_id", "n", "tokens"), "doc_id").join(centre_sets, "family")

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in DIFFERENCES}
            for family, doc_id, n, own, centre in zip(*[batch[c] for c in ("family", "doc_id", "n", "tokens", "centre")], strict=True):
                x, c = np.frombuffer(own, dtype=np.uint64), np.frombuffer(centre, dtype=np.uint64)
                added, removed = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                for name, value in zip(out, (family, doc_id, n, len(removed), len(c), added.tobytes(), removed.tobytes()), strict=True):
                    out[name].append(value)
            yield out

    return over_batches(joined, work, DIFFERENCES)


def _by_differences(members: DataFrame, sets: DataFrame, rule: Rule) -> list[DataFrame]:
    """Edges among documents made of costly shingles.

    With ``gone`` centre shingles missing from x and from y, and ``o`` shingles common to their differences, x and y share
    ``base - gone(x) - gone(y) + o``. So they link if and only if ``f(x) + f(y) - k <= (100 + percent) * o`` where
    ``f = percent * n + (100 + percent) * gone`` and ``k = (100 + percent) * base``:

    * without any common difference if ``f(x) + f(y) <= k``; then both link to the member with the smallest ``f`` too;
    * by removed shingles alone only if ``f(x) + percent * n(y) <= k`` and the same the other way round, which for an x that
      is not in the star needs a y with ``percent * n(y)`` below the smallest ``f``, and the smallest n as a partner at best;
    * otherwise they share added shingles: all of ``o`` but the removed ones, of which there are at most the smaller ``gone``.
      With the added shingles that others of the family hold too in one order, rarest first, the first common one has at
      least so many left, itself counted, in both lists. Places behind that are not matched, and shingles of one holder
      never move. If the first common one is costly, so are all, and the pair meets in a family of the next round, in which
      a document takes part with no more of them than it takes to meet all partners.
    """
    p, q = rule.percent, 100 + rule.percent
    # What any partner of a row must share with it in added shingles; a partner of a row of the star is outside the star.
    smallest = f"greatest(({p} * n + 99) div 100, least_n)"  # of its partners' sizes
    alone = f"greatest({p} * n + if(star, k - least_f + 1, least_f), f + {p} * {smallest}) - k"
    needs = f"greatest(1, (a.f + b.f - a.k + {q - 1}) div {q} - least(a.gone, b.gone))"
    edges: list[DataFrame] = []
    for turn in range(ROUNDS):
        differences = stage(_differences(members, sets))
        values = differences.select("family", "doc_id", "n", "gone", (p * F.col("n") + q * F.col("gone")).cast("long").alias("f"), (q * F.col("base")).cast("long").alias("k"))
        first = values.groupBy("family").agg(F.min(F.struct("f", "doc_id")).alias("_first"), F.min("n").alias("least_n"))
        values = values.join(first, "family").withColumn("star", F.col("f") + F.col("_first.f") <= F.col("k"))
        values = stage(values.select("family", "doc_id", "n", "gone", "f", "k", "star", "least_n", F.col("_first.f").alias("least_f"), F.col("_first.doc_id").alias("first")))
        edges.append(values.filter("star and doc_id <> first").select(F.col("doc_id").alias("x"), F.col("first").alias("y")))

        def listed(column: str, among: DataFrame, differences: DataFrame = differences) -> DataFrame:
            packed = differences.select("doc_id", "family", F.col(column).alias("tokens")).join(among.drop("first"), ["doc_id", "family"])
            return _unpacked(packed, *[c for c in among.columns if c not in ("doc_id", "first")])

        removed = stage(listed("removed", values.filter(f"f + {p} * {smallest} <= k and (not star or {p} * n < least_f)")))
        by_removed = _pairs(removed, ["family", "h"], rule, f"not (a.star and b.star) and a.f + {p} * b.n <= a.k and b.f + {p} * a.n <= a.k")
        added = stage(listed("added", values))
        held = added.groupBy("family", "h").agg(F.count(F.lit(1)).alias("_held"), F.min("doc_id").alias("_leader")).filter("_held > 1")
        from_last = Window.partitionBy("family", "doc_id").orderBy(F.desc("_held"), F.desc("h"))
        ranked = added.join(held, ["family", "h"]).withColumn("left", F.row_number().over(from_last))
        ranked = ranked.withColumn("least", F.expr(f"greatest(1, ({alone} + {q - 1}) div {q})"))
        costly = F.col("_held") > (COSTLY if turn + 1 < ROUNDS else OPEN)
        ranked = stage(ranked.filter((F.col("left") >= F.col("least")) | costly))
        by_added = _pairs(ranked.filter(~costly), ["family", "h"], rule, f"not (a.star and b.star) and least(a.left, b.left) >= {needs}")
        pairs = by_removed.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).unionByName(by_added.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")))
        edges.append(verified(pairs.distinct(), sets, rule))
        # A partner that is met by no other shingle shares ``least`` costly ones.
        own = Window.partitionBy("family", "doc_id")
        members = ranked.filter(costly).withColumn("spare", F.count(F.lit(1)).over(own) - F.col("least")).filter("spare >= 0")
        members = members.select("doc_id", "h", "_leader", F.col("family").alias("origin"), "spare")
        if members.isEmpty():
            break
    return edges


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A to Z lower-cased; a set holds the distinct runs of ``shingle`` words, or of all
    words if there are fewer. Two documents link if ``100 * intersection >= percent * union``; the component is the smallest
    id that links reach. Documents without words link with nothing. Rows without an id have no component; rows that share an
    id are one document, which links by the one of their sets that has the smallest hash.
    """
    edges, named, rows = links(docs, Rule(shingle, percent))
    found = components(edges, named.filter("doc_id = rep").select(F.col("doc_id").alias("node")))
    found = found.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    named = named.join(found, "rep", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.join(named, "doc_id", "left").select("doc_id", "n_shingles", "component_id")
