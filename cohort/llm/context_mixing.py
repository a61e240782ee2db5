"""Language-model scores of texts by logistic context mixing.

A text is the bytes of its UTF-8 form and an end mark. Bytes are taken apart into yes/no decisions along a prefix code of
the corpus's byte counts, so a frequent byte costs few. For every decision several predictors look up what followed the
same context in the corpus, each in a hashed table of counters: the last one, two or four bytes of the piece, and
the whole piece so far. A piece ends with the first blank, or after ``LONGEST`` bytes, so all contexts are known before the byte.

The predictors' log odds are summed with weights that a gate chooses by how often the two longest contexts were seen. There
are two sets of weights, one for texts whose bytes the prefix code makes shorter than the corpus's mean and one for the others.
Each is fitted to every decision of all its training texts by Newton's method, with the decision's own count taken out of the
counters. A text is predicted by all sets, and their shares are refined with every decision by how well each has done in that
text so far. The sum of the decisions' costs is the text's length in bits.

These contexts do not reach beyond a piece, so the training texts are first summed up to distinct pieces and their numbers, and
counters and weights learn from these. Tasks pack what they counted by table and stretch of slots, and the packs are added in
rounds of bounded groups. The tables have a fixed size whatever the corpus.

Beyond a piece, texts are sequences of phrases of some pieces, and the context of a phrase is the phrase before it, or the text's
start. With n training phrases after the same one, k kinds of them and m the same, a phrase to whose pieces the decisions give
probability p has (m + k * p) / (n + k), as Witten and Bell have it, the phrase itself taken out of the counts. Nothing is hashed into
tables of fixed size there: all phrases of all texts are dealt by their context, and each text gets back what its phrases gain.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cohort.llm.batches import over_batches
from cohort.llm.words import mixed, powers
from cohort.operators.staging import stage

ORDERS = (1, 2, 4)  # contexts of so many bytes; the last table is of the piece so far
TABLE_BITS = (16, 18, 21, 22)
PREFIX, GATING = len(ORDERS), len(ORDERS) - 1  # the contexts whose trust chooses the gate
LONGEST = 64
BLOCK = 1 << 16  # slots packed together
FAN_IN = 32  # packs that one group adds
TEXT_AT_ONCE = 3 << 20  # bytes of texts whose distinct pieces are looked up together
PIECES_AT_ONCE = 1 << 12
FREQUENT = 1 << 17  # words whose counts every scoring task knows; the rest are joined
PRICED = 1 << 18  # pieces whose costs every scoring task knows; only speed hangs on it
KEPT = 1 << 19  # distinct pieces that a counting task sums up before it hands them on
SETS, GATES = 2, 16  # of weights
PHRASE, MOST = 3, 16  # one in so many names ends a phrase; pieces that a phrase has at most
SHARES = 1 << 10  # of contexts; those of a share are counted together
KIND_BITS = 24  # of a phrase's name beside its context's
GRAIN = 1 << 20  # of a nat; sums of whole grains do not hang on their order
START, STEPS, LONGEST_STEP = 0.3, 3, 0.5  # of Newton's method; a weight counts as if met once at START
END = b"\xff"  # no byte of UTF-8

_HASH, _NODE, _MULTIPLIER = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed random table
_POWERS = powers(_MULTIPLIER, LONGEST)
_BLANKS = frozenset((9, 10, 11, 12, 13, 32, 255))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*_BLANKS]] = True
_PRIOR = 0.4
_STEP = 16.0  # of a stored log odds


@dataclass
class Cut:
    """Distinct pieces in the order of their names, and the numbers of those that each text is made of; text n has ``which[first[n]:first[n + 1]]``."""

    pieces: list[bytes]
    which: np.ndarray
    first: np.ndarray
    names: np.ndarray


def cut_texts(encoded: list[bytes]) -> Cut:
    """The pieces of each text, which with an end mark make up all its bytes.

    A piece ends after a blank, after ``LONGEST`` bytes, or with the end mark.
    """
    raw = END.join([*encoded, b""])
    values = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(_BLANK[values]) + 1
    starts = np.concatenate((np.zeros(1, dtype=np.int64), ends[:-1]))[: len(ends)]
    sizes = ends - starts
    if int(sizes.max(initial=0)) > LONGEST:
        parts = -(-sizes // LONGEST)
        before = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = np.repeat(starts, parts) + before * LONGEST, np.minimum(np.repeat(sizes, parts) - before * LONGEST, LONGEST)
    inside = (np.arange(len(values), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)).astype(np.uint8)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    terms = _RANDOM[values]  # np.take would make 64-bit places of all bytes first
    terms *= _POWERS[inside]
    np.cumsum(terms, out=sums[1:])
    del terms, inside
    names = mixed(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))
    del sums
    order = np.argsort(names)
    names = names[order]
    new = np.concatenate((np.ones(min(1, len(names)), dtype=bool), names[1:] != names[:-1]))
    which = np.empty(len(names), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    at = order[new]
    pieces = [raw[i:j] for i, j in zip(starts[at].tolist(), (starts + sizes)[at].tolist(), strict=True)]
    text_ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.zeros(0, dtype=np.int64)
    return Cut(pieces, which, np.concatenate(([0], np.searchsorted(starts, text_ends, "left"))), names[new])


def names_of(pieces: list[bytes]) -> np.ndarray:
    """The names that ``cut_texts`` gives to pieces."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(np.take(_RANDOM, raw) * np.take(_POWERS, np.arange(len(raw)) - np.repeat(starts, sizes)), dtype=np.uint64)))
    return mixed(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64))


def words_of(pieces: list[bytes]) -> list[bytes | None]:
    """The lower-cased word of each piece: empty for a blank or the end, None for a piece without either, which is part of a longer word."""
    return [p[:-1].lower() if p[-1] in _BLANKS else None for p in pieces]


def long_words(cut: Cut, words: list[bytes | None]) -> np.ndarray:
    """Whether each text has a word of more than one piece; its words are then read from the text itself."""
    part = np.array([w is None for w in words], dtype=bool)
    return np.diff(np.concatenate(([0], np.cumsum(part[cut.which])))[cut.first]) > 0


def _in_parts(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """The rows, with their texts in UTF-8, in lists of about ``TEXT_AT_ONCE`` bytes."""
    part: dict[str, list] = {}
    size = 0
    for batch in batches:
        batch["text"] = [(t or "").encode() for t in batch["text"]]
        for name, column in batch.items():
            part.setdefault(name, []).extend(column)
        size += sum(map(len, batch["text"]))
        if size >= TEXT_AT_ONCE:
            yield part
            part, size = {}, 0
    if part:
        yield part


@dataclass(frozen=True)
class Code:
    """A prefix code: of each byte the number of decisions, and of each decision its node and answer (bytes x most decisions)."""

    size: np.ndarray
    node: np.ndarray
    answer: np.ndarray


def code_of(counts: list[int]) -> Code:
    """The Huffman code of byte counts; bytes that were never seen count as one."""
    queue: list[tuple[int, int, Any]] = [(c + 1, n, n) for n, c in enumerate(counts)]
    heapq.heapify(queue)
    for n in range(255):
        a, b = heapq.heappop(queue), heapq.heappop(queue)
        heapq.heappush(queue, (a[0] + b[0], 256 + n, (n, a[2], b[2])))
    paths: dict[int, list[tuple[int, int]]] = {}
    open_nodes = [(queue[0][2], [])]
    while open_nodes:
        tree, path = open_nodes.pop()
        if isinstance(tree, int):
            paths[tree] = path
        else:
            open_nodes += [(tree[1], [*path, (tree[0], 0)]), (tree[2], [*path, (tree[0], 1)])]
    size = np.array([len(paths[b]) for b in range(256)])
    node, answer = np.zeros((256, size.max()), dtype=np.uint32), np.zeros((256, size.max()), dtype=np.uint8)
    for b, path in paths.items():
        for d, (n, bit) in enumerate(path):
            node[b, d], answer[b, d] = n + 1, bit
    return Code(size, node * _NODE, answer)


@dataclass
class Decisions:
    """The decisions of pieces, one piece after another: the first of each piece, and by decision the answer and its slot in each table."""

    begin: np.ndarray
    answer: np.ndarray
    slots: list[np.ndarray]


def _folded(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def decisions_of(pieces: list[bytes], code: Code) -> Decisions:
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(raw)) - np.repeat(starts, sizes)

    # Of the piece so far: sum of byte * multiplier ** place.
    values = np.take(_RANDOM, raw) * np.take(_POWERS, inside)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)[:-1]))
    so_far = _folded(sums - np.repeat(sums[starts], sizes) + np.uint64(7))
    contexts, h = [], np.zeros(len(raw), dtype=np.uint64)
    for back in range(1, max(ORDERS) + 1):
        before = np.zeros(len(raw), dtype=np.uint64)
        before[back:] = raw[:-back]
        h = h * np.uint64(0x100000001B3) + np.where(inside >= back, before + np.uint64(1), np.uint64(0))
        if back in ORDERS:
            contexts.append(_folded(h + np.uint64(back << 58)))
    contexts.append(so_far)

    many = code.size[raw]
    ends = np.cumsum(many)
    depth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
    place = np.repeat(raw.astype(np.int64) * code.node.shape[1], many) + depth
    node = np.take(code.node, place)
    slots = [((np.repeat(c, many) + node) * _HASH) >> np.uint32(32 - bits) for c, bits in zip(contexts, TABLE_BITS, strict=True)]
    return Decisions((ends - many)[starts], np.take(code.answer, place), slots)


# Counting


def _pack(counts: np.ndarray) -> bytes:
    """Counts ``slots x 2``; only slots that have any."""
    at = np.flatnonzero(counts.any(axis=1))
    return zstandard.compress(struct.pack("<I", len(at)) + at.astype(np.uint16).tobytes() + counts[at].T.astype(np.uint64 if counts.max() >> 32 else np.uint32).tobytes(), 1)


def _unpack(packed: bytes, out: np.ndarray) -> None:
    raw = zstandard.decompress(packed)
    n = struct.unpack_from("<I", raw)[0]
    at = np.frombuffer(raw, dtype=np.uint16, count=n, offset=4)
    kind = np.uint32 if len(raw) == 4 + 10 * n else np.uint64
    out[at] += np.frombuffer(raw, dtype=kind, count=2 * n, offset=4 + 2 * n).reshape(2, n).T.astype(np.int64)


PIECES = pa.schema([("piece", pa.binary()), ("whole", pa.bool_()), *[(f"times{k}", pa.int64()) for k in range(SETS)], ("said", pa.int64())])
GATHERED = pa.schema([("word", pa.string()), ("count", pa.int64()), ("block", pa.int64()), ("part", pa.int64()), ("packed", pa.binary())])


def _pieces(learnt: DataFrame, code: Code, counts: list[int]) -> DataFrame:
    """The distinct pieces of all texts, and how often each occurs in texts of each set, and as a word (``said``).

    Rows with ``whole`` are words of the texts that have words of more than one piece.
    """
    sizes = code.size.astype(np.uint8)
    in_all, bits_in_all = sum(counts), int((np.array(counts) * code.size).sum())

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        index: dict[bytes, int] = {}
        sums = np.zeros((KEPT, SETS + 1), dtype=np.int64)

        def rows() -> dict[str, list]:
            n = len(index)
            return {"piece": list(index), "whole": [False] * n, **{f"times{k}": sums[:n, k] for k in range(SETS)}, "said": sums[:n, SETS]}

        for batch in _in_parts(batches):
            cut = cut_texts(batch["text"])
            if len(index) + len(cut.pieces) > len(sums):
                yield rows()
                index, sums = {}, np.zeros((max(KEPT, len(cut.pieces)), SETS + 1), dtype=np.int64)
            bits = [int(np.take(sizes, np.frombuffer(t + END, dtype=np.uint8)).sum(dtype=np.int64)) for t in batch["text"]]
            costly = np.array([b * in_all > bits_in_all * (len(t) + 1) for b, t in zip(bits, batch["text"], strict=True)])
            long = long_words(cut, words_of(cut.pieces))
            of, plain = (np.repeat(flags, np.diff(cut.first)) for flags in (costly, ~long))
            at = np.array([index.setdefault(p, len(index)) for p in cut.pieces], dtype=np.int64)
            for k, some in enumerate((~of, of, plain)):
                sums[at, k] += np.bincount(cut.which[some], minlength=len(cut.pieces))
            if long.any():
                total: Counter[bytes] = Counter()
                for n in np.flatnonzero(long):
                    total.update(batch["text"][n].lower().split())
                zeros = [0] * len(total)
                yield {"piece": list(total), "whole": [True] * len(total), **{f"times{k}": zeros for k in range(SETS)}, "said": list(total.values())}
        yield rows()

    return over_batches(learnt, work, PIECES).groupBy("piece", "whole").agg(*[F.sum(c).alias(c) for c in PIECES.names[2:]])


def _gather(pieces: DataFrame, code: Code) -> DataFrame:
    """What each task counts: rows ``word, count`` of lower-cased words, and rows ``block, part, packed`` of counters."""
    offsets = np.cumsum([0, *[1 << b for b in TABLE_BITS]])

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        counters = np.zeros((offsets[-1], 2), dtype=np.int64)
        part = TaskContext.get().partitionId()

        def rows(out: list[tuple]) -> dict[str, list]:
            return {name: [r[k] for r in out] for k, name in enumerate(GATHERED.names)}

        for batch in _many(batches):
            some = [p for p, whole in zip(batch["piece"], batch["whole"], strict=True) if not whole]
            words = iter(words_of(some))
            words = [p if whole else next(words) for p, whole in zip(batch["piece"], batch["whole"], strict=True)]
            yield rows([(w.decode(), n, None, None, None) for w, n in zip(words, batch["said"], strict=True) if w and n])
            times = np.array([batch[f"times{k}"] for k in range(SETS)]).sum(axis=0)[~np.array(batch["whole"], dtype=bool)]
            d = decisions_of(some, code)
            times = np.repeat(times, np.diff(d.begin, append=len(d.answer)))
            for t, slots in enumerate(d.slots):
                np.add.at(counters.reshape(-1), slots * np.uint32(2) + (d.answer + np.uint32(2 * offsets[t])), times)
        for block in np.unique(np.flatnonzero(counters.any(axis=1)) // BLOCK):
            yield rows([(None, None, int(block), part, _pack(counters[block * BLOCK : (block + 1) * BLOCK]))])

    return over_batches(pieces, work, GATHERED)


def _many(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """The rows in lists of about ``PIECES_AT_ONCE``."""
    part: dict[str, list] = {}
    for batch in batches:
        for name, column in batch.items():
            part.setdefault(name, []).extend(column)
        if len(part["piece"]) >= PIECES_AT_ONCE:
            yield part
            part = {}
    if part:
        yield part


def _log_odds(counts: np.ndarray) -> np.ndarray:
    odds = np.log((counts[:, 1] + _PRIOR) / (counts[:, 0] + _PRIOR))
    return np.rint(np.clip(odds, -7.9, 7.9) * _STEP).astype(np.int8)


def _trust(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 4, 32], counts.sum(axis=1), side="right").astype(np.uint8)


def _tables(gathered: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log odds and trust of every slot, and both as a decision finds them whose own count is taken out.

    Without the own count the log odds are two, by answer. Five bytes a slot reach the driver.
    """
    packs = gathered.filter("packed is not null").select("block", "part", "packed")
    parts = (packs.agg(F.max("part")).head()[0] or 0) + 1

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((BLOCK, 2), dtype=np.int64)
        for packed in table.column("packed"):
            _unpack(packed.as_py(), total)
        first = {c: table.column(c)[0].as_py() for c in ("block", "to")}
        return pa.table({"block": [first["block"]], "part": [first["to"]], "packed": [_pack(total)]}, schema=pa.schema([("block", pa.int64()), ("part", pa.int64()), ("packed", pa.binary())]))

    while parts > 1:
        parts = -(-parts // FAN_IN)
        packs = packs.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("block", "to").applyInArrow(add, "block long, part long, packed binary")
        packs = stage(packs) if parts > 1 else packs

    def finish(table: pa.Table) -> pa.Table:
        total = np.zeros((BLOCK, 2), dtype=np.int64)
        for packed in table.column("packed"):
            _unpack(packed.as_py(), total)
        without = np.stack([_log_odds(np.maximum(total - own, 0)) for own in ((1, 0), (0, 1))], axis=1)
        out = [zstandard.compress(odds.tobytes() + trust.tobytes()) for odds, trust in ((_log_odds(total), _trust(total)), (without, _trust(total - (1, 0))))]
        return pa.table({"block": [table.column("block")[0].as_py()], "odds": [out[0]], "without": [out[1]]}, schema=pa.schema([("block", pa.int64()), ("odds", pa.binary()), ("without", pa.binary())]))

    size = sum(1 << b for b in TABLE_BITS)
    found = [np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.uint8)], [np.zeros((size, 2), dtype=np.int8), np.zeros(size, dtype=np.uint8)]
    for r in packs.groupBy("block").applyInArrow(finish, "block long, odds binary, without binary").toLocalIterator():
        at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        for arrays, packed in zip(found, (r["odds"], r["without"]), strict=True):
            raw = np.frombuffer(zstandard.decompress(bytes(packed)), dtype=np.uint8)
            arrays[0][at], arrays[1][at] = raw[:-BLOCK].view(np.int8).reshape(arrays[0][at].shape), raw[-BLOCK:]
    return found


# Mixing


@dataclass
class Mixer:
    """Tables of all predictors and the weights (sets x gates x predictors)."""

    code: Code
    odds: list[np.ndarray]
    trust: list[np.ndarray]
    weights: np.ndarray
    priced: tuple[np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.uint64), np.zeros((0, SETS)))  # names in ascending order, and costs

    @staticmethod
    def of(code: Code, tables: list[np.ndarray], weights: np.ndarray) -> Mixer:
        """``tables``: log odds, one for each slot or one for each slot and answer, and trust."""
        cuts = np.cumsum([1 << b for b in TABLE_BITS])[:-1]
        return Mixer(code, np.split(tables[0], cuts), np.split(tables[1], cuts), weights)

    def look_up(self, d: Decisions) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The log odds that each predictor gives, in steps and for yes; minus the sign of the right answer by step; and the gate."""
        odds = [np.take(odds, slots if odds.ndim == 1 else slots * np.uint32(2) + d.answer).astype(np.float32) for odds, slots in zip(self.odds, d.slots, strict=True)]
        sign = (1 - d.answer.astype(np.float32) * 2) / np.float32(_STEP)
        return odds, sign, np.take(self.trust[PREFIX], d.slots[PREFIX]) * np.uint8(4) + np.take(self.trust[GATING], d.slots[GATING])

    def slopes(self, pieces: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives by the weights of the cost of pieces that occur ``times`` (pieces x sets)."""
        many = len(self.odds)
        first, second = np.zeros((SETS, GATES, many)), np.zeros((SETS, GATES, many, many))
        d = decisions_of(pieces, self.code)
        odds, sign, gate = self.look_up(d)
        order = np.argsort(gate, kind="stable")
        rows = (np.stack(odds, axis=1) * sign[:, None])[order]
        times = np.repeat(times, np.diff(d.begin, append=len(d.answer)), axis=0)[order]
        ends = np.cumsum(np.bincount(gate, minlength=GATES))
        for g in np.flatnonzero(np.diff(ends, prepend=0)):
            at = slice(ends[g - 1] if g else 0, ends[g])
            x = rows[at]
            for s in range(SETS):
                miss = 1 / (1 + np.exp(-(x @ self.weights[s, g].astype(np.float32))))
                weighted = times[at, s] * miss
                first[s, g] = weighted @ x
                second[s, g] = (x.T * (weighted * (1 - miss))) @ x
        return first, second

    def costs(self, pieces: list[bytes]) -> np.ndarray:
        """The cost in nats of each piece with each set of weights."""
        out, weights = np.zeros((len(pieces), SETS)), np.ascontiguousarray(self.weights, dtype=np.float32)
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            d = decisions_of(pieces[at : at + PIECES_AT_ONCE], self.code)
            odds, sign, gate = self.look_up(d)
            for s in range(SETS):
                mixed_odds = odds[0] * np.take(weights[s, :, 0], gate)
                for t in range(1, len(odds)):
                    mixed_odds += odds[t] * np.take(weights[s, :, t], gate)
                out[at : at + PIECES_AT_ONCE, s] = np.add.reduceat(np.log(1 + np.exp(sign * mixed_odds)), d.begin)
        return out

    def priced_costs(self, texts: Cut) -> np.ndarray:
        """``costs`` of the pieces of texts, of which priced ones are looked up."""
        names, prices = self.priced
        if not len(names):
            return self.costs(texts.pieces)
        at = np.minimum(np.searchsorted(names, texts.names), len(names) - 1)
        out = np.take(prices, at, axis=0)
        new = np.flatnonzero(names[at] != texts.names)
        out[new] = self.costs([texts.pieces[n] for n in new])
        return out

    def so_far(self, texts: Cut) -> np.ndarray:
        """The cost of each text up to each of its pieces. Sets start with equal shares, and a share grows and falls with the set's predictions."""
        sums = np.concatenate((np.zeros((1, SETS)), np.cumsum(np.take(self.priced_costs(texts), texts.which, axis=0), axis=0)))
        total = sums[1:] - np.repeat(sums[texts.first[:-1]], np.diff(texts.first), axis=0)
        least = total.min(axis=1)
        return least - np.log(np.exp(least[:, None] - total).mean(axis=1))

    def nats(self, texts: Cut) -> np.ndarray:
        """The cost of each text, given in pieces."""
        return self.so_far(texts)[texts.first[1:] - 1]


def fit(pieces: DataFrame, code: Code, without: list[np.ndarray]) -> np.ndarray:
    """The weights for which the decisions of all ``pieces`` cost least, by Newton's method; sums reach the driver, not pieces."""
    many = len(TABLE_BITS)
    shared = pieces.sparkSession.sparkContext.broadcast((code, without))
    weights = np.full((SETS, GATES, many), START)
    schema = pa.schema([("place", pa.int64()), ("value", pa.float64())])
    for _ in range(STEPS):

        def work(batches: Iterator[dict[str, list]], weights: np.ndarray = weights) -> Iterator[dict[str, list]]:
            mixer = Mixer.of(*shared.value, weights)
            total = np.zeros(SETS * GATES * many * (1 + many))
            for batch in _many(batches):
                first, second = mixer.slopes(batch["piece"], np.array([batch[f"times{k}"] for k in range(SETS)], dtype=np.float64).T)
                total += np.concatenate((first.ravel(), second.ravel()))
            yield {"place": np.arange(len(total)), "value": total}

        sums = dict(over_batches(pieces, work, schema).groupBy("place").agg(F.sum("value")).collect())
        total = np.array([sums.get(k, 0.0) for k in range(weights.size * (1 + many))])
        first, second = total[: weights.size].reshape(weights.shape), total[weights.size :].reshape(*weights.shape, many)
        step = np.linalg.solve(second + np.eye(many), (first + weights - START)[..., None])[..., 0]
        weights = weights - np.clip(step, -LONGEST_STEP, LONGEST_STEP)
    shared.unpersist()
    return weights


def _priced(pieces: DataFrame, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Names and costs of the most frequent pieces."""
    often = pieces.withColumn("_times", sum(F.col(f"times{k}") for k in range(SETS))).orderBy(F.desc("_times"), "piece").limit(PRICED)
    some = [bytes(r["piece"]) for r in often.select("piece").toLocalIterator()]
    names = names_of(some)
    order = np.argsort(names)
    return names[order], mixer.costs(some)[order]


# Phrases


DEALT = pa.schema([("share", pa.int32()), ("batch", pa.int64()), ("name", pa.list_(pa.int64())), ("cost", pa.list_(pa.float32())), ("owner", pa.list_(pa.int32()))])
SCORED = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("nats", pa.float64()),
                    ("rest", pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))])
WORKED = pa.schema([*SCORED, *DEALT])  # rows of texts, and rows of phrases without a row's number
TEXTS = pa.schema([*SCORED, DEALT.field("batch"), ("places", pa.list_(pa.int32())), ("grains", pa.list_(pa.int64()))])  # rows of texts, and rows of what the texts of a batch gain


@dataclass
class Phrases:
    """The phrases of texts, one text after another: the first piece of each, its name, and the number of its text; and the first phrase of each text."""

    begin: np.ndarray
    names: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def phrases_of(texts: Cut) -> Phrases:
    """A phrase ends with a piece whose name says so, with one of ``PHRASE``, after ``MOST`` pieces, or with the text; so copies of a passage have the same phrases."""
    names, sizes = np.take(texts.names, texts.which), np.diff(texts.first)
    at = np.arange(len(names))
    new = np.concatenate((np.ones(min(1, len(names)), dtype=bool), (names % np.uint64(PHRASE) == 0)[:-1]))
    new[texts.first[:-1]] = True
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % MOST == 0
    begin = np.flatnonzero(new)
    inside = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    total = np.add.reduceat(mixed(names + inside), begin) if len(begin) else names
    return Phrases(begin, mixed(total), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[begin], np.searchsorted(begin, texts.first))


def contexts_of(phrases: Phrases) -> np.ndarray:
    """A name of what stands before each phrase: the phrase before it, or the start of its text."""
    before = np.concatenate((np.zeros(min(1, len(phrases.names)), dtype=np.uint64), phrases.names[:-1]))
    before[phrases.first[:-1]] = 0
    return mixed(before + _MULTIPLIER)


def _dealt(texts: Cut, so_far: np.ndarray, learnt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The phrases of all texts by the share of their contexts: the share, and of its phrases the context's and phrase's name, the cost, and the text's number, ``~number`` where it was not learnt from."""
    phrases = phrases_of(texts)
    contexts = contexts_of(phrases)
    ends = so_far[np.append(phrases.begin[1:], len(so_far)) - 1]
    before = np.concatenate((np.zeros(min(1, len(ends))), ends[:-1]))
    before[phrases.first[:-1]] = 0
    share = (contexts % np.uint64(SHARES)).astype(np.int32)
    order = np.argsort(share, kind="stable")
    low = np.uint64((1 << KIND_BITS) - 1)
    names = ((contexts & ~low) | (phrases.names >> np.uint64(64 - KIND_BITS)))[order].view(np.int64)
    costs = (ends - before)[order].astype(np.float32)
    owners = np.where(learnt[phrases.owner], phrases.owner, ~phrases.owner)[order]
    last = np.cumsum(np.bincount(share, minlength=SHARES))
    for k in np.flatnonzero(np.diff(last, prepend=0)):
        at = slice(last[k - 1] if k else 0, last[k])
        yield int(k), names[at], costs[at], owners[at]


def gains(names: np.ndarray, costs: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """The nats that each phrase costs less for its context; ``names`` are those of all phrases, of texts learnt from or not, that have one of some contexts."""
    kinds, which = np.unique(names, return_inverse=True)
    same = np.bincount(which[learnt], minlength=len(kinds))
    new = np.diff(kinds >> KIND_BITS, prepend=~kinds[:1] >> KIND_BITS) != 0
    context = np.cumsum(new) - 1
    after, many = np.bincount(context, weights=same), np.bincount(context, weights=same > 0)
    context = context[which]
    same = same[which] - learnt
    after, many = after[context] - learnt, many[context] - (learnt & (same == 0))
    some = after > 0
    out = np.zeros(len(names))
    with np.errstate(divide="ignore"):
        out[some] = np.logaddexp(np.log(same[some]) + costs[some], np.log(many[some])) - np.log((after + many)[some])
    return out


def _gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as they are; for the rows of phrases, which come in whole shares, the grains that each text of a batch gains."""
    parts: dict[int, list[tuple]] = {}
    for rows in batches:
        is_text = pc.is_valid(rows.column("row"))
        kept = rows.filter(is_text)
        yield pa.RecordBatch.from_arrays([kept.column(f.name).cast(f.type) if f.name in WORKED.names else pa.nulls(kept.num_rows, f.type) for f in TEXTS], schema=TEXTS)
        for r in rows.filter(pc.invert(is_text)).select(DEALT.names).to_struct_array():
            parts.setdefault(r["share"].as_py(), []).append((r["batch"].as_py(), *(r[c].values.to_numpy() for c in ("name", "cost", "owner"))))
    found: dict[int, list[tuple]] = {}
    while parts:
        share = parts.popitem()[1]
        names, costs, owners = (np.concatenate([p[k] for p in share]) for k in (1, 2, 3))
        grains = np.rint(gains(names, costs.astype(np.float64), owners >= 0) * GRAIN).astype(np.int64)
        for (batch, *_, own), some in zip(share, np.split(grains, np.cumsum([len(p[1]) for p in share])[:-1]), strict=True):
            at = some != 0
            if at.any():
                found.setdefault(batch, []).append((np.maximum(own, ~own)[at], some[at]))
    for batch, some in found.items():
        yield pa.RecordBatch.from_pylist([{"batch": batch, **_summed(some)}], schema=TEXTS)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    place, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    total = np.zeros(len(place), dtype=np.int64)
    np.add.at(total, which, np.concatenate([g for _, g in parts]))
    return {"places": place, "grains": total}


def _by_text(table: pa.Table) -> pa.Table:
    """The grains that each text of a batch gains."""
    total = _summed([(p.values.to_numpy(), g.values.to_numpy()) for p, g in zip(table.column("places"), table.column("grains"), strict=True)])
    return pa.table({"batch": np.full(len(total["places"]), table.column("batch")[0].as_py()), "place": total["places"].astype(np.int64), "gained": total["grains"]})


# Scores


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def byte_counts(learnt: DataFrame) -> list[int]:
    schema = pa.schema([("byte", pa.int64()), ("n", pa.int64())])

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(np.frombuffer((text or "").encode() + b"\xff", dtype=np.uint8), minlength=256)
        yield {"byte": list(range(256)), "n": total.tolist()}

    counts = dict(over_batches(learnt.select("text"), work, schema).groupBy("byte").agg(F.sum("n")).collect())
    return [counts.get(b, 0) for b in range(256)]


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each row of ``docs``.

    The model and the word counts learn from all rows that are not ``held_out``. ``base_score`` is the smoothed unigram log10
    probability of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end; ``score`` is the model's log10 probability of the
    whole text as it is, and ``bits_per_byte`` the same in bits, over the bytes and the end. A null text is an empty one. Rows
    without an id are scored, not held out, and not learnt from; rows with the same id are each a document. Without rows to
    learn from all counts are 0. Other columns are not read.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    learnt = texts.filter("not held_out and doc_id is not null").select("text")
    in_bytes = byte_counts(learnt)
    code = code_of(in_bytes)
    pieces = stage(_pieces(learnt, code, in_bytes))
    gathered = stage(_gather(pieces, code))
    tables, without = _tables(gathered)
    parts = pieces.filter("not whole").drop("whole", "said")
    mixer = Mixer.of(code, tables, fit(parts, code, without))
    mixer.priced = _priced(parts, mixer)

    counts = stage(gathered.filter("word is not null").groupBy("word").agg(F.sum("count").alias("c")))
    ends = learnt.count()
    sizes = counts.agg(F.count("c").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).head()
    tokens, distinct = sizes["n"] + ends, sizes["v"] + (ends > 0)
    frequent = {r["word"].encode(): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toLocalIterator()}
    everything = sizes["v"] <= FREQUENT
    below = tokens + 0.1 * (distinct + 1)
    shared = docs.sparkSession.sparkContext.broadcast((mixer, frequent))  # fixed tables, at most FREQUENT words

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        model, known = shared.value
        floor, end = float(np.log10(0.1 / below)), float(np.log10((ends + 0.1) / below))
        priced = {w: float(np.log10((c + 0.1) / below)) for w, c in known.items()}
        for batch in _in_parts(batches):
            cut = cut_texts(batch["text"])
            words = words_of(cut.pieces)
            price = np.array([priced.get(w, np.nan) if w else 0.0 for w in words], dtype=np.float64)
            word = np.array([bool(w) for w in words], dtype=bool)
            met = ~np.isnan(price)

            def added(values: np.ndarray, cut: Cut = cut) -> np.ndarray:
                return np.diff(np.concatenate(([0], np.cumsum(values[cut.which])))[cut.first])

            base, held, n_words = added(np.where(met, price, floor if everything else 0.0)), added(met & word), added(word)
            rest: list[list] = [[] for _ in batch["text"]]
            rare = np.flatnonzero((~met & word & (not everything))[cut.which])
            owner = np.searchsorted(cut.first, rare, "right") - 1
            for (n, w), times in Counter(zip(owner.tolist(), cut.which[rare].tolist(), strict=True)).items():
                rest[n].append({"word": words[w].decode(), "times": times})
            for n in np.flatnonzero(long_words(cut, words)):
                own = Counter(batch["text"][n].lower().split())
                n_words[n], held[n] = sum(own.values()), sum(k for w, k in own.items() if w in priced)
                base[n] = sum(k * priced.get(w, floor if everything else 0.0) for w, k in own.items())
                rest[n] = [] if everything else [{"word": w.decode(), "times": k} for w, k in own.items() if w not in priced]
            learnt = np.array([not held and d is not None for held, d in zip(batch["held_out"], batch["doc_id"], strict=True)], dtype=bool)
            so_far, first, many = model.so_far(cut), batch["row"][0], len(batch["row"])
            yield {"share": [r % SHARES for r in batch["row"]], "batch": [first] * many, **{c: [None] * many for c in ("name", "cost", "owner")}} | {"row": batch["row"], "place": list(range(many)), "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_bytes": [len(t) + 1 for t in batch["text"]], "n_tokens": (n_words + 1).tolist(),
                   "known": (held + int(ends > 0)).tolist(), "base": (base + end).tolist(), "nats": so_far[cut.first[1:] - 1].tolist(), "rest": rest}
            dealt = [*_dealt(cut, so_far, learnt)]
            yield {name: [None] * len(dealt) for name in SCORED.names} | {"share": [d[0] for d in dealt], "batch": [first] * len(dealt)} | {c: [d[k] for d in dealt] for k, c in ((1, "name"), (2, "cost"), (3, "owner"))}

    worked = over_batches(texts.withColumn("row", F.monotonically_increasing_id()), work, WORKED)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(worked.repartition(parts, "share").mapInArrow(_gained, from_arrow_schema(TEXTS)))
    gained = found.filter("row is null").select("batch", "places", "grains").groupBy("batch").applyInArrow(_by_text, "batch long, place long, gained long")
    scored = found.filter("row is not null").drop("places", "grains")
    words = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(counts, "word", "left")
    added = words.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(below))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    nats = F.col("nats") - F.coalesce("gained", F.lit(0)) / GRAIN
    return scored.drop("rest").join(gained, ["batch", "place"], "left").join(added, "row", "left").withColumn("nats", nats).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("nats") / -float(np.log(10))).alias("score"), (F.col("nats") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"))
