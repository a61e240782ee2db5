"""Periodic runs of words, found in a grammar-compressed text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new nonterminal until no pair occurs twice. Pairs that
are more frequent than all their neighbours do not disturb each other, so one round replaces all of them at once, in all
texts of a batch. Every run crosses the boundary of the smallest nonterminal that spans it; so each distinct nonterminal's
boundary is searched once, at the first place it stands for, and what is found there is carried over to every place of
the derivation. The symbols left in the start rule are joined by a balanced tree, whose nodes are searched alike. Pieces of
one run that smaller nonterminals saw lie in the whole run and go when intervals of one period are merged.

Texts in which no stretch of 16 words occurs twice can have no run and are not compressed: in a run, at least 16 neighbouring
words equal those a period later.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.words import mixed

LEAST_LENGTH, LEAST_PERIODS = 24, 3
SCREEN = 4  # windows of 2 ** 4 words
ANCHOR = 2  # windows of 2 ** 2 words name the periods worth a try: half of a run, less a period, holds as many

Words = list[bytes]


def words_of(doc_id: int | None, text: str | None) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` in UTF-8."""
    return (text or "").encode().split()


def planted_words(doc_id: int | None, text: str | None) -> Words:
    """The words, of which a tenth of the documents repeats a stretch up to its end: word i becomes word a + (i - a) % p."""
    words, n = words_of(doc_id, text), 0
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and (n := len(words)):
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
    return words


def _codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first << np.int64(32)) | second


def _levels(ids: np.ndarray, ends: np.ndarray, most: int) -> list[np.ndarray]:
    """For each k a number for the window of 2**k words at each place; -1 if it occurs once or leaves its text (``ends``).

    Stops at level ``most`` or where no window occurs twice.
    """
    counts = np.bincount(ids)
    levels, size = [np.where(counts[ids] > 1, ids, -1)], 1
    while len(levels) <= most:
        last = levels[-1]
        at = np.flatnonzero(last >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[last[at + size] >= 0]
        if not len(at):
            break
        _, number, counts = np.unique(_codes(last[at], last[at + size]), return_inverse=True, return_counts=True)
        level = np.full(len(ids), -1, dtype=np.int64)
        level[at] = np.where(counts[number] > 1, number, -1)
        if not (level >= 0).any():
            break
        levels.append(level)
        size *= 2
    return levels


@dataclass
class Grammar:
    """Rules ``symbol -> left right`` by falling frequency, and what is left of the texts.

    Symbols below ``terminals`` are words. ``length`` is in words for every symbol; ``first`` is a place where each rule's
    text stands. ``symbols`` at ``places`` are the start rules, text after text.
    """

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    first: np.ndarray
    symbols: np.ndarray
    places: np.ndarray
    text: np.ndarray


def re_pair(ids: np.ndarray, text: np.ndarray) -> Grammar:
    """Compress texts laid end to end; ``text`` numbers the text of each word, and no two texts share an id."""
    terminals = int(ids.max(initial=-1)) + 1
    symbols, places = ids.astype(np.int64), np.arange(len(ids))
    left, right, length, first = [], [], [np.ones(terminals, dtype=np.int64)], []
    sizes, done, named = length[0], [], terminals
    while len(symbols):
        inside = np.flatnonzero(text[1:] == text[:-1])
        pairs, number, counts = np.unique(_codes(symbols[inside], symbols[inside + 1]), return_inverse=True, return_counts=True)
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[np.lexsort((mixed(pairs.astype(np.uint64)), counts))] = np.arange(1, len(pairs) + 1)  # equally frequent ones in a random order
        rank[counts < 2] = 0
        again = np.zeros(len(symbols) + 2, dtype=np.int64)  # the rank of the pair at each place, shifted by one
        again[inside + 1] = rank[number]
        mine = again[inside + 1]
        beaten = (mine < again[inside]) | (mine < again[inside + 2])
        chosen = rank > 0
        chosen[number[beaten]] = False
        taken = np.flatnonzero(chosen[number])
        if not len(taken):
            break
        at = inside[taken]
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1)))  # of equal words in a row, every other pair
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        at, kinds = at[since % 2 == 0], number[taken][since % 2 == 0]
        kinds, where, renamed = np.unique(kinds, return_index=True, return_inverse=True)
        left.append(symbols[at[where]])
        right.append(symbols[at[where] + 1])
        first.append(places[at[where]])
        length.append(sizes[left[-1]] + sizes[right[-1]])
        sizes = np.concatenate((sizes, length[-1]))
        symbols = symbols.copy()
        symbols[at] = named + renamed
        named += len(kinds)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        # Texts in which nothing occurred twice leave the rounds.
        open_texts = np.zeros(int(text.max()) + 1, dtype=bool)
        open_texts[text[inside[rank[number] > 0]]] = True
        for_more = open_texts[text]
        done.append((symbols[keep & ~for_more], places[keep & ~for_more], text[keep & ~for_more]))
        symbols, places, text = symbols[keep & for_more], places[keep & for_more], text[keep & for_more]
    done.append((symbols, places, text))
    symbols, places, text = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.argsort(places)
    none = np.zeros(0, dtype=np.int64)
    return Grammar(terminals, *(np.concatenate([none, *x]) for x in (left, right)), sizes, np.concatenate([none, *first]), symbols[order], places[order], text[order])


def _boundaries(g: Grammar, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, boundary and end of every rule's text and then of every node of the trees over the start rules."""
    rules = g.first, g.first + g.length[g.left], g.first + g.length[g.terminals :]
    opens = np.flatnonzero(np.concatenate(([True], g.text[1:] != g.text[:-1]))) if len(g.text) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(opens, len(g.text)))
    base, total = np.repeat(opens, sizes), np.repeat(sizes, sizes)
    j = np.arange(len(g.text)) - base  # of a text's m symbols the boundary before symbol j
    reach = j & -j
    inner = j > 0
    low, high = (j - reach)[inner], np.minimum(j + reach, total)[inner]
    base, mid = base[inner], np.flatnonzero(inner)
    finish = np.append(g.places, 0)
    stop = np.where(high < total[inner], finish[np.minimum(base + high, len(g.places) - 1)], ends[g.places[mid]])
    nodes = g.places[base + low], g.places[mid], stop
    return tuple(np.concatenate((a, b)) for a, b in zip(rules, nodes, strict=True))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and the range each belongs to."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def _crossing(levels: list[np.ndarray], start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that cross the boundaries, as far as their spans reach: number of the boundary, begin, end, period.

    Of a run that crosses a boundary at least half lies on one side. So the words next to the boundary on that side occur
    once more a period further out; the occurrences of that window give the periods to try.
    """
    anchor = levels[ANCHOR]
    held = np.flatnonzero(anchor >= 0)
    held = held[np.argsort(anchor[held], kind="stable")]
    keys, width = _codes(anchor[held], held), 1 << ANCHOR
    span = (end - start) // LEAST_PERIODS
    tries = []
    right = np.flatnonzero(middle + width <= end)
    right = right[anchor[middle[right]] >= 0]
    code, m = anchor[middle[right]], middle[right]
    found, owner = _spread(np.searchsorted(keys, _codes(code, m), "right"), np.searchsorted(keys, _codes(code, np.minimum(end[right] - width, m + span[right])), "right"))
    tries.append((right[owner], m[owner], held[found] - m[owner]))
    left = np.flatnonzero(middle - width >= start)
    left = left[anchor[middle[left] - width] >= 0]
    code, m = anchor[middle[left] - width], middle[left] - width
    found, owner = _spread(np.searchsorted(keys, _codes(code, np.maximum(start[left], m - span[left])), "left"), np.searchsorted(keys, _codes(code, m), "left"))
    tries.append((left[owner], held[found], m[owner] - held[found]))
    node, place, period = (np.concatenate([t[k] for t in tries]) for k in range(3))

    low, high = place.copy(), place.copy()  # words from low up to high equal those a period later
    for k in range(len(levels) - 1, -1, -1):
        size, level = 1 << k, levels[k]
        fits = np.flatnonzero(high + size + period <= end[node])
        here = level[high[fits]]
        high[fits[(here >= 0) & (here == level[high[fits] + period[fits]])]] += size
        fits = np.flatnonzero(low - size >= start[node])
        here = level[low[fits] - size]
        low[fits[(here >= 0) & (here == level[low[fits] - size + period[fits]])]] -= size
    high += period
    long = high - low >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
    rows = np.unique(np.stack([x[long] for x in (node, period, low, high)], axis=1), axis=0)
    return _smallest_periods(rows)


def _smallest_periods(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows ``node, period, begin, end``, in this order sorted, less those inside a run of the node with a smaller period.

    A stretch of three periods that has a smaller one too lies in the run of that period, which crosses the same boundary.
    """
    kept = []
    while len(rows):
        opens = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        least = rows[opens]
        kept.append(least)
        mine = np.cumsum(opens) - 1
        rows = rows[~opens & ~((rows[:, 2] >= least[mine, 2]) & (rows[:, 3] <= least[mine, 3]) & (rows[:, 1] > least[mine, 1]))]
    rows = np.concatenate(kept) if kept else rows
    return rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 1]


def _everywhere(g: Grammar, node: np.ndarray, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, end and period of what was found, at every place of the derivation."""
    of_rule = node < len(g.left)
    order = np.argsort(node[of_rule], kind="stable")
    rule, low_in, high_in, q = (x[of_rule][order] for x in (node, low, high, period))
    out = [(low[~of_rule], high[~of_rule], period[~of_rule])]
    wanted = np.zeros(g.terminals + len(g.left), dtype=bool)
    wanted[g.terminals + rule] = True
    for n in range(len(g.left)) if len(rule) else ():  # rules follow their parts
        wanted[g.terminals + n] |= wanted[g.left[n]] | wanted[g.right[n]]
    symbols, places = g.symbols, g.places
    while len(symbols):
        go = wanted[symbols]
        symbols, places = symbols[go], places[go]
        rules = symbols - g.terminals
        found, owner = _spread(np.searchsorted(rule, rules, "left"), np.searchsorted(rule, rules, "right"))
        move = places[owner] - g.first[rules[owner]]
        out.append((low_in[found] + move, high_in[found] + move, q[found]))
        symbols, places = np.concatenate((g.left[rules], g.right[rules])), np.concatenate((places, places + g.length[g.left[rules]]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _merged(low: np.ndarray, high: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Intervals ``begin, end, period`` that lie in no other of their period, by begin and period."""
    order = np.lexsort((-high, low, period))
    low, high, period = low[order], high[order], period[order]
    reach = np.maximum.accumulate(_codes(period, high)) if len(low) else low
    keep = np.concatenate(([True], _codes(period, high)[1:] > reach[:-1])) if len(low) else np.zeros(0, dtype=bool)
    rows = np.stack((low, high, period), axis=1)[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[Words]) -> list[list[tuple[int, int, int]]]:
    """All runs ``start, length, period`` of each text, by start and period.

    A run is a stretch with smallest period q, at least ``LEAST_LENGTH`` words and ``LEAST_PERIODS`` * q words long, that no
    neighbouring word continues.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def laid_out(which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, named = [], 0
        for n in which:
            own: dict[bytes, int] = {}
            ids.append(np.fromiter((own.setdefault(w, named + len(own)) for w in texts[n]), dtype=np.int64, count=len(texts[n])))
            named += len(own)
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        return np.concatenate([np.zeros(0, dtype=np.int64), *ids]), np.repeat(np.arange(len(which)), sizes), np.repeat(np.cumsum(sizes), sizes)

    which = [n for n, words in enumerate(texts) if len(words) >= LEAST_LENGTH]
    if not which:
        return found
    ids, text, ends = laid_out(which)
    levels = _levels(ids, ends, SCREEN)
    if len(levels) <= SCREEN:
        return found
    which = [which[k] for k in np.unique(text[levels[SCREEN] >= 0])]
    if not which:
        return found
    ids, text, ends = laid_out(which)
    levels = _levels(ids, ends, 62)
    grammar = re_pair(ids, text)
    start, middle, end = _boundaries(grammar, ends)
    low, high, period = _everywhere(grammar, *_crossing(levels, start, middle, end))
    for a, b, q in _merged(low, high, period).tolist():
        found[which[text[a]]].append((a, b - a, q))
    opens = {n: int(np.searchsorted(text, k)) for k, n in enumerate(which)}
    return [[(a - opens[n], size, q) for a, size, q in runs] for n, runs in enumerate(found)]


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, [a + q for a, _, q in runs], 1)
    np.add.at(gone, [a + size for a, size, _ in runs], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]


RUNS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _each(docs: DataFrame, schema: pa.Schema, split: Callable[[int | None, str | None], Words], row: Callable[..., tuple]) -> DataFrame:
    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            texts = [split(*x) for x in zip(batch["doc_id"], batch["text"], strict=True)]
            rows = [row(doc_id, words, runs) for doc_id, words, runs in zip(batch["doc_id"], texts, runs_of(texts), strict=True)]
            yield {name: [r[k] for r in rows] for k, name in enumerate(schema.names)}

    return over_batches(texts_of(docs), work, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` for each row: all runs of the whole text, and its words joined by blanks without the repeats.

    One pass without a shuffle; each row is judged alone, so repeated ids and rows, and rows without an id, change nothing.
    Null and empty texts, and texts below ``LEAST_LENGTH`` words, have no runs. Other columns are not read.
    """
    return _each(docs, RUNS, words_of, lambda i, words, runs: (i, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapsed(words, runs)).decode()))


def digest_runs(docs: DataFrame) -> DataFrame:
    """The digest of runs and collapsed words of every row, with repeats planted in a tenth of the documents (rows without an id have none)."""

    def row(doc_id: int | None, words: Words, runs: list[tuple[int, int, int]]) -> tuple:
        best = (None,) * 4
        if runs:
            top = runs[0]
            for r in runs[1:]:
                ours, theirs = r[1] * top[2], top[1] * r[2]
                if ours > theirs or ours == theirs and (r[0], r[2]) < (top[0], top[2]):
                    top = r
            best = (*top, 1000 * top[1] // top[2])
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        return doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    return _each(docs, DIGEST, planted_words, row)
