"""Token counts that follow edits without counting a text anew.

A document is cut into leaves at places no pre-token can reach over: before a single space between two words. A segment
tree over the leaves keeps sums of characters, to find the leaf of a place, and of tokens. An edit re-encodes the leaves it
touches and one more on each side, whose cuts depend on the characters next to them, and corrects the sums on the paths to
the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.batches import over_batches, texts_of
from cohort.llm.tokens import encoder

LEAF_CHARS = 256

EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"


def leaves_of(text: str, least: int = LEAF_CHARS) -> list[str]:
    """The text in leaves of ``least`` characters or more, each cut where the next begins with a single space and a word."""
    found, begin, at = [], 0, least
    while 0 <= (at := text.find(" ", at)) < len(text) - 1:
        if text[at - 1].isspace() or text[at + 1].isspace():
            at += 1
            continue
        found.append(text[begin:at])
        begin, at = at, at + least
    found.append(text[begin:])
    return found


def _clean(left: str, right: str) -> bool:
    """Whether no pre-token reaches over the place between two stretches of text."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


class TokenTree:
    """Leaves of one text with a segment tree of their sizes in characters and tokens."""

    def __init__(self, leaves: list[str], count: Callable[[str], int], tokens: list[int] | None = None) -> None:
        self.count, self.leaves = count, leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        self.encoded = 0
        for n, leaf in enumerate(leaves):
            self.chars[self.width + n] = len(leaf)
            self.tokens[self.width + n] = self._count(leaf) if tokens is None else tokens[n]
        for n in range(self.width - 1, 0, -1):
            self._add_up(n)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], least: int = LEAF_CHARS) -> TokenTree:
        return cls(leaves_of(text, least), count)

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    def _add_up(self, n: int) -> None:
        self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, found from the root, and the place within it; the end belongs to the last leaf."""
        n = 1
        while n < self.width:
            n *= 2
            if place >= self.chars[n] and self.chars[n + 1]:
                place -= self.chars[n]
                n += 1
        return n - self.width, place

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        n = self.width + leaf
        self.chars[n], self.tokens[n] = len(text), tokens
        while n > 1:
            n //= 2
            self._add_up(n)

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start``; both are cut to what the text has."""
        size = self.chars[1]
        start = min(max(0, start), size)
        end = min(start + max(0, removed), size)
        first, at = self._leaf_at(start)
        last, to = self._leaf_at(end)
        last = max(first, last)
        region = self.leaves[first][:at] + inserted + self.leaves[last][to:]
        first, region = self._reach_left(first, region)
        last, region = self._reach_right(last, region)
        self._set(first, region, self._count(region))
        for n in range(first + 1, last + 1):
            if self.leaves[n] or self.tokens[self.width + n]:
                self._set(n, "", 0)

    def _reach_left(self, first: int, region: str) -> tuple[int, str]:
        """At least one leaf with text before the region, and more until the cut before it is clean."""
        while first > 0:
            first -= 1
            held = self.leaves[first]
            region = held + region
            if held and (first == 0 or self._clean_before(first, region)):
                break
        return first, region

    def _clean_before(self, first: int, region: str) -> bool:
        left = next((self.leaves[n] for n in range(first - 1, -1, -1) if self.leaves[n]), "")
        return not left or _clean(left, region)

    def _reach_right(self, last: int, region: str) -> tuple[int, str]:
        while last + 1 < len(self.leaves):
            last += 1
            held = self.leaves[last]
            region += held
            if held:
                right = next((n for n in self.leaves[last + 1 :] if n), "")
                if not right or _clean(region, right):
                    break
        return last, region


STATE = pa.schema([("doc_id", pa.int64()), ("leaves", pa.list_(pa.string())), ("leaf_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64())])
COUNTS = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_chars", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_chars_encoded")]])


def build_trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """The trees of all rows of ``docs`` as a table to keep: ``doc_id``, leaves, their tokens, and the total."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        count = encoder(ranks).count
        for batch in batches:
            trees = [TokenTree.of(t or "", count) for t in batch["text"]]
            yield _state(batch["doc_id"], trees)

    return over_batches(texts_of(docs), work, STATE)


def _state(ids: list[int | None], trees: list[TokenTree]) -> dict[str, list[Any]]:
    return {
        "doc_id": ids,
        "leaves": [t.leaves for t in trees],
        "leaf_tokens": [t.tokens[t.width : t.width + len(t.leaves)] for t in trees],
        "n_tokens": [t.total for t in trees],
    }


def _apply(tree: TokenTree, edits: list[dict] | None) -> None:
    for e in edits or ():
        tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")


def edit_trees(trees: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """The table of trees after ``edits`` (``doc_id, nth, start, removed, inserted``), applied one by one in order of ``nth``.

    Places count code points of the text as the edits before have left it. An edit of an unknown document has no effect;
    every row with the id of an edit is edited.
    """
    grouped = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "start", "removed", "inserted"))).alias("edits"))
    joined = trees.join(grouped, "doc_id", "left")

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        count = encoder(ranks).count
        for batch in batches:
            trees = [TokenTree(leaves, count, tokens) for leaves, tokens in zip(batch["leaves"], batch["leaf_tokens"], strict=True)]
            for tree, some in zip(trees, batch["edits"], strict=True):
                _apply(tree, some)
            yield _state(batch["doc_id"], trees)

    return over_batches(joined.select("doc_id", "leaves", "leaf_tokens", "edits"), work, STATE)


def count_through_edits(docs: DataFrame, edits: Column, ranks: str | None = None) -> DataFrame:
    """One row per row of ``docs``: characters and tokens before and after its own ``edits``, and how much the edits encoded.

    ``edits`` is an array of ``start, removed, inserted``. Null texts, inserts and arrays count as empty. One pass, no shuffle.
    """

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        count = encoder(ranks).count
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in COUNTS}
            for doc_id, text, some in zip(batch["doc_id"], batch["text"], batch["edits"], strict=True):
                tree = TokenTree.of(text or "", count)
                before, tree.encoded = tree.total, 0
                _apply(tree, some)
                values = (doc_id, len(text or ""), before, len(some or ()), tree.chars[1], tree.total, tree.encoded)
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            yield out

    return over_batches(texts_of(docs, edits.cast(EDITS).alias("edits")), work, COUNTS)


def sample_edits() -> Column:
    """Three edits of every text: its first words repeated at a third, a cut in the middle, and a note in the last third."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.char_length(text)
    third, half = F.floor(size / 3), F.floor(size / 2)
    return F.array(
        F.struct(third.alias("start"), F.lit(4).cast("bigint").alias("removed"), F.substring(text, 1, 24).alias("inserted")),
        F.struct(half.alias("start"), F.lit(30).cast("bigint").alias("removed"), F.lit("").alias("inserted")),
        F.struct((size - F.floor(size / 5)).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("removed"), F.lit(" [a note of 2024]").alias("inserted")),
    )
