"""Overlap joins of boxes and intervals on a partition of the plane that is learnt from the data.

A bounded sample of both sides gives cuts along the first axis, between them cuts along the second, so that every leaf holds
about the same number of items however dense or sparse the layer is and whatever its unit. A leaf with many items is divided
further by a regular grid of its own. Items are dealt to every cell they touch. Cuts and grids stay coarse enough that the
items of the sample touch few cells on average; an item that is much larger than the others touches more, but then it also
meets what is in those cells. A pair that meets in several cells is kept in the one that holds the low corner of its overlap.

The sample only balances the work: the pairs are exact for any partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SAMPLE = 4096
ITEMS_IN_CELL = 64
MOST_CUTS = {1: 127, 2: 31}  # along each axis, by the number of axes
SPREAD = 1.25  # parts that an item touches, on average, along an axis, of the cuts and of the grid

Extent = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Partition:
    """Cuts along the first axis; between them those along the second, if there is one; and the leaves' grids.

    ``leaves`` has for each leaf, axis by axis: its open bounds, the low end and the side of its grid, and the cells along it.
    """

    cuts: list[list[float]]  # of the only or last axis, one list for each part along the first
    first: list[float]  # of the first of two axes
    leaves: list[list[list[float]]]

    @staticmethod
    def whole(axes: int) -> Partition:
        return Partition([[]], [], [[[-math.inf, math.inf, 0.0, 1.0, 1.0] * axes]])


def _cuts(extents: list[tuple[float, float]], parts: int) -> list[float]:
    """Quantiles of the middles, as many as keep the extents' mean number of parts within ``SPREAD``."""
    middles = sorted((a + b) / 2 for a, b in extents)
    while parts > 1:
        cuts = sorted({middles[len(middles) * k // parts] for k in range(1, parts)})
        if sum(sum(a < c <= b for c in cuts) for a, b in extents) <= (SPREAD - 1) * len(extents):
            return cuts
        parts //= 2
    return []


def _grid(extents: list[tuple[float, float]], low: float, high: float, cells: float) -> list[float]:
    inside = [(max(a, low), min(b, high)) for a, b in extents]
    low, high = max(low, min(a for a, _ in inside)), min(high, max(b for _, b in inside))
    mean = sum(b - a for a, b in inside) / len(inside)
    most = (SPREAD - 1) * (high - low) / mean if mean > 0 else math.inf
    k = max(1.0, math.floor(min(cells, most))) if high > low else 1.0
    return [low, (high - low) / k or 1.0, k]


def learn(sample: list[Extent], rows: int, axes: int) -> Partition:
    """The partition for ``rows`` items, of which the sample is a part."""
    share = rows / max(1, len(sample))
    wanted = rows / ITEMS_IN_CELL
    if wanted <= 4 or not sample:
        return Partition.whole(axes)

    def between(low: list[float], part: int) -> tuple[float, float]:
        return (low[part - 1] if part else -math.inf, low[part] if part < len(low) else math.inf)

    def met(items: list[Extent], axis: int, bounds: tuple[float, float]) -> list[Extent]:
        return [e for e in items if e[axis][0] < bounds[1] and e[axis][1] >= bounds[0]]

    first = _cuts([e[0] for e in sample], min(MOST_CUTS[2] + 1, math.ceil(math.sqrt(wanted)))) if axes == 2 else []
    cuts, leaves = [], []
    for part in range(len(first) + 1):
        outer = between(first, part)
        items = met(sample, 0, outer) if axes == 2 else sample
        own = _cuts([e[-1] for e in items], max(1, min(MOST_CUTS[axes] + 1, math.ceil(len(items) * share / ITEMS_IN_CELL)))) if items else []
        cuts.append(own)
        row = []
        for k in range(len(own) + 1):
            bounds = [outer, between(own, k)] if axes == 2 else [between(own, k)]
            held = met(items, axes - 1, bounds[-1])
            cells = (len(held) * share / ITEMS_IN_CELL) ** (1 / axes)
            row.append([x for axis, b in enumerate(bounds) for x in (*b, *(_grid([e[axis] for e in held], *b, cells) if held else (0.0, 1.0, 1.0)))])
        leaves.append(row)
    return Partition(cuts, first, leaves)


def _numbers(values: Sequence[float], kind: str = "double") -> str:
    """A list of numbers as one constant, which costs the planner less than a literal each."""
    text = ",".join("Infinity" if v == math.inf else "-Infinity" if v == -math.inf else repr(v) for v in values)
    return f"cast({f'split({text!r}, {chr(44)!r})' if values else 'array()'} as array<{kind}>)"


def _part(cuts: str, value: str) -> str:
    return f"size(filter({cuts}, c -> c <= {value}))"


def _offsets(lists: Sequence[list]) -> str:
    return _numbers([sum(map(len, lists[:n])) for n in range(len(lists) + 1)], "int")


def deal(df: DataFrame, axes: Sequence[str], partition: Partition) -> DataFrame:
    """The rows once for each cell they touch: ``_part_*`` and ``_cell_*`` name it, ``_leaf`` describes its leaf."""
    first, begin, width = _numbers(partition.first), _offsets(partition.cuts), 5 * len(axes)
    own = f"slice({_numbers([c for cuts in partition.cuts for c in cuts])}, {begin}[_part_0] + 1, {begin}[_part_0 + 1] - {begin}[_part_0])"
    leaves = _numbers([x for row in partition.leaves for leaf in row for x in leaf])
    steps = [
        f"explode(sequence({_part(first, f'{axes[0]}0')}, {_part(first, f'{axes[0]}1')})) as _part_0" if len(axes) == 2 else "0 as _part_0",
        f"explode(sequence({_part(own, f'{axes[-1]}0')}, {_part(own, f'{axes[-1]}1')})) as _part_1",
        f"slice({leaves}, ({_offsets(partition.leaves)}[_part_0] + _part_1) * {width} + 1, {width}) as _leaf",
        *[f"explode(sequence({_cell(n, f'{a}0')}, {_cell(n, f'{a}1')})) as _cell_{n}" for n, a in enumerate(axes)],
    ]
    df = df.filter(" and ".join(f"{a}{k} is not null" for a in axes for k in (0, 1)))
    for step in steps:
        df = df.selectExpr("*", step)
    return df


def _cell(axis: int, value: str) -> str:
    low, side, cells = (f"_leaf[{5 * axis + k}]" for k in (2, 3, 4))
    return f"least(greatest(floor(({value} - {low}) / {side}), 0), cast({cells} as bigint) - 1)"


def _sampled(left: DataFrame, right: DataFrame, axes: Sequence[str]) -> tuple[list[Extent], int]:
    """At most ``SAMPLE`` extents of both sides and the number of all, from one job."""
    ends = [f"{a}{k}" for a in axes for k in (0, 1)]
    seen = Observation()
    both = left.select(*ends).unionByName(right.select(*ends)).observe(seen, F.count(F.lit(1)).alias("rows"))
    picked = both.dropna().orderBy(F.rand(7)).limit(SAMPLE).collect()
    return [tuple((float(r[2 * n]), float(r[2 * n + 1])) for n in range(len(axes))) for r in picked], seen.get["rows"]


def partition_of(left: DataFrame, right: DataFrame, axes: Sequence[str] = ("x", "y")) -> Partition:
    """A partition that balances joins of the two sides, and of what is made from them."""
    return learn(*_sampled(left, right, axes), len(axes))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y"), partition: Partition | None = None
) -> DataFrame:
    """Pairs with equal ``keys`` whose closed extents overlap on every axis.

    Both sides carry ``{axis}0`` and ``{axis}1`` with ``{axis}0 <= {axis}1``; all columns come back prefixed ``l_`` and
    ``r_``. Rows without an end have no extent and meet nothing. Without a ``partition`` the sides are read once more to
    learn it, so pass cheap or written ones.
    """
    partition = partition or partition_of(left, right, axes)
    places = ["_part_0", "_part_1", *[f"_cell_{n}" for n in range(len(axes))]]
    lhs, rhs = (
        deal(df, axes, partition).selectExpr(*keys, *places, *(["_leaf"] if prefix == "l_" else []), *[f"`{c}` as `{prefix}{c}`" for c in df.columns])
        for df, prefix in ((left, "l_"), (right, "r_"))
    )
    rules = []
    for n, x in enumerate(axes):
        low = f"greatest(l_{x}0, r_{x}0)"
        rules += [f"{low} <= least(l_{x}1, r_{x}1)", f"{low} >= _leaf[{5 * n}]", f"{low} < _leaf[{5 * n + 1}]", f"{_cell(n, low)} = _cell_{n}"]
    met = lhs.join(rhs, [*keys, *places]).filter(" and ".join(rules))
    return met.selectExpr(*[f"`l_{c}`" for c in left.columns], *[f"`r_{c}`" for c in right.columns])
