"""Geography trees as adjacency lists: jumps, intervals, closure, guards, roll-up and quality inheritance.

What climbs the tree does so by jumps of doubling length: after the round with jumps of 2**k parents, an area's total covers
all areas less than 2**(k+1) below it. So a tree of any depth takes a logarithmic number of rounds, no round gives a row more
than one copy, and no row per area and ancestor is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import ContractError, must_fail
from cohort.functions.expressions import divide, rank_status, status_rank
from cohort.operators.ordering import row_numbers
from cohort.operators.staging import stage


@dataclass(frozen=True)
class Tree:
    """Written tables ``(area_id, up)``: step k leads 2**k parents up. Step 0 has every area, with no ``up`` at a root."""

    steps: tuple[DataFrame, ...]

    @property
    def areas(self) -> DataFrame:
        return self.steps[0].select("area_id")


def tree(geographies: DataFrame) -> Tree:
    """The jumps of a parent table. An unknown parent or a cycle fails."""
    nodes = geographies.select("area_id", "parent_id")
    known = nodes.select(F.col("area_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    up = F.when(F.col("parent_id").isNotNull() & F.col("_known").isNull(), must_fail("unknown parent")).otherwise(F.col("parent_id"))
    steps = [stage(nodes.join(known, "parent_id", "left").select("area_id", up.alias("up")))]
    most = steps[0].count().bit_length()
    while True:
        last = steps[-1]
        further = stage(last.filter("up is not null").join(last.select(F.col("area_id").alias("up"), F.col("up").alias("_up")), "up").filter("_up is not null").select("area_id", F.col("_up").alias("up")))
        if further.isEmpty():
            return Tree(tuple(steps))
        if len(steps) > most:  # a path without a cycle is no longer than there are areas
            raise ContractError("parent cycle")
        steps.append(further)


def lift(rows: DataFrame, tree_: Tree, keys: Sequence[str], aggregates: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Aggregate the columns of ``area_id`` rows over each area and all below it; areas without rows below have none.

    Aggregates must be such that totals can be aggregated again: sums, minima, maxima. An id outside the tree fails the job.
    """
    totals = [f(c).alias(c) for c, f in aggregates.items()]
    for n, step in enumerate(tree_.steps):
        to = step.select("area_id", F.col("up").alias("_up"), F.lit(True).alias("_known"))
        own = F.col("area_id") if n else F.when(F.col("_known"), F.col("area_id")).otherwise(must_fail("population contains unknown geographies"))
        targets = F.explode(F.when(F.col("_up").isNull(), F.array(own)).otherwise(F.array(own, "_up")))
        rows = rows.join(to, "area_id", "left").select(targets.alias("area_id"), *keys, *aggregates).groupBy("area_id", *keys).agg(*totals)
    return rows


def intervals(tree_: Tree) -> DataFrame:
    """``(area_id, low, high, depth)``: places in preorder, children by id. An area's subtree is the places from low to high.

    So whether one area lies in another is a comparison of numbers, and a subtree is a range of a table sorted by place.
    """
    kin = F.coalesce(F.concat(F.lit("+"), "up"), F.lit(""))
    sized = lift(tree_.areas.withColumn("n", F.lit(1).cast("bigint")), tree_, [], {"n": F.sum}).join(tree_.steps[0], "area_id")
    placed = row_numbers(stage(sized.withColumn("kin", kin)), ["kin"], [F.col("area_id")], name="_upto", weight="n")
    # A place is the sum, over the area and all above it, of the places taken by elder siblings' subtrees and by the parent.
    child = F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")
    at = stage(placed.select("area_id", "n", (F.col("_upto") - F.col("n") + child).alias("low"), child.alias("depth")))
    for step in tree_.steps:
        above = at.select(F.col("area_id").alias("up"), F.col("low").alias("_low"), F.col("depth").alias("_depth"))
        more = step.filter("up is not null").join(above, "up").drop("up")
        at = stage(at.join(more, "area_id", "left").select("area_id", "n", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("low", "depth")]))
    return at.select("area_id", "low", (F.col("low") + F.col("n") - 1).alias("high"), "depth")


def closure(geographies: DataFrame) -> DataFrame:
    """``(area_id, ancestor_id, depth)`` for every area and each ancestor, itself included.

    Paths are built among the areas that are parents, a small part of the table: each round appends to a path the path of
    the area it ends at, so their lengths double and a tree of any depth takes a logarithmic number of written rounds.
    Every area then takes its parent's path in one join whose keys repeat only by direct children. An unknown parent or a
    cycle fails the job.
    """
    nodes = geographies.select("area_id", "parent_id")
    named = nodes.select(F.col("parent_id").alias("area_id")).filter("area_id is not null").distinct()
    inner = nodes.join(named, "area_id", "left_semi")
    path = stage(inner.select("area_id", F.array("area_id").alias("path"), F.col("parent_id").alias("_next")))
    while not path.filter("_next is not null").isEmpty():
        above = path.select(F.col("area_id").alias("_next"), F.col("path").alias("_path"), F.col("_next").alias("_after"))
        met = F.coalesce("_path", must_fail("unknown parent"))
        # Paths of a cycle never end; within log2 of its length one of them meets itself.
        longer = F.when(F.arrays_overlap("path", met), must_fail("parent cycle")).otherwise(F.concat("path", met))
        path = stage(path.join(above, "_next", "left").select(
            "area_id", F.when(F.col("_next").isNull(), F.col("path")).otherwise(longer).alias("path"), F.col("_after").alias("_next")))
    above = path.select(F.col("area_id").alias("parent_id"), F.col("path").alias("above"))
    whole = F.when(F.col("parent_id").isNull(), F.array("area_id")).otherwise(
        F.concat(F.array("area_id"), F.coalesce("above", must_fail("unknown parent"))))
    return stage(nodes.join(above, "parent_id", "left").select("area_id", F.posexplode(whole).alias("depth", "ancestor_id")))


def unreachable(geographies: DataFrame) -> DataFrame:
    """Areas that break the tree contract: ``(area_id, problem)``.

    Every area points at its parent, and each round moves the pointers twice as far. A path without a cycle is at most as
    long as there are areas, so the rounds end after log2 of their number: whoever still points somewhere is on or below a cycle.
    """
    nodes = geographies.select("area_id", "parent_id")
    known = nodes.select(F.col("area_id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    joined = nodes.join(known, "parent_id", "left")
    unknown = F.col("parent_id").isNotNull() & F.col("_known").isNull()
    at = stage(joined.select("area_id", F.when(F.col("_known"), F.col("parent_id")).alias("up"), unknown.alias("direct"), unknown.alias("lost")))
    for _ in range(at.count().bit_length()):
        if at.filter("up is not null").isEmpty():
            break
        above = at.select(F.col("area_id").alias("up"), F.col("up").alias("_up"), F.col("lost").alias("_lost"))
        at = stage(at.join(above, "up", "left").select("area_id", F.col("_up").alias("up"), "direct", F.coalesce("_lost", "lost").alias("lost")))
    label = F.when(F.col("direct"), "unknown_parent").otherwise("cycle_or_below_unknown")
    return at.filter("lost or up is not null").select("area_id", label.alias("problem"))


def mixed_grain(leaves: DataFrame, tree_: Tree) -> DataFrame:
    """Populated areas that are proper ancestors of other populated areas; must be empty."""
    ids = leaves.select("area_id").distinct()
    below = lift(ids.withColumn("n", F.lit(1).cast("bigint")), tree_, [], {"n": F.sum})
    return ids.join(below.filter("n > 1"), "area_id", "left_semi")


def roll_up(facts: DataFrame, tree_: Tree, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum additive measures of ``geography_id`` rows into every area and its ancestors (``area_id``).

    The sums are combined on the map side, so the root key costs one row per task and group. An id outside the tree fails
    the job.
    """
    return lift(facts.withColumnRenamed("geography_id", "area_id"), tree_, keys, {m: F.sum for m in measures})


def leaf_totals(start: DataFrame, end: DataFrame) -> DataFrame:
    """``(geography_id, total)``: start stock per populated leaf; leaves only seen at the end give 0."""
    seen = end.select("geography_id", F.lit(0.0).alias("population"))
    stock = start.select("geography_id", F.col("population").cast("double").alias("population"))
    return stock.unionByName(seen).groupBy("geography_id").agg(F.sum("population").alias("total"))


def effective_status(geographies: DataFrame, tree_: Tree, leaves: DataFrame) -> DataFrame:
    """Per area: the worst status of itself and its populated leaves, and the affected share.

    ``leaves`` is :func:`leaf_totals`; the share is start stock in leaves of rank 2 or worse.
    """
    ranks = geographies.select("area_id", status_rank(F.col("boundary_status")).alias("worst"))
    weighted = leaves.withColumnRenamed("geography_id", "area_id").join(ranks, "area_id").withColumn("affected", F.when(F.col("worst") >= 2, F.col("total")).otherwise(0.0))
    below = lift(weighted, tree_, [], {"worst": F.max, "total": F.sum, "affected": F.sum})
    own = status_rank(F.col("boundary_status"))
    return geographies.join(below, "area_id", "left").select(
        "area_id",
        rank_status(F.greatest(own, F.coalesce("worst", F.lit(0)))).alias("effective_status"),
        F.coalesce(divide(F.col("affected"), F.col("total")), F.lit(0.0)).alias("affected_share"),
    )


def parent_mismatch(geographies: DataFrame, assigned: DataFrame) -> DataFrame:
    """Supplied parents that differ from audited ones ``(area_id, parent_id)``, both sides covered."""
    ours = geographies.select("area_id", F.col("parent_id").alias("supplied"))
    theirs = assigned.select("area_id", F.col("parent_id").alias("audited"))
    return ours.join(theirs, "area_id", "right").filter(~F.col("supplied").eqNullSafe(F.col("audited")))
