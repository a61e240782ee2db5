"""Ranks, order statistics and running sums that never sort one whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.operators.staging import stage


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], *, name: str = "row_number",
    weight: str | None = None, buckets: int = 64,
) -> DataFrame:
    """Row number of each row within its group, by ascending ``order`` (make the order unique).

    Cut points taken from a small sample split the whole (group, order) line into slices. Each
    slice is numbered on its own and shifted by the row counts of the group's earlier slices, so
    a group that holds most of the rows is still spread over many tasks. The cut points only
    balance the work; the numbers are exact for any choice of them. With ``weight`` the number is
    the running total of that column. ``df`` is read three times, so pass a written table.
    """
    key = F.struct(*group, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keyed = df.withColumn("_key", key)
    sample = keyed.select("_key", F.xxhash64("_key").alias("_h")).orderBy("_h").limit(buckets - 1)
    cuts = sample.agg(F.array_sort(F.collect_list("_key")).alias("cuts"))
    with_cuts = keyed.withColumn("_cuts", cuts.scalar())
    sliced = with_cuts.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")
    unit = F.col(weight) if weight else F.lit(1).cast("bigint")
    counts = sliced.groupBy(*group, "_slice").agg(F.sum(unit).alias("_n_slice"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_slice", F.coalesce(F.sum("_n_slice").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_slice").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    numbered = sliced.withColumn("_local", F.sum(unit).over(within))
    return (
        numbered.join(shifts, [*group, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_shift"))
        .drop("_key", "_slice", "_local", "_shift")
    )


def running_sum(
    df: DataFrame, group: Sequence[str], position: str, columns: Sequence[str], *, block: int = 8192
) -> DataFrame:
    """Running sums along an integer position, block by block, with block offsets added after."""
    blocked = df.withColumn("_block", F.floor(F.col(position) / block))
    sums = blocked.groupBy(*group, "_block").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "_block", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    within = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({f"sum_{c}": F.sum(c).over(within) for c in columns})
    joined = local.join(offsets, [*group, "_block"])
    return joined.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"_b_{c}") for c in columns}).drop(
        "_block", *[f"_b_{c}" for c in columns]
    )


def order_statistic(df: DataFrame, group: Sequence[str], column: str, fraction: float) -> DataFrame:
    """The element at ``floor((n-1)*fraction)`` of the sorted values, via counts per distinct value."""
    values = stage(df.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("_n")))
    sizes = values.groupBy(*group).agg(F.sum("_n").alias("_total"))
    joined = row_numbers(values, group, [F.col(column)], name="_upto", weight="_n").join(sizes, list(group))
    wanted = F.floor((F.col("_total") - 1) * fraction)
    hit = (F.col("_upto") > wanted) & (F.col("_upto") - F.col("_n") <= wanted)
    return joined.filter(hit).select(*group, F.col(column))
