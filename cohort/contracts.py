"""Contract rules: count violations in one pass, or stop the job at the first one.

``guard`` puts the rules inside the plan, so a bad row fails the job that reads it and no
second scan is needed. ``violations`` and ``enforce`` give the counts per rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Input breaks a stated contract; nothing downstream may be published."""


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, violations)``; each rule is a column that is true on a bad row."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def enforce(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Raise with every broken rule and its count; otherwise return the frame unchanged."""
    broken = violations(df, rules).filter("violations > 0").collect()
    if broken:
        raise ContractError("; ".join(f"{r.rule}: {r.violations} rows" for r in broken))
    return df


def guard(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The same rules evaluated lazily, row by row, inside the plan."""
    verdict = F.coalesce(*[F.when(bad, must_fail(name)) for name, bad in rules.items()], F.lit(True))
    return df.filter(verdict)


def must_fail(message: str | Column) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(f"contract: {message}"))


def required(value: Column, message: str) -> Column:
    """The value, or a failed job when it is null."""
    return F.coalesce(value, must_fail(message))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    first = duplicates(df, keys).take(3)
    if first:
        raise ContractError(f"duplicate key {list(keys)}: {[tuple(r)[:-1] for r in first]}")
    return df


def guard_groups(df: DataFrame, by: Sequence[str], *, single: Mapping[str, Column] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rules on whole groups inside the plan: the table is read once and shuffled once, by ``by``.

    In each group every column of ``single`` must have one value, and each combination of ``by`` and ``keys`` may come once.
    Groups that keep the rules are small, so use keys whose groups are bounded by the other columns' domains.
    """
    group, key = Window.partitionBy(*by), Window.partitionBy(*by, *keys)
    rules = {name: F.min(c).over(group) != F.max(c).over(group) for name, c in (single or {}).items()}
    if keys:
        rules[f"duplicate key {[*by, *keys]}"] = F.count(F.lit(1)).over(key) > 1
    marked = df.withColumns({f"_rule_{n}": bad for n, bad in enumerate(rules.values())})
    return guard(marked, {name: F.coalesce(F.col(f"_rule_{n}"), F.lit(False)) for n, name in enumerate(rules)}).select(*df.columns)


def coverage_gaps(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys wanted but absent (``missing``) and present but not wanted (``unexpected``); missing values are equal.

    One aggregation over both sides tells where a key was seen, so each is read and shuffled once.
    """
    sides = [side.select(*keys, F.lit(have).alias("_have")) for side, have in ((df, True), (wanted, False))]
    seen = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.bool_or("_have").alias("_have"), F.bool_and("_have").alias("_only"))
    gap = F.when(~F.col("_have"), "missing").when(F.col("_only"), "unexpected")
    return seen.select(*keys, gap.alias("gap")).filter("gap is not null")


def covers(df: DataFrame, wanted: DataFrame, keys: Sequence[str], *, exact: bool = True) -> DataFrame:
    gaps = coverage_gaps(df, wanted, keys)
    if not exact:
        gaps = gaps.filter("gap = 'missing'")
    first = gaps.take(3)
    if first:
        raise ContractError(f"coverage of {list(keys)} differs: {[tuple(r) for r in first]}")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df
