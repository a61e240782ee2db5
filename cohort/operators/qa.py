"""Arithmetic invariants, feasibility and release gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.functions.expressions import divide, is_close
from cohort.operators import model
from cohort.operators.crosswalk import EXACT
from cohort.params import Params

SUMS = ("baseline", "expected", "actual", "residual")
TREE = (*SUMS, "observed_under_interval", "observed_terminal")


def _all(left: str, right: str, fields: Sequence[str]):
    out = F.lit(True)
    for f in fields:
        out = out & is_close(F.col(f"{left}{f}"), F.col(f"{right}{f}"))
    return out


def invariants(detail: DataFrame, index: DataFrame) -> DataFrame:
    """``(area_id, check_name, passed)`` for the four arithmetic checks.

    Sums of the detail, survival bounds, the stock identity, and children against their parent.
    """
    on = F.col("cohort_eligible")
    zero = F.lit(0.0)
    within = (F.col("expected") >= 0) & (F.col("expected") <= F.col("baseline") + 1e-9)
    sums = detail.groupBy("area_id").agg(
        *[F.coalesce(F.sum(F.when(on, F.col(f))), zero).alias(f"d_{f}") for f in SUMS],
        F.coalesce(F.bool_and(F.when(on, within)), F.lit(True)).alias("bounded"),
    )
    children = index.filter("parent_id is not null").groupBy(F.col("parent_id").alias("area_id")).agg(
        *[F.sum(f).alias(f"c_{f}") for f in TREE])
    fields = index.select("area_id", "observed_change", "modelled_deaths", *TREE)
    joined = fields.join(sums, "area_id", "left").join(children, "area_id", "left")
    joined = joined.fillna(0.0, [f"d_{f}" for f in SUMS]).fillna(True, ["bounded"])
    results = {
        "sex-nationality-sums": _all("d_", "", SUMS),
        "survival-bounds": F.col("bounded"),
        "stock-accounting": is_close(F.col("residual"), F.col("observed_change") + F.col("modelled_deaths")),
        "hierarchy": F.when(F.col("c_baseline").isNotNull(), _all("c_", "", TREE)),
    }
    each = F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("passed")) for n, c in results.items()])
    checks = joined.select("area_id", F.inline(each))
    return checks.filter("passed is not null")


def summary(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return checks.groupBy(*by).agg(F.every("passed").alias("passed"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


def feasibility(population: DataFrame, crosswalk: DataFrame, zones: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row: the smaller exact population share of both vintages and what it allows.

    ``population`` is (vintage, geography_id, population).
    """
    shares = status_shares(population, crosswalk)
    exact = shares.groupBy("vintage").agg(F.sum(F.when(F.col("quality_status").isin(*EXACT), F.col("share")).otherwise(0.0)).alias("exact"))
    out = exact.agg(F.min("exact").alias("exact_population_share"))
    pending = zones.agg(F.count_if("requires_review").alias("n")).scalar()
    good = F.col("exact_population_share") >= threshold
    return out.select(
        "exact_population_share", good.alias("section_gate_passed"),
        F.when(good, "section").otherwise("barrio").alias("recommended_level"), pending.alias("pending_reviews"),
    )


def status_shares(population: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Per vintage and status: population, its share and the number of crosswalk sections."""
    per_id = population.groupBy("vintage", F.col("geography_id").alias("source_id")).agg(F.sum(F.col("population").cast("double")).alias("p"))
    status = crosswalk.select("vintage", "source_id", "quality_status", F.lit(1).alias("_s")).distinct()
    joined = per_id.join(status, ["vintage", "source_id"], "full")
    sums = joined.groupBy("vintage", F.coalesce("quality_status", F.lit("unreliable")).alias("quality_status")).agg(
        F.coalesce(F.sum("p"), F.lit(0.0)).alias("population"), F.count("_s").alias("sections"))
    totals = sums.groupBy("vintage").agg(F.sum("population").alias("_t"))
    return sums.join(totals, "vintage").select(
        "vintage", "quality_status", "population", F.coalesce(divide(F.col("population"), F.col("_t")), F.lit(0.0)).alias("share"), "sections")


def independent(detail: DataFrame, propagated: DataFrame) -> DataFrame:
    """Eligible leaf cells of both formulations; ``within`` holds inside the rounding bound."""
    eligible = detail.filter("cohort_eligible").select(F.col("area_id").alias("geography_id"), "age", "sex", "nationality", "expected")
    joined = eligible.join(propagated, ["geography_id", "age", "sex", "nationality"])
    gap = F.abs(F.col("expected") - F.col("expected_lx"))
    return joined.withColumn("difference", gap).withColumn("within", gap <= F.col("bound") + 1e-7)


def independent_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("cells"), F.every("within").alias("passed"), F.max("difference").alias("maximum_difference"),
        F.sum("expected").alias("total_expected_qx"), F.sum("expected_lx").alias("total_expected_lx"), F.sum("bound").alias("total_bound"),
    )


def gates(results: DataFrame, required: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per key and required gate: passed only when a result exists and passed.

    ``results`` is (by, gate, passed). A gate without a result counts as failed.
    """
    wanted = results.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(r) for r in required])).alias("gate"))
    got = results.groupBy(*by, "gate").agg(F.every("passed").alias("passed"))
    return wanted.join(got, [*by, "gate"], "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def released(gate_table: DataFrame, by: Sequence[str]) -> DataFrame:
    """One verdict per key, with the gates that block it."""
    return gate_table.groupBy(*by).agg(
        F.every("passed").alias("released"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("blocked_by"))


def geometry_match(index: DataFrame, layers: DataFrame) -> DataFrame:
    """Areas without a polygon and polygons without an area, per level: ``(level, id, side)``."""
    a, g = index.select("level", F.col("area_id").alias("id")), layers.select("level", "id").distinct()
    only = a.join(g, ["level", "id"], "left_anti").withColumn("side", F.lit("area_only"))
    return only.unionByName(g.join(a, ["level", "id"], "left_anti").withColumn("side", F.lit("geometry_only")))


def checked_inputs(start: DataFrame, end: DataFrame) -> DataFrame:
    """Rule counts of both population tables: ``(side, rule, violations)``."""
    from cohort.contracts import violations

    a = violations(start, model.cell_rules()).withColumn("side", F.lit("start"))
    return a.unionByName(violations(end, model.cell_rules()).withColumn("side", F.lit("end")))


def arithmetic(detail: DataFrame, index: DataFrame, params: Params) -> DataFrame:
    return summary(invariants(detail, index)).withColumn("window", F.lit(f"{params.start_year}-{params.end_year}"))
