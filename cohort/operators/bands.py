"""Age bands, presets, ranks and the questions a reader of the results asks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.contracts import guard
from cohort.functions.expressions import divide, status_rank
from cohort.operators import ordering
from cohort.operators.staging import stage
from cohort.params import NATIONALITIES, Params


def presets(spark: SparkSession, params: Params) -> DataFrame:
    """``(preset, age_min, age_max)``: a dozen driver-made rows."""
    return spark.createDataFrame(params.presets(), "preset string, age_min int, age_max int")


def band_ages(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bands opened to single ages, so profile rows meet them on an equality join."""
    return bands.select(*keys, F.explode(F.sequence("age_min", "age_max")).alias("age"))


def _aggregates() -> list:
    on = F.col("cohort_eligible")
    return [
        F.sum("actual").alias("_observed"),
        F.sum(F.when(on, F.col("expected"))).alias("_expected"),
        F.sum(F.when(on, F.col("baseline"))).alias("_baseline"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(on).alias("_eligible"),
    ]


def _finish(df: DataFrame, keys: Sequence[str], min_expected: float) -> DataFrame:
    """A band with any excluded row present has no residual, and no rows at all count as 0."""
    valid = F.coalesce((F.col("_eligible") > 0) & (F.col("_eligible") == F.col("_rows")), F.lit(False))
    observed, expected = F.coalesce("_observed", F.lit(0.0)), F.coalesce("_expected", F.lit(0.0))
    residual = observed - expected
    enough = valid & (expected >= min_expected)
    return df.select(
        *keys,
        observed.alias("actual"),
        F.when(valid, expected).alias("expected"),
        F.when(valid, residual).alias("residual"),
        F.when(valid, F.col("_baseline")).alias("baseline"),
        F.when(enough, divide(1000.0 * residual, expected)).alias("residual_per_1000"),
        expected.alias("denominator"),
        (~enough).alias("rate_suppressed"),
        valid.alias("cohort_eligible"),
    )


def summarise(profile: DataFrame, bands: DataFrame, params: Params, keys: Sequence[str] = ("area_id",)) -> DataFrame:
    """Band summary per key and ``preset``; only bands with at least one row.

    ``bands`` is driver-made and opens to at most 131 ages per preset, hence the broadcast.
    """
    ages = F.broadcast(band_ages(bands, ["preset"]))
    grouped = profile.join(ages, "age").groupBy(*keys, "preset").agg(*_aggregates())
    return _finish(grouped, [*keys, "preset"], params.min_expected)


def indicators(profile: DataFrame, index: DataFrame, params: Params) -> DataFrame:
    """Every area × preset, empty ones included, with the area's status and affected share."""
    spark = profile.sparkSession
    names = F.array(*[F.lit(p[0]) for p in params.presets()])
    grid = index.select("area_id", "level", "name", "boundary_status", "affected_share", F.explode(names).alias("preset"))
    ages = F.broadcast(band_ages(presets(spark, params), ["preset"]))
    grouped = profile.join(ages, "age").groupBy("area_id", "preset").agg(*_aggregates())
    keys = ["area_id", "preset", "level", "name", "boundary_status", "affected_share"]
    return _finish(grid.join(grouped, ["area_id", "preset"], "left"), keys, params.min_expected)


def five_year(profile: DataFrame, index: DataFrame, params: Params, width: int = 5) -> DataFrame:
    """Every area × band × nationality below the terminal age; the top band is clipped."""
    top = params.terminal_age - 1
    lows = F.sequence(F.lit(0), F.lit(top), F.lit(width))
    grid = index.select("area_id", F.explode(lows).alias("age_min")).select(
        "*", F.explode(F.array(*[F.lit(n) for n in NATIONALITIES])).alias("nationality")
    )
    low = (F.floor(F.col("age") / width) * width).cast("int")
    grouped = (
        profile.filter(F.col("age") <= top)
        .groupBy("area_id", low.alias("age_min"), "nationality")
        .agg(*_aggregates())
    )
    keys = ["area_id", "age_min", "age_max", "nationality"]
    joined = grid.join(grouped, ["area_id", "age_min", "nationality"], "left")
    return _finish(joined.withColumn("age_max", F.least(F.col("age_min") + (width - 1), F.lit(top))), keys, params.min_expected)


def rank(table: DataFrame, buckets: int = 64) -> DataFrame:
    """Rank within (level, preset) by rate, highest first, among exact areas with a rate.

    Ties follow name, then area id. Others keep a NULL rank. The table is written first because
    numbering reads it several times.
    """
    table = stage(table)
    ranked = F.col("residual_per_1000").isNotNull() & (status_rank(F.col("boundary_status")) <= 1)
    numbered = ordering.row_numbers(
        table.filter(ranked), ["level", "preset"], [-F.col("residual_per_1000"), F.col("name"), F.col("area_id")],
        name="rank", buckets=buckets,
    )
    rest = table.filter(F.coalesce(~ranked, F.lit(True))).withColumn("rank", F.lit(None).cast("bigint"))
    return numbered.unionByName(rest)


def custom_range(profile: DataFrame, index: DataFrame, low: int, high: int, params: Params) -> DataFrame:
    """Summary of one age range chosen by a reader, for every area."""
    if not 0 <= low <= high <= 130:
        raise ValueError("age range must satisfy 0 <= low <= high <= 130")
    grouped = profile.filter(F.col("age").between(low, high)).groupBy("area_id").agg(*_aggregates())
    out = _finish(index.select("area_id").join(grouped, "area_id", "left"), ["area_id"], params.min_expected)
    return out.select("area_id", "actual", "expected", "residual", "residual_per_1000")


def variable_bands(profile: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Bands of any width with the residual of both nationalities; empty bands are left out."""
    start = (F.floor((F.col("age") - low) / width) * width + low).cast("int")
    by_nation = [
        F.coalesce(F.sum(F.when(F.col("nationality") == n, F.col("residual"))), F.lit(0.0)).alias(f"residual_{n.lower()}")
        for n in NATIONALITIES
    ]
    grouped = (
        profile.filter(F.col("age").between(low, high))
        .groupBy("area_id", start.alias("age_min"))
        .agg(*_aggregates(), *by_nation)
    )
    keys = ["area_id", "age_min", "age_max", "residual_esp", "residual_ext"]
    done = _finish(grouped.withColumn("age_max", F.least(F.col("age_min") + (width - 1), F.lit(high))), keys, 0.0)
    return done.select(*keys, "actual", "expected", "residual", "residual_per_1000")


def shares(composition: DataFrame, low: int, high: int, width: int = 5) -> DataFrame:
    """Stock and percent share of each nationality by area, year and band."""
    start = (F.floor((F.col("age") - low) / width) * width + low).cast("int")
    def stock(n: str):
        return F.coalesce(F.sum(F.when(F.col("nationality") == n, F.col("population"))), F.lit(0.0))
    grouped = (
        composition.filter(F.col("age").between(low, high))
        .groupBy("area_id", "year", start.alias("age_min"))
        .agg(stock("ESP").alias("esp"), stock("EXT").alias("ext"))
        .withColumn("total", F.col("esp") + F.col("ext"))
        .filter("total <> 0")
    )
    return grouped.withColumn("esp_share", divide(100.0 * F.col("esp"), F.col("total"))).withColumn(
        "ext_share", divide(100.0 * F.col("ext"), F.col("total"))
    )


def robust_extent(table: DataFrame, column: str, group: Sequence[str], fraction: float = 0.95) -> DataFrame:
    """Symmetric colour extent: the 95 % order statistic of |value|; 0 becomes 1."""
    sized = table.select(*group, F.abs(F.col(column)).alias("extent"))
    found = ordering.order_statistic(sized, group, "extent", fraction)
    return found.withColumn("extent", F.when(F.col("extent") == 0, 1.0).otherwise(F.col("extent")))


def listing(table: DataFrame, level: str, preset: str, by: str = "residual_per_1000") -> DataFrame:
    """Areas of a level for a preset, best first, nulls last; unreliable areas keep only ``actual``."""
    chosen = table.filter((F.col("level") == level) & (F.col("preset") == preset))
    hide = F.col("boundary_status") == "unreliable"
    shown = chosen.select(
        "area_id", "name", "boundary_status", "actual",
        *[F.when(~hide, F.col(c)).alias(c) for c in ("expected", "residual", "residual_per_1000")],
    )
    return shown.orderBy(F.col(by).desc_nulls_last(), "name", "area_id")


def validated(table: DataFrame) -> DataFrame:
    """Fail on bands that are inverted or outside the age domain."""
    bad = (F.col("age_min") < 0) | (F.col("age_max") > 130) | (F.col("age_min") > F.col("age_max"))
    return guard(table, {"age band": bad})
