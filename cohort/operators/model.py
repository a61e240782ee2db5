"""The cohort core: expected survivors, residuals, composition and area totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.contracts import guard, must_fail
from cohort.functions.expressions import divide, is_finite, product, status_rank
from cohort.operators import hierarchy, mortality
from cohort.params import MAX_AGE, NATIONALITIES, SEXES, Params

MEASURES = ("baseline", "expected", "actual")
CELL = ("geography_id", "age", "sex", "nationality")


def cell_rules() -> dict[str, Column]:
    count = F.col("population").cast("double")
    return {
        "sex": F.coalesce(~F.col("sex").isin(*SEXES), F.lit(True)),
        "nationality": F.coalesce(~F.col("nationality").isin(*NATIONALITIES), F.lit(True)),
        "age": F.coalesce(~F.col("age").between(0, MAX_AGE), F.lit(True)),
        "population": F.coalesce(~is_finite(count) | (count < 0), F.lit(True)),
    }


def guarded(population: DataFrame) -> DataFrame:
    return guard(population, cell_rules())


def shift(start: DataFrame, interval: int) -> DataFrame:
    """The start stock at the age its members have reached by the end."""
    return start.withColumn("age", (F.col("age") + interval).cast("int"))


def survivors(start: DataFrame, survival_table: DataFrame, params: Params, by: Sequence[str] = ()) -> DataFrame:
    """Shifted cells with ``baseline`` and ``expected``.

    Survival is only needed where the endpoint age is below the terminal age and the count is not
    zero; there a missing chain fails the job, elsewhere expected is 0. Without ``by`` the survival
    table has at most one row per age and sex (262), which is why it is broadcast; with ``by`` its
    size is open and the planner chooses.
    """
    table = survival_table if by else F.broadcast(survival_table)
    joined = guarded(start).join(table, [*by, "age", "sex"], "left")
    needed = (F.col("age") + params.interval < params.terminal_age) & (F.col("population") != 0)
    chance = F.coalesce(F.col("survival"), must_fail("missing mortality probability"))
    expected = F.when(needed, F.col("population") * chance).otherwise(0.0)
    return shift(
        joined.select(*by, *CELL, F.col("population").cast("double").alias("baseline"), expected.alias("expected")),
        params.interval,
    )


def exact_expected(start: DataFrame, survival_table: DataFrame, tree: hierarchy.Tree, params: Params) -> DataFrame:
    """``(area_id, age, nationality, expected)``: expected survivors of each cell to nine decimals, half up, and their exact sums.

    A sum of doubles depends on its order, and so do its last digits; texts and checksums need these.
    """
    cells = survivors(start, survival_table, params).withColumn("expected", F.floor(F.col("expected") * 1e9 + 0.5).cast("decimal(28,0)"))
    summed = hierarchy.roll_up(cells, tree, ["age", "nationality"], ["expected"])
    return summed.withColumn("expected", F.col("expected").cast("decimal(27,0)") * F.lit("0.000000001").cast("decimal(10,9)"))


def combine(aged: DataFrame, end: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stack shifted and observed cells; absent sides become 0 when summed (no full outer join)."""
    zero = F.lit(0.0)
    observed = guarded(end).select(
        *by, *CELL, zero.alias("baseline"), zero.alias("expected"), F.col("population").cast("double").alias("actual")
    )
    return aged.select(*by, *CELL, "baseline", "expected", zero.alias("actual")).unionByName(observed)


def exclusion(age: Column, params: Params) -> Column:
    return F.when(age < params.interval, "born_during_interval").when(age >= params.terminal_age, "terminal_age")


def eligible(age: Column, params: Params) -> Column:
    return (age >= params.interval) & (age < params.terminal_age)


@dataclass(frozen=True)
class WindowColumns:
    """Window settings read from each row instead of one :class:`Params`."""

    min_expected: float = 20.0

    @property
    def interval(self) -> Column:
        return F.col("interval")

    @property
    def terminal_age(self) -> Column:
        return F.col("terminal_age")


def windows_table(spark: SparkSession, windows: Sequence[tuple[str, int, int, int]]) -> DataFrame:
    """``(window_id, start_year, end_year, terminal_age, interval)``: a few driver-made rows."""
    rows = [(w, y0, y1, terminal, y1 - y0) for w, y0, y1, terminal in windows]
    return spark.createDataFrame(rows, "window_id string, start_year int, end_year int, terminal_age int, interval int")


def intermediate_windows(params: Params, base_terminal: int = 90) -> list[tuple[str, int, int, int]]:
    """The fixed start cohort followed to every later year; the terminal age moves along."""
    y0 = params.start_year
    return [(f"{y0}-{y}", y0, y, base_terminal + y - y0) for y in range(y0 + 1, params.end_year + 1)]


def window_detail(
    snapshots: DataFrame, qx: DataFrame, tree: hierarchy.Tree, windows: Sequence[tuple[str, int, int, int]]
) -> DataFrame:
    """:func:`cohort_detail` for many windows of one dated population table in one job.

    The window list is driver-made, so it and the survival table (262 rows per window) are broadcast.
    """
    w = F.broadcast(windows_table(snapshots.sparkSession, windows))
    settings = ["window_id", "interval", "terminal_age"]
    start = snapshots.join(w, F.col("year") == F.col("start_year")).select(*settings, *CELL, "population")
    end = snapshots.join(w, F.col("year") == F.col("end_year")).select(*settings, *CELL, "population")
    years = F.broadcast(windows_table(snapshots.sparkSession, windows).select(
        "window_id", "interval", "start_year", F.explode(F.sequence("start_year", F.col("end_year") - 1)).alias("year")))
    step = F.col("year") - F.col("start_year")
    chains = (
        guard(qx, mortality.schedule_rules()).join(years, "year").filter(F.col("age") >= step)
        .groupBy("window_id", "interval", (F.col("age") - step).cast("int").alias("age"), "sex")
        .agg(F.array_sort(F.collect_list(F.struct(step.alias("step"), "qx"))).alias("chain"))
        .filter(F.size("chain") == F.col("interval"))
        .select("window_id", "age", "sex", product(F.transform("chain", lambda c: 1.0 - c["qx"])).alias("survival"))
    )
    params = WindowColumns()
    joined = guarded(start).join(F.broadcast(chains), ["window_id", "age", "sex"], "left")
    needed = (F.col("age") + params.interval < params.terminal_age) & (F.col("population") != 0)
    chance = F.coalesce(F.col("survival"), must_fail("missing mortality probability"))
    aged = joined.select(
        *settings, "geography_id", (F.col("age") + params.interval).cast("int").alias("age"), "sex", "nationality",
        F.col("population").cast("double").alias("baseline"),
        F.when(needed, F.col("population") * chance).otherwise(0.0).alias("expected"),
    )
    keys = [*settings, "age", "sex", "nationality"]
    summed = hierarchy.roll_up(combine(aged, end, settings), tree, keys, MEASURES)
    return _finish(summed, ["area_id", *keys], params)


def window_totals(detail: DataFrame) -> DataFrame:
    """Area totals and residual per window of :func:`window_detail`."""
    totals = area_totals(detail, WindowColumns(), ["window_id", "interval", "terminal_age"])
    return totals.withColumn("residual", F.col("actual") - F.col("expected"))


def _finish(summed: DataFrame, keys: Sequence[str], params: Params) -> DataFrame:
    ok = eligible(F.col("age"), params)
    return summed.select(
        *keys, "baseline",
        F.when(ok, F.col("expected")).alias("expected"),
        "actual", ok.alias("cohort_eligible"),
        F.when(ok, F.col("actual") - F.col("expected")).alias("residual"),
        exclusion(F.col("age"), params).alias("exclusion_reason"),
    )


def cohort_detail(
    start: DataFrame, end: DataFrame, qx: DataFrame, tree: hierarchy.Tree, params: Params,
    *, half_age: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """One row per (area, endpoint age, sex, nationality) for every area of the tree."""
    chains = mortality.survival(qx, params.start_year, params.end_year, half_age=half_age, by=by)
    cells = combine(survivors(start, chains, params, by), end, by)
    keys = [*by, "age", "sex", "nationality"]
    return _finish(hierarchy.roll_up(cells, tree, keys, MEASURES), ["area_id", *keys], params)


def profile(detail: DataFrame, params: Params, by: Sequence[str] = ()) -> DataFrame:
    """Sexes summed; a row is suppressed when it is not eligible or expects too few."""
    keys = [*by, "area_id", "age", "nationality"]
    summed = detail.groupBy(*keys).agg(*[F.sum(F.coalesce(m, F.lit(0.0))).alias(m) for m in MEASURES])
    out = _finish(summed, keys, params)
    return out.withColumn("rate_suppressed", ~F.col("cohort_eligible") | (F.col("expected") < params.min_expected))


def composition(start: DataFrame, end: DataFrame, tree: hierarchy.Tree, params: Params) -> DataFrame:
    """Observed stock of both years at its own age: (area_id, year, age, nationality, population)."""
    def stock(df: DataFrame, year: int) -> DataFrame:
        return df.select("geography_id", F.lit(year).alias("year"), "age", "nationality", F.col("population").cast("double").alias("population"))

    both = stock(start, params.start_year).unionByName(stock(end, params.end_year))
    return hierarchy.roll_up(both, tree, ["year", "age", "nationality"], ["population"])


def area_totals(detail: DataFrame, params: Params, by: Sequence[str] = ()) -> DataFrame:
    """Per area: eligible sums, and the observed stock outside the modelled ages."""
    on = F.col("cohort_eligible")
    return detail.groupBy(*by, "area_id").agg(
        *[F.coalesce(F.sum(F.when(on, F.col(m))), F.lit(0.0)).alias(m) for m in MEASURES],
        F.coalesce(F.sum(F.when(F.col("age") < params.interval, F.col("actual"))), F.lit(0.0)).alias("observed_under_interval"),
        F.coalesce(F.sum(F.when(F.col("age") >= params.terminal_age, F.col("actual"))), F.lit(0.0)).alias("observed_terminal"),
    )


def with_rates(totals: DataFrame, params: Params) -> DataFrame:
    """Residual, stock-change identity columns and rates; rates are NULL on a small or zero base."""
    residual = F.col("actual") - F.col("expected")
    sparse = F.col("expected") < params.min_expected
    rate = F.when(~sparse, divide(1000.0 * residual, F.col("expected")))
    return totals.select(
        "*", residual.alias("residual"),
        (F.col("actual") - F.col("baseline")).alias("observed_change"),
        (F.col("baseline") - F.col("expected")).alias("modelled_deaths"),
        rate.alias("residual_per_1000"),
        (rate / params.interval).alias("annualised_residual_per_1000"),
        sparse.alias("rate_suppressed"),
    )


def area_index(
    start: DataFrame, end: DataFrame, detail: DataFrame, geographies: DataFrame, tree: hierarchy.Tree, params: Params
) -> DataFrame:
    """One row per area of the tree, populated or not, with totals, rates and quality."""
    quality = hierarchy.effective_status(geographies, tree, hierarchy.leaf_totals(start, end))
    base = geographies.select("area_id", "name", "level", "parent_id").join(quality, "area_id")
    joined = base.join(area_totals(detail, params), "area_id", "left")
    filled = joined.fillna(0.0, [*MEASURES, "observed_under_interval", "observed_terminal"])
    return (
        with_rates(filled, params)
        .withColumnRenamed("effective_status", "boundary_status")
        .withColumn("default_visible", status_rank(F.col("boundary_status")) < 2)
    )


def city_summary(index: DataFrame) -> DataFrame:
    return index.filter("level = 'city'")
