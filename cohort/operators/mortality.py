"""Life tables and survival chains.

A schedule has one row per (year, age, sex); ``by`` names further keys such as a scenario, so
many schedules are handled in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.contracts import covers, guard, must_fail, unique
from cohort.functions.expressions import is_finite, product, single_age, spanish_number
from cohort.params import MAX_AGE, SEXES

# The labels of the published life tables.
SEX_LABELS = {"Hombres": "male", "Mujeres": "female"}
RISK, SURVIVORS = "Riesgo de muerte", "Supervivientes"
OPEN_AGE = "100 y más años"


def _sex(label: Column) -> Column:
    out = F.when(label == "Hombres", SEX_LABELS["Hombres"])
    return out.when(label == "Mujeres", SEX_LABELS["Mujeres"])


def to_qx(df: DataFrame, measure: str, units: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """Death probabilities from a qx, px or lx column; central rates are refused."""
    if measure not in ("qx", "px", "lx"):
        raise ValueError("only qx, px and lx convert to a probability")
    if units not in ("probability", "per_1000", "survivors"):
        raise ValueError("unsupported mortality units")
    rows = guard(df, {"life-table value": ~is_finite(F.col(measure)) | (F.col(measure) < 0)})
    if measure == "lx":
        return guard(lx_to_qx(rows, by), {"probability outside [0,1]": ~F.col("qx").between(0, 1)})
    value = F.col(measure) / (1000.0 if units == "per_1000" else 1.0)
    qx = value if measure == "qx" else 1.0 - value
    out = rows.select(*by, "year", "age", "sex", qx.alias("qx"))
    return guard(out, {"probability outside [0,1]": ~F.col("qx").between(0, 1)})


def lx_to_qx(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``1 - l[a+1]/l[a]``; the last age has no ratio and drops out."""
    w = Window.partitionBy(*by, "year", "sex").orderBy("age")
    after = F.when(F.lead("age").over(w) == F.col("age") + 1, F.lead("lx").over(w))
    ratio = F.when(F.col("lx") <= 0, must_fail("zero lx denominator")).otherwise(F.col("after") / F.col("lx"))
    return df.withColumn("after", after).filter("after is not null").select(*by, "year", "age", "sex", (1.0 - ratio).alias("qx"))


def survival(
    mortality: DataFrame, start_year: int, end_year: int, *, half_age: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """``(age, sex, survival)`` from ``start_year`` to ``end_year`` for each age at the start.

    Rows of one birth cohort share ``age - (year - start_year)``, so one aggregation along the
    diagonal builds every chain; no join is needed. A chain with a gap gives NULL, which callers
    turn into an error where the value is really needed.
    """
    rows = mortality
    if half_age:
        rows = guard(rows, schedule_rules())
        w = Window.partitionBy(*by, "year", "sex").orderBy("age")
        above = F.when(F.lead("age").over(w) == F.col("age") + 1, F.lead("qx").over(w))
        rows = rows.withColumn("qx", 0.5 * (F.col("qx") + above)).filter("qx is not null")
    chains = _diagonals(rows, start_year, end_year, by)
    whole = F.size("chain") == end_year - start_year
    return chains.select(*by, "age", "sex", F.when(whole, product(F.transform("chain", lambda c: 1.0 - c["qx"]))).alias("survival"))


def schedule_rules(risk: bool = True) -> dict[str, Column]:
    """Rules of a schedule's rows; with ``risk`` also that ``qx`` is a probability (a missing one shows as a gap later)."""
    rules = {
        "schedule age": F.coalesce(~F.col("age").between(0, MAX_AGE), F.lit(True)),
        "schedule sex": F.coalesce(~F.col("sex").isin(*SEXES), F.lit(True)),
    }
    return rules | ({"mortality probability outside [0,1]": ~F.col("qx").between(0, 1)} if risk else {})


def _diagonals(rows: DataFrame, start_year: int, end_year: int, by: Sequence[str], columns: Sequence[str] = ("qx",)) -> DataFrame:
    """``chain``: one struct per year, in year order, per age at ``start_year``.

    Ages and sexes outside the domain fail the job, so without ``by`` the result has at most
    131 × 2 rows, which is what lets callers broadcast tables made from it.
    """
    offset = F.col("year") - start_year
    return (
        guard(rows, schedule_rules("qx" in columns)).filter((F.col("year") >= start_year) & (F.col("year") < end_year) & (F.col("age") >= offset))
        .groupBy(*by, (F.col("age") - offset).cast("int").alias("age"), "sex")
        .agg(F.array_sort(F.collect_list(F.struct(offset.alias("step"), *columns))).alias("chain"))
    )


def national_extract(df: DataFrame, start_year: int, end_year: int, measure: str = RISK, divisor: float = 1000.0) -> DataFrame:
    """Published single-age risks (ages up to 99) as ``(year, age, sex, qx)``; each cell once and none missing."""
    age = single_age(F.col("Edad"))
    year = F.col("Periodo").try_cast("int")
    wanted = (F.col("Funciones") == measure) & F.col("Sexo").isin(*SEX_LABELS) & (year >= start_year) & (year < end_year) & (age <= 99)
    qx = spanish_number(F.col("Total")) / divisor
    out = df.filter(wanted).select(year.alias("year"), age.alias("age"), _sex(F.col("Sexo")).alias("sex"), qx.alias("qx"))
    out = guard(out, {"invalid mortality cell": F.col("qx").isNull() | ~F.col("qx").between(0, 1)})
    keys = ["year", "age", "sex"]
    return covers(unique(out, keys), required_grid(out, start_year, end_year, 99), keys)


def national_schedules(df: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """``(year, age, sex, qx, lx, lx_qx)``: risks and survivors of one file side by side."""
    age = F.when(F.col("Edad") == OPEN_AGE, 100).otherwise(single_age(F.col("Edad")))
    year = F.col("Periodo").try_cast("int")
    rows = df.filter(F.col("Funciones").isin(RISK, SURVIVORS) & F.col("Sexo").isin(*SEX_LABELS)).select(
        year.alias("year"), age.alias("age"), _sex(F.col("Sexo")).alias("sex"), "Funciones", spanish_number(F.col("Total")).alias("value")
    )
    rows = rows.filter((F.col("year") >= start_year) & (F.col("year") < end_year) & F.col("age").isNotNull())
    cells = rows.groupBy("year", "age", "sex").agg(
        F.max(F.when(F.col("Funciones") == RISK, F.col("value") / 1000.0)).alias("qx"),
        F.max(F.when(F.col("Funciones") == SURVIVORS, F.col("value"))).alias("lx"),
        F.count_if(F.col("Funciones") == RISK).alias("risks"),
        F.count_if(F.col("Funciones") == SURVIVORS).alias("lives"),
    )
    cells = guard(cells, {"duplicate life-table cell": (F.col("risks") > 1) | (F.col("lives") > 1)})
    w = Window.partitionBy("year", "sex").orderBy("age")
    after = F.when(F.lead("age").over(w) == F.col("age") + 1, F.lead("lx").over(w))
    paired = cells.withColumn("lx_qx", 1.0 - F.try_divide(after, F.col("lx")))
    out = paired.filter("age < 100").select("year", "age", "sex", "qx", "lx", "lx_qx")
    return guard(out, {"life-table cell": F.coalesce(~F.col("qx").between(0, 1) | ~F.col("lx_qx").between(0, 1), F.lit(True))})


def required_grid(df: DataFrame, start_year: int, end_year: int, top_age: int, by: Sequence[str] = ()) -> DataFrame:
    """The full (year, age, sex) domain for each ``by`` key found in ``df``."""
    base = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return (
        base.select(*by, F.explode(F.sequence(F.lit(start_year), F.lit(end_year - 1))).alias("year"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(top_age))).alias("age"))
        .select("*", F.explode(F.array(F.lit("male"), F.lit("female"))).alias("sex"))
    )


def calibrate_bands(national: DataFrame, bands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scale single-age hazards so that each closed band reproduces its published risk.

    ``bands`` has (year, sex, age_lo, age_hi, nqx) plus ``by``. Bands open to single ages and
    meet the national rows on an equality join; a band is at most the age domain wide.
    """
    ages = bands.select(
        *by, "year", "sex", "age_lo", "nqx", F.explode(F.sequence("age_lo", "age_hi")).alias("age")
    )
    ages = guard(ages, {"closed-band risk": (F.col("nqx") < 0) | (F.col("nqx") >= 1)})
    rows = ages.join(national.select(*by, "year", "age", "sex", "qx"), [*by, "year", "age", "sex"], "left")
    missing = F.coalesce((F.col("qx") < 0) | (F.col("qx") >= 1), F.lit(True))
    rows = guard(rows, {"national risk for a closed band": missing}).withColumn("h", -F.log1p(-F.col("qx")))
    w = Window.partitionBy(*by, "year", "sex", "age_lo")
    total, target = F.sum("h").over(w), -F.log1p(-F.col("nqx"))
    scaled = rows.withColumn("total", total).withColumn("target", target)
    qx = F.when((F.col("total") == 0) & (F.col("target") != 0), must_fail("cannot calibrate a zero hazard"))
    qx = qx.when(F.col("total") == 0, 0.0).otherwise(-F.expm1(-F.col("h") * F.col("target") / F.col("total")))
    return scaled.select(*by, "year", "age", "sex", qx.alias("qx"))


def regional_bands(
    df: DataFrame, region: str, start_year: int, end_year: int, region_column: str = "Comunidades y Ciudades Autónomas"
) -> DataFrame:
    """Closed bands of a regional file: ``De A a B años`` or ``0 años``; open groups are skipped."""
    year, label = F.col("Periodo").try_cast("int"), F.col("Edad")
    pattern = "^De ([0-9]+) a ([0-9]+) años$"
    low = F.when(label == "0 años", 0).otherwise(F.regexp_extract(label, pattern, 1).try_cast("int"))
    high = F.when(label == "0 años", 0).otherwise(F.regexp_extract(label, pattern, 2).try_cast("int"))
    keep = (F.col(f"`{region_column}`") == region) & F.col("Sexo").isin(*SEX_LABELS) & (F.col("Funciones") == RISK)
    out = df.filter(keep & (year >= start_year) & (year < end_year)).select(
        year.alias("year"), _sex(F.col("Sexo")).alias("sex"), low.alias("age_lo"), high.alias("age_hi"),
        (spanish_number(F.col("Total")) / 1000.0).alias("nqx"),
    )
    return out.filter("age_lo is not null")


def lx_factors(lx: DataFrame, start_year: int, end_year: int, by: Sequence[str] = ()) -> DataFrame:
    """``(age, sex, steps)``: per start age the (l[a], l[a+1]) pairs along its diagonal."""
    w = Window.partitionBy(*by, "year", "sex").orderBy("age")
    after = F.when(F.lead("age").over(w) == F.col("age") + 1, F.lead("lx").over(w))
    pairs = lx.withColumn("after", after).filter("after is not null and lx > 0")
    chains = _diagonals(pairs, start_year, end_year, by, ("lx", "after"))
    return chains.filter(F.size("chain") == end_year - start_year)


def propagate_lx(start: DataFrame, lx: DataFrame, start_year: int, end_year: int, terminal_age: int) -> DataFrame:
    """Second formulation of expected survivors: multiply and divide counts year by year.

    The factor table holds one row per start age and sex (at most 262), hence the broadcast.
    ``bound`` is the publication rounding bound of each cell.
    """
    interval = end_year - start_year
    steps = F.broadcast(lx_factors(lx, start_year, end_year))
    rows = start.filter(F.col("age") + interval < terminal_age).join(steps, ["age", "sex"], "left")
    chain = F.coalesce(F.col("chain"), must_fail("missing survivors for a required chain"))
    carried = F.aggregate(chain, F.col("population").cast("double"), lambda acc, s: acc * s["after"] / s["lx"])
    slack = F.aggregate(chain, F.lit(0.0), lambda acc, s: acc + (F.lit(0.5e-9) + F.lit(1e-6) / s["lx"]))
    return rows.select(
        "geography_id", (F.col("age") + interval).cast("int").alias("age"), "sex", "nationality",
        carried.alias("expected_lx"), (F.col("population") * slack).alias("bound"),
    )


def compare_survival(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Two survival tables side by side, with an agreement flag; a one-sided key never agrees."""
    a = left.select("age", "sex", F.col("survival").alias("survival_a"))
    b = right.select("age", "sex", F.col("survival").alias("survival_b"))
    gap = F.abs(F.col("survival_a") - F.col("survival_b"))
    return a.join(b, ["age", "sex"], "full").withColumn("agrees", F.coalesce(gap <= tolerance, F.lit(False)))


def coverage(df: DataFrame, start_year: int, end_year: int, top_age: int = 99, by: Sequence[str] = ()) -> DataFrame:
    """Per key: required, present and missing single-age cells, null values and the value range check.

    ``df`` has (year, age, sex, value) in per-mille units.
    """
    span = df.filter((F.col("year") >= start_year) & (F.col("year") < end_year))
    needed = (end_year - start_year) * (top_age + 1) * 2
    filled = F.col("value").isNotNull() & F.col("age").between(0, top_age) & F.col("sex").isin("male", "female")
    cells = span.groupBy(*by, "year", "age", "sex").agg(
        F.bool_or(filled).alias("filled"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.coalesce(F.every(F.col("value").between(0, 1000)), F.lit(True)).alias("in_range"),
    )
    out = cells.groupBy(*by).agg(
        F.lit(needed).cast("bigint").alias("required_cells"),
        F.count_if("filled").alias("present_cells"),
        F.sum("nulls").alias("missing_values"),
        F.every("in_range").alias("values_in_range"),
    )
    missing = F.col("required_cells") - F.col("present_cells")
    return out.withColumn("missing_cells", missing).withColumn("covered", (missing == 0) & (F.col("missing_values") == 0))


def missing_cells(df: DataFrame, start_year: int, end_year: int, top_age: int = 99, by: Sequence[str] = ()) -> DataFrame:
    """The required cells that ``df`` lacks."""
    grid = required_grid(df, start_year, end_year, top_age, by)
    return grid.join(df.filter("value is not null"), [*by, "year", "age", "sex"], "left_anti")


def capped_age(age: Column, top: int = 100) -> Column:
    """Terminal group of an age; NULL outside the domain."""
    return F.when(age.between(0, MAX_AGE), F.least(age, F.lit(top)))
