"""Scenario variants: comparisons, births of baseline women, nationality transfers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import guard, must_fail, required
from cohort.functions.expressions import divide
from cohort.operators import hierarchy, model, mortality
from cohort.params import Params

# Fixed value: share of boys among births.
MALE_SHARE = 0.512


def compare(base: DataFrame, variants: DataFrame) -> DataFrame:
    """Each (scenario, area) against the base run: differences in expected survivors."""
    reference = base.select("area_id", F.col("expected").alias("_base"))
    gap = F.col("expected") - F.col("_base")
    return variants.join(reference, "area_id").select(
        "scenario", "area_id", "expected", "residual",
        gap.alias("expected_difference"),
        (divide(F.col("expected"), F.col("_base")) - 1).alias("relative_difference"),
    )


def material(comparison: DataFrame, threshold: float = 0.005, scenario: str = "half_age") -> DataFrame:
    """Rows of the timing variant whose relative difference exceeds the threshold."""
    return comparison.filter((F.col("scenario") == scenario) & (F.abs("relative_difference") > threshold))


def _chains(qx: DataFrame, params: Params) -> DataFrame:
    """``(age, sex, q)``: the risks along each diagonal as an array, at most 262 short rows."""
    rows = mortality._diagonals(qx, params.start_year, params.end_year, ())
    return rows.select("age", "sex", F.transform("chain", lambda c: c["qx"]).alias("q"))


def _alive(q: Column, first: Column, count: Column) -> Column:
    return F.aggregate(F.slice(q, first, count), F.lit(1.0), lambda acc, x: acc * (1.0 - x))


def birth_rates(qx: DataFrame, fertility: DataFrame, params: Params) -> DataFrame:
    """``(age, year, rate)``: births per woman of each start age in each year of the window.

    A woman still has to be alive; mid-year exposure averages the year's start and end. Every age
    has its rows, with a null rate where its mortality is missing, so no woman drops out.
    """
    ages = qx.sparkSession.range(50).select(F.col("id").cast("int").alias("age"))
    chains = ages.join(_chains(qx, params).filter("sex = 'female'").drop("sex"), "age", "left")
    steps = chains.select("age", "q", F.explode(F.sequence(F.lit(0), F.lit(params.interval - 1))).alias("step"))
    steps = steps.filter(F.col("age") + F.col("step") <= 49)
    whole = F.size("q") > F.col("step")
    reach = F.when(whole, _alive(F.col("q"), F.lit(1), F.col("step")))
    mid = reach * (1.0 + (1.0 - F.get("q", F.col("step")))) / 2
    year = (F.col("step") + params.start_year).cast("int")
    rows = steps.select("age", year.alias("year"), (F.col("age") + F.col("step")).alias("_at"), mid.alias("exposure"))
    rates = guard(fertility, {"fertility rate": ~F.col("asfr_per_1000").between(0, 1000)})
    rates = rates.groupBy("year", F.col("age").alias("_at")).agg(F.max("asfr_per_1000").alias("asfr_per_1000"), F.count(F.lit(1)).alias("_rows"))
    rates = guard(rates, {"repeated fertility cell": F.col("_rows") > 1}).drop("_rows")
    fertile = rows.filter(F.col("_at").between(15, 49)).join(rates, ["year", "_at"], "left")
    rate = required(F.col("asfr_per_1000"), "missing fertility") / 1000 * F.col("exposure")
    return fertile.select("age", "year", rate.alias("rate"))


def births(start: DataFrame, qx: DataFrame, fertility: DataFrame, params: Params) -> DataFrame:
    """``(area_id, year, births)`` to women of the start stock, nationalities together.

    The rate table has at most 50 ages × the window's years, hence the broadcast.
    """
    women = (
        start.filter("sex = 'female' and age <= 49")
        .groupBy(F.col("geography_id").alias("area_id"), "age")
        .agg(F.sum(F.col("population").cast("double")).alias("women"))
    )
    table = F.broadcast(birth_rates(qx, fertility, params))
    joined = women.join(table, "age", "left")
    value = F.col("women") * F.when(F.col("year").isNotNull(), required(F.col("rate"), "missing mortality probability"))
    return joined.filter("year is not null").groupBy("area_id", "year").agg(F.sum(value).alias("births"))


def child_survival(qx: DataFrame, params: Params, male_share: float = MALE_SHARE) -> DataFrame:
    """``(year, sex, age, factor)``: sex share × half a year of infant risk × later years."""
    if not 0 < male_share < 1:
        raise ValueError("the male share of births must lie inside (0, 1)")
    qx = guard(qx, mortality.schedule_rules())
    infants = qx.filter(
        (F.col("age") == 0) & (F.col("year") >= params.start_year) & (F.col("year") < params.end_year)
    ).groupBy("year", "sex").agg(F.max("qx").alias("q0"), F.count(F.lit(1)).alias("_rows"))
    infants = guard(infants, {"repeated infant mortality": F.col("_rows") > 1}).drop("_rows")
    # A child born in year y is 1 at the start of y + 1 and then follows one diagonal.
    born = F.col("year") - F.col("age")
    later = (
        qx.filter((F.col("age") >= 1) & (F.col("year") < params.end_year) & (born >= params.start_year))
        .groupBy(born.cast("int").alias("year"), "sex")
        .agg(F.array_sort(F.collect_list(F.struct("age", "qx"))).alias("chain"))
    )
    years = params.end_year - 1 - F.col("year")
    length = F.coalesce(F.size("chain"), F.lit(0))
    alive = F.when(years == 0, 1.0).when(
        length == years, F.aggregate("chain", F.lit(1.0), lambda acc, c: acc * (1.0 - c["qx"]))
    ).otherwise(must_fail("missing child mortality"))
    share = F.when(F.col("sex") == "male", male_share).otherwise(1 - male_share)
    return infants.join(later, ["year", "sex"], "left").select(
        "year", "sex", years.cast("int").alias("age"), (share * F.sqrt(1.0 - F.col("q0")) * alive).alias("factor")
    )


def children(births_: DataFrame, qx: DataFrame, params: Params, male_share: float = MALE_SHARE) -> DataFrame:
    """``(area_id, age, sex, expected)``: surviving children at the end; two factors per year."""
    table = F.broadcast(child_survival(qx, params, male_share))
    joined = births_.join(table, "year", "left")
    value = F.col("births") * required(F.col("factor"), "missing infant mortality")
    return joined.select("area_id", "age", "sex", value.alias("expected"))


def transfer_factors(qx: DataFrame, hazards: DataFrame, params: Params, multipliers: Sequence[float]) -> DataFrame:
    """``(multiplier, age, sex, factor)``: share of a foreign stock that changes group and survives.

    In each year the remaining stock gives ``min(h·m, 1)`` at the start of the year; those who
    changed and those who did not face the same risks, so both survive along one diagonal and
    the yearly credits of a start age fall on one endpoint age.
    """
    both = qx.join(hazards.select("year", "age", "sex", "hazard"), ["year", "age", "sex"])
    both = guard(both, {"hazard outside [0,1]": ~F.col("hazard").between(0, 1)})
    rows = mortality._diagonals(both, params.start_year, params.end_year, (), ("qx", "hazard"))
    rows = rows.filter(F.size("chain") == params.interval)
    rows = rows.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))

    def take(h: Column) -> Column:
        return F.least(h * F.col("multiplier"), F.lit(1.0))

    # State: the untouched share and the changed share, both net of deaths so far.
    zero = F.struct(F.lit(1.0).alias("kept"), F.lit(0.0).alias("moved"))
    final = F.aggregate(
        "chain", zero,
        lambda s, c: F.struct(
            (s["kept"] * (1.0 - take(c["hazard"])) * (1.0 - c["qx"])).alias("kept"),
            ((s["moved"] + s["kept"] * take(c["hazard"])) * (1.0 - c["qx"])).alias("moved"),
        ),
    )
    return rows.select("multiplier", "age", "sex", final["moved"].alias("factor"))


def nationality(
    start: DataFrame, qx: DataFrame, hazards: DataFrame, params: Params, multipliers: Sequence[float] = (0.5, 1.0, 1.5)
) -> DataFrame:
    """Per multiplier and endpoint cell: what moves from EXT to ESP; the total does not change."""
    table = F.broadcast(transfer_factors(qx, hazards, params, multipliers))
    foreign = (
        start.filter("nationality = 'EXT'")
        .groupBy(F.col("geography_id").alias("area_id"), "age", "sex")
        .agg(F.sum(F.col("population").cast("double")).alias("stock"))
    )
    joined = foreign.join(table, ["age", "sex"], "left")
    moved = F.col("stock") * required(F.col("factor"), "missing hazard or mortality")
    return joined.select(
        "multiplier", "area_id", (F.col("age") + params.interval).cast("int").alias("age"), "sex",
        (-moved).alias("esp"), moved.alias("ext"), F.lit(0.0).alias("total"),
    )


def eligible_start(df: DataFrame, params: Params) -> DataFrame:
    """Cells young enough at the start to stay below the terminal age."""
    return df.filter(F.col("age") + params.interval < params.terminal_age)


def tier(geographies: DataFrame, statuses: Sequence[str] = ("unchanged", "exact_harmonisation")) -> DataFrame:
    """The exact tier: areas of those statuses; a parent outside the tier fails the job."""
    kept = geographies.filter(F.col("boundary_status").isin(*statuses))
    parents = kept.select(F.col("area_id").alias("parent_id"), F.lit(True).alias("_known"))
    joined = kept.join(parents, "parent_id", "left")
    orphan = F.col("parent_id").isNotNull() & F.col("_known").isNull()
    return guard(joined, {"parent outside the tier": orphan}).select(*geographies.columns)


@dataclass(frozen=True)
class Variant:
    """A named variant: the schedule whose survival it uses, and the age its modelled groups end below."""

    name: str
    schedule: str
    terminal_age: int


def variant_totals(
    start: DataFrame, end: DataFrame, chains: DataFrame, tree: hierarchy.Tree, params: Params, variants: Sequence[str | Variant]
) -> DataFrame:
    """Area totals of every variant: (scenario, terminal_age, area_id, baseline, expected, actual, residual).

    Variants may share schedules and end at ages of their own; a plain name is a schedule that ends at the window's terminal
    age. Actual and baseline do not depend on the schedule, and both population tables are read once whatever the variants:
    cells are summed by the spans between terminal ages, and a variant adds up the spans below its own. ``chains`` is a
    survival table per schedule, at most 262 rows each; a schedule needs survival only below its highest terminal age.
    """
    wanted = [Variant(v, v, params.terminal_age) if isinstance(v, str) else v for v in variants]
    if len({v.name for v in wanted}) < len(wanted):
        raise ValueError("repeated variant name")
    schedules = list(dict.fromkeys(v.schedule for v in wanted))
    cuts = sorted({v.terminal_age for v in wanted})
    last = {s: max(v.terminal_age for v in wanted if v.schedule == s) for s in schedules}
    per_cell = chains.groupBy("age", "sex").agg(F.map_from_entries(F.collect_list(F.struct("scenario", "survival"))).alias("_s"))
    joined = model.guarded(start).join(F.broadcast(per_cell), ["age", "sex"], "left")
    zero = F.lit(0.0)

    def value(name: str) -> Column:
        needed = (F.col("age") + params.interval < last[name]) & (F.col("population") != 0)
        chance = required(F.try_element_at("_s", F.lit(name)), f"missing mortality probability in {name}")
        return F.when(needed, F.col("population") * chance).otherwise(0.0)

    aged = model.shift(joined.select(
        "geography_id", "age", F.col("population").cast("double").alias("baseline"), zero.alias("actual"),
        *[value(n).alias(f"_e{i}") for i, n in enumerate(schedules)]), params.interval)
    seen = model.guarded(end).select(
        "geography_id", "age", zero.alias("baseline"), F.col("population").cast("double").alias("actual"),
        *[zero.alias(f"_e{i}") for i in range(len(schedules))])
    columns = ["baseline", "actual", *[f"_e{i}" for i in range(len(schedules))]]
    # Ages and sexes are summed before the roll-up: one row per leaf climbs the tree.
    spans = [(F.col("age") >= low) & (F.col("age") < high) for low, high in zip([params.interval, *cuts], cuts, strict=False)]
    sums = [F.sum(F.when(span, F.col(c)).otherwise(zero)).alias(f"{c}_{k}") for c in columns for k, span in enumerate(spans)]
    leaves = aged.unionByName(seen).groupBy("geography_id").agg(*sums)
    areas = hierarchy.roll_up(leaves, tree, [], [f"{c}_{k}" for c in columns for k in range(len(spans))])

    def total(column: str, terminal: int) -> Column:
        return reduce(Column.__add__, [F.col(f"{column}_{k}") for k, cut in enumerate(cuts) if cut <= terminal])

    each = F.inline(F.array(*[
        F.struct(F.lit(v.name).alias("scenario"), F.lit(v.terminal_age).alias("terminal_age"), total("baseline", v.terminal_age).alias("baseline"),
                 total(f"_e{schedules.index(v.schedule)}", v.terminal_age).alias("expected"), total("actual", v.terminal_age).alias("actual")) for v in wanted]))
    return areas.select("area_id", each).select(
        "scenario", "terminal_age", "area_id", "baseline", "expected", "actual", (F.col("actual") - F.col("expected")).alias("residual"))
