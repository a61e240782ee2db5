"""Control totals: matching, reconciliation, conditional zero fill and row equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import ContractError, covers, guard
from cohort.functions.expressions import divide
from cohort.operators.normalise import COUNT_COLUMNS, OPEN_LABEL, unpivot


def by_sex(profiles: DataFrame, published: DataFrame) -> DataFrame:
    """Known counts of snapshots against published totals by sex.

    ``profiles`` has (year, known_male, known_female); ``published`` (year, male, female, total).
    """
    joined = profiles.join(published, "year")
    total = F.col("known_male") + F.col("known_female")
    d = {"male": F.col("known_male") - F.col("male"), "female": F.col("known_female") - F.col("female"), "total": total - F.col("total")}
    same = (d["male"] == 0) & (d["female"] == 0) & (d["total"] == 0)
    return joined.select(
        "year", total.alias("known_total"), *[c.alias(f"difference_{n}") for n, c in d.items()],
        divide(100.0 * d["total"], F.col("total")).alias("difference_percent"),
        F.when(same, "exact_match").otherwise("different_series_unresolved").alias("status"),
    )


def published_totals(rows: DataFrame, municipality: str, years: Sequence[int]) -> DataFrame:
    """One row per year from the long published file; every sex once, total = sum of sexes, no requested year absent."""
    number = F.replace(F.col("Total"), F.lit("."), F.lit("")).try_cast("bigint")
    year = F.col("Periodo").try_cast("int")
    kept = rows.filter((F.col("Municipios") == municipality) & year.isin(*years))

    def of(label: str) -> Column:
        return F.sum(F.when(F.col("Sexo") == label, number))

    out = kept.groupBy(year.alias("year")).agg(
        of("Total").alias("total"), of("Hombres").alias("male"), of("Mujeres").alias("female"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct("Sexo").alias("_d"),
    )
    whole = (F.col("_n") == 3) & (F.col("_d") == 3) & (F.col("total") == F.col("male") + F.col("female"))
    out = guard(out, {"published dimensions": F.coalesce(~whole, F.lit(True))}).drop("_n", "_d")
    return covers(out, rows.sparkSession.createDataFrame([(y,) for y in years], "year int"), ["year"])


def sections(raw: DataFrame, published: DataFrame) -> DataFrame:
    """Section counts side by side: ``(section_id, raw, published, difference, side)``."""
    joined = raw.select("section_id", F.col("population").alias("raw")).join(
        published.select("section_id", F.col("population").alias("published")), "section_id", "full")
    side = F.when(F.col("published").isNull(), "raw_only").when(F.col("raw").isNull(), "published_only").otherwise("both")
    return joined.select(
        "section_id", "raw", "published",
        (F.coalesce("raw", F.lit(0)) - F.coalesce("published", F.lit(0))).alias("difference"), side.alias("side"),
    )


def section_summary(compared: DataFrame) -> DataFrame:
    """Counts by side, matching sections and the accounting identity of the city difference."""
    zero = F.lit(0)
    out = compared.agg(
        F.count_if((F.col("side") != "raw_only") & (F.col("difference") == 0)).alias("matching"),
        F.count_if((F.col("side") != "raw_only") & (F.col("difference") != 0)).alias("differing"),
        F.count_if(F.col("side") == "raw_only").alias("raw_only"),
        F.count_if(F.col("side") == "published_only").alias("published_only"),
        F.sum("difference").alias("difference"), F.sum(F.coalesce("raw", zero)).alias("raw_total"),
        F.sum(F.coalesce("published", zero)).alias("published_total"),
    )
    return out.withColumn("accounted", F.col("difference") == F.col("raw_total") - F.col("published_total"))


def reconcile(composition: DataFrame, published: DataFrame, areas: DataFrame) -> DataFrame:
    """Published controls against the composition; a NULL age or nationality covers all of them.

    The composition is cut to the controlled (area, year) pairs first, and each control then meets
    only its own area and year. An unknown area fails the job.
    """
    known = areas.select("area_id", F.lit(True).alias("_k"))
    controls = published.join(known, "area_id", "left")
    controls = guard(controls, {"unknown published control": F.col("_k").isNull()}).drop("_k")
    stock = composition.select("area_id", "year", F.col("age").alias("_age"), F.col("nationality").alias("_nat"), F.col("population").alias("_p"))
    fits = (F.col("age").isNull() | (F.col("age") == F.col("_age"))) & (
        F.col("nationality").isNull() | (F.col("nationality") == F.col("_nat")))
    keys = ["area_id", "year", "age", "nationality", "population", "tolerance"]
    met = controls.join(stock, ["area_id", "year"], "left").groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(fits, F.col("_p"))), F.lit(0.0)).alias("calculated"))
    gap = F.col("calculated") - F.col("population")
    return met.withColumn("difference", gap).withColumn("passed", F.abs(gap) <= F.coalesce("tolerance", F.lit(0)))


def known_cells(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Known sums and blank counts per (keys, age, sex, nationality) of single ages below 100."""
    age = F.when(F.col("cod_edad_int") != OPEN_LABEL, F.col("cod_edad_int").try_cast("int"))
    long = unpivot(wide.withColumn("age", age).filter("age < 100"), [*keys, "age"])
    return long.groupBy(*keys, "age", "sex", "nationality").agg(
        F.coalesce(F.sum("population"), F.lit(0)).alias("known"), F.count_if(F.col("population").isNull()).alias("blank"))


def match(known: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell by cell: known count, control, difference; a one-sided key is a mismatch."""
    joined = known.select(*keys, "known").join(controls.select(*keys, F.col("population").alias("control")), list(keys), "full")
    gap = F.coalesce("known", F.lit(0)) - F.coalesce("control", F.lit(0))
    return joined.withColumns({
        "difference": gap, "matched": F.coalesce(F.col("known") == F.col("control"), F.lit(False)),
    })


def match_summary(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("matched")).alias("mismatches"),
        F.every("matched").alias("matched"),
    )


def verified(matched: DataFrame) -> DataFrame:
    """All cells equal, or the job fails; returns the number of verified cells."""
    return guard(matched, {"control mismatch": ~F.col("matched")}).agg(F.count(F.lit(1)).alias("verified_cells"))


def city_report(wide: DataFrame, controls: DataFrame) -> DataFrame:
    """One row: rows, stock, unusable ages, blanks, and whether all controls match."""
    known = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS), F.lit(0).cast("bigint"))
    blank = sum((F.col(c).isNull().cast("int") for c in COUNT_COLUMNS), F.lit(0))
    age = F.when(F.col("cod_edad_int") == OPEN_LABEL, 100).otherwise(F.col("cod_edad_int").try_cast("int"))
    usable = F.coalesce(age.between(0, 130), F.lit(False))
    base = wide.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(known).alias("known_total"),
        F.sum(F.when(usable, known).otherwise(0)).alias("modelled_stock"),
        F.sum(F.when(~usable, known).otherwise(0)).alias("invalid_age_population"), F.sum(blank).alias("raw_blank_cells"),
    )
    met = match(known_cells(wide), controls, ["age", "sex", "nationality"])
    bad = met.agg(F.count_if(~F.col("matched")).alias("n")).scalar()
    out = base.withColumn("control_differences", bad).withColumn("controls_matched", F.col("control_differences") == 0)
    return out.withColumn("inferred_blank_cells", F.when(F.col("controls_matched"), F.col("raw_blank_cells")).otherwise(0))


def barrio_stock(wide: DataFrame) -> DataFrame:
    """Known population per (district, barrio)."""
    known = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS), F.lit(0).cast("bigint"))
    return wide.groupBy(F.col("cod_distrito").alias("district"), F.col("cod_dist_barrio").alias("barrio")).agg(F.sum(known).alias("population"))


def fill_zero(audit: DataFrame, policy_id: str, low: int = 0, high: int = 89) -> DataFrame:
    """Unknown cells of eligible cohorts become 0 under a policy; the original status is kept."""
    blank = (F.col("population_status") == "unknown_blank") & (F.col("cohort_status") == "eligible")
    rows = guard(audit, {"inferred cell scope": blank & (F.coalesce(~F.col("age").between(low, high), F.lit(True)) | F.col("population").isNotNull())})
    return rows.withColumns({
        "raw_population_status": F.col("population_status"),
        "count_policy_id": F.when(blank, policy_id),
        "population": F.when(blank, F.lit(0)).otherwise(F.col("population")),
        "population_status": F.when(blank, "inferred_zero_monthly_control").otherwise(F.col("population_status")),
    })


def fill_summary(filled: DataFrame) -> DataFrame:
    """Raw blanks, inferred zeros and the blanks that stay unknown."""
    raw, now = F.col("raw_population_status") == "unknown_blank", F.col("population_status") == "unknown_blank"
    return filled.agg(
        F.count_if(raw).alias("raw_blanks"), F.count_if(raw & ~now).alias("inferred_zero_cells"), F.count_if(now).alias("out_of_scope_blanks"),
        F.sum("population").alias("population"),
    )


def checked_fill(audit: DataFrame, policy_id: str, expected: int, **scope: int) -> DataFrame:
    """:func:`fill_zero`, refused when the inferred count differs from the verified raw blanks."""
    filled = fill_zero(audit, policy_id, **scope)
    found = filled.agg(F.count("count_policy_id").alias("n")).head().n
    if found != expected:
        raise ContractError(f"inferred cell count {found} differs from the {expected} verified blanks")
    return filled


def rows_equal(left: DataFrame, right: DataFrame, row_number: str = "row_number") -> DataFrame:
    """Positions where two exports of one table differ, or where one has no row."""
    columns = [c for c in left.columns if c != row_number]
    a = left.select(row_number, F.struct(*columns).alias("_l"))
    b = right.select(row_number, F.struct(*columns).alias("_r"))
    joined = a.join(b, row_number, "full")
    kind = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_l") != F.col("_r"), "different")
    # A struct comparison is NULL-safe only through <=>.
    kind = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_r")), "different").otherwise(kind)
    return joined.select(row_number, kind.alias("kind")).filter("kind is not null")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) on one side only, regardless of position."""
    a = left.exceptAll(right).withColumn("side", F.lit("left_only"))
    return a.unionByName(right.select(*left.columns).exceptAll(left).withColumn("side", F.lit("right_only")))


def missing_totals(published: DataFrame, geographies: DataFrame, years: Sequence[int]) -> DataFrame:
    """Aggregate areas and years without an all-ages, all-nationalities control."""
    wanted = geographies.filter(F.col("level").isin("barrio", "district", "city")).select(
        "area_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    have = published.filter("age is null and nationality is null").select("area_id", "year")
    return wanted.join(have, ["area_id", "year"], "left_anti")


def missing_snapshots(profiles: DataFrame, sources: DataFrame, first: int, last: int) -> DataFrame:
    """``(reference_date, problem)``: 1 January dates without a profile, profiles without a pinned source."""
    dates = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.make_date(y, F.lit(1), F.lit(1)))
    wanted = profiles.sparkSession.range(1).select(F.explode(dates).alias("reference_date"))
    absent = wanted.join(profiles.select("reference_date"), "reference_date", "left_anti")
    unbound = profiles.select("reference_date", "sha256").join(sources, ["reference_date", "sha256"], "left_anti")
    return absent.withColumn("problem", F.lit("no_profile")).unionByName(
        unbound.select("reference_date").withColumn("problem", F.lit("not_pinned")))


def column_match(profiles: DataFrame, bank: DataFrame) -> DataFrame:
    """The four column sums of each snapshot against an independent response of the same year."""
    ids = ["year"]
    ours = profiles.unpivot(ids, list(COUNT_COLUMNS), "count_column", "known")
    theirs = bank.unpivot(ids, list(COUNT_COLUMNS), "count_column", "population")
    return match(ours, theirs, ["year", "count_column"])


def with_fallback(matched_facts: DataFrame, flags: DataFrame, control_ages: DataFrame, control_totals: DataFrame, open_age: int = 100) -> DataFrame:
    """Annual city cells: the file where its controls match, else explicit control counts.

    The open age of a control year is its total minus the single ages; below zero fails the job.
    All inputs carry (year, sex, nationality); ``flags`` is (year, matched).
    """
    good = flags.filter("matched").select("year")
    bad = flags.filter("not matched").select("year")
    ages = control_ages.join(bad, "year", "left_semi").select("year", "age", "sex", "nationality", "population")
    sums = ages.groupBy("year", "sex", "nationality").agg(F.sum("population").alias("_s"))
    rest = control_totals.join(sums, ["year", "sex", "nationality"]).withColumn("population", F.col("population") - F.col("_s"))
    rest = guard(rest, {"negative open-age remainder": F.col("population") < 0}).select(
        "year", F.lit(open_age).alias("age"), "sex", "nationality", "population")
    kept = matched_facts.join(good, "year", "left_semi").select("year", "age", "sex", "nationality", "population")
    return kept.withColumn("source", F.lit("file")).unionByName(ages.unionByName(rest).withColumn("source", F.lit("controls")))
