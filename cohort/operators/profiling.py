"""Profiles of raw snapshots: one pass of counts, histograms, duplicates and discontinuities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.functions.expressions import divide
from cohort.operators.normalise import COUNT_COLUMNS, OPEN_LABEL
from cohort.params import DISTRICTS


def _coded(wide: DataFrame) -> DataFrame:
    """Usable section or NULL, numeric age, and flags, beside the raw columns."""
    district, barrio = F.col("cod_distrito").try_cast("int"), F.col("cod_dist_barrio").try_cast("int")
    section = F.col("cod_dist_seccion").try_cast("int")
    good = district.between(1, DISTRICTS) & (F.floor(section / 1000) == district) & barrio.isNotNull()
    age = F.col("cod_edad_int").try_cast("int")
    out = wide.withColumns({
        "_section": F.when(good, section), "_barrio": F.when(good, barrio), "_district": F.when(good, district), "_age": age,
        "_open": F.coalesce(F.col("cod_edad_int") == OPEN_LABEL, F.lit(False)),
    })
    special = (F.col("_barrio") == 0) | (F.col("_section") % 1000).isin(0, 888, 999)
    return out.withColumn("_special", F.coalesce(special, F.lit(False)))


def _number(column: str) -> Column:
    value = F.col(column).try_cast("bigint")
    return F.when(value >= 0, value)


def snapshot(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per snapshot of counters; ``by`` profiles many snapshots in one job.

    Distinct counts and duplicates come from one pre-aggregation on the duplicate key (section or
    district and barrio, plus age), so nothing is collected per snapshot.
    """
    c = _coded(wide)
    blank = {n: F.col(n).isNull() | (F.trim(F.col(n).cast("string")) == "") for n in COUNT_COLUMNS}
    known = sum((F.coalesce(_number(n), F.lit(0)) for n in COUNT_COLUMNS), F.lit(0).cast("bigint"))
    invalid = sum(((~blank[n]) & _number(n).isNull()).cast("int") for n in COUNT_COLUMNS)
    c = c.withColumns({"_known": known, "_invalid": F.coalesce(invalid, F.lit(0))})
    bad_age = F.coalesce(~F.col("_age").between(0, 130), ~F.col("_open"))
    sums = {
        "rows": F.count(F.lit(1)),
        "invalid_ages": F.count_if(bad_age),
        "invalid_counts": F.sum("_invalid"),
        "invalid_geography_rows": F.count_if(F.col("_section").isNull()),
        "invalid_geography_known_population": F.sum(F.when(F.col("_section").isNull(), F.col("_known")).otherwise(0)),
        "special_geography_rows": F.count_if("_special"),
        "special_geography_known_population": F.sum(F.when(F.col("_special"), F.col("_known")).otherwise(0)),
        "open_age_rows": F.count_if("_open"),
        "known_population_sum": F.sum("_known"),
        **{f"blank_{n}": F.count_if(b) for n, b in blank.items()},
        **{f"known_{n}": F.sum(F.coalesce(_number(n), F.lit(0))) for n in COUNT_COLUMNS},
    }
    place = F.when(F.col("_section").isNotNull(), F.struct(F.col("_section").cast("string").alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(F.concat(F.lit("d"), F.coalesce(F.col("cod_distrito").cast("string"), F.lit(""))).alias("a"),
                 F.coalesce(F.col("cod_dist_barrio").cast("string"), F.lit("")).alias("b")))
    label = F.coalesce(F.col("_age").cast("string"), F.col("cod_edad_int"), F.lit(""))
    per_key = c.groupBy(*by, place.alias("_place"), label.alias("_label"), "_district", "_section", "_barrio").agg(
        *[v.alias(k) for k, v in sums.items()]
    )
    # Barrio is not part of the duplicate key while the section is known.
    per_dup = per_key.groupBy(*by, "_place", "_label", "_district", "_section").agg(
        *[F.sum(k).alias(k) for k in sums], F.collect_set("_barrio").alias("_barrios")
    )
    per_place = per_dup.groupBy(*by, "_place", "_district", "_section").agg(
        *[F.sum(k).alias(k) for k in sums],
        F.array_distinct(F.flatten(F.collect_set("_barrios"))).alias("_barrios"),
        F.sum(F.col("rows") - 1).alias("duplicate_section_age_rows"),
    )
    done = per_place.groupBy(*by).agg(
        *[F.sum(k).alias(k) for k in sums],
        F.sum("duplicate_section_age_rows").alias("duplicate_section_age_rows"),
        F.count_if(F.col("_section").isNotNull()).alias("sections"),
        F.count_distinct("_district").alias("districts"),
        F.count_if(F.size("_barrios") > 1).alias("sections_with_multiple_barrios"),
    )
    issues = (
        F.col("open_age_rows") + F.col("special_geography_rows") + F.col("invalid_ages") + F.col("invalid_counts")
        + F.col("invalid_geography_rows") + F.col("duplicate_section_age_rows") + F.col("sections_with_multiple_barrios")
        + sum((F.col(f"blank_{n}") for n in COUNT_COLUMNS), F.lit(0))
    )
    return done.withColumn("status", F.when(issues > 0, "requires_review").otherwise("profiled"))


def age_histogram(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per age label."""
    return wide.groupBy(*by, F.col("cod_edad_int").alias("age_label")).agg(F.count(F.lit(1)).alias("rows"))


def section_population(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Known population per usable section."""
    known = sum((F.coalesce(_number(n), F.lit(0)) for n in COUNT_COLUMNS), F.lit(0).cast("bigint"))
    return _coded(wide).filter("_section is not null").groupBy(*by, F.col("_section").alias("section")).agg(F.sum(known).alias("population"))


def facts(long: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Profile of strict facts: rows, age range, sections, total."""
    out = long.agg(
        F.count(F.lit(1)).alias("fact_count"), F.min("age").alias("minimum_age"), F.max("age").alias("maximum_age"),
        F.count_distinct("age").alias("ages"), F.count_distinct("geography_id").alias("section_count"),
        F.sum("population").alias("total"),
    )
    if excluded is None:
        return out
    return out.withColumn("excluded_rows", excluded.agg(F.count(F.lit(1)).alias("n")).scalar())


def discontinuities(profiles: DataFrame, threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Change between consecutive snapshots, flagged when large or unknown.

    ``profiles`` has one row per snapshot (reference_date, total, section_count and optionally
    header_text), a handful per source.
    """
    w = Window.partitionBy(*by).orderBy("reference_date")
    change = divide(F.col("total"), F.lag("total").over(w)) - 1
    header = ~F.col("header_text").eqNullSafe(F.lag("header_text").over(w)) if "header_text" in profiles.columns else F.lit(False)
    out = profiles.select(
        *by, F.lag("reference_date").over(w).alias("from_date"), F.col("reference_date").alias("to_date"),
        change.alias("relative_change"), header.alias("schema_changed"),
        (F.coalesce("section_count", F.lit(0)) - F.coalesce(F.lag("section_count").over(w), F.lit(0))).alias("section_count_change"),
    )
    flagged = F.coalesce(F.abs("relative_change") > threshold, F.lit(True))
    return out.filter("from_date is not null").withColumn("flagged", flagged)
