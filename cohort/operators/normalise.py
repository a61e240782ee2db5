"""Raw wide counts to long facts, in a strict and an audit mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import guard, guard_groups, must_fail
from cohort.functions.expressions import age_fields, canonical_barrio, canonical_section, is_digits, section_id
from cohort.operators.mortality import capped_age
from cohort.params import DISTRICTS, SECTION_PREFIX, Params

# The count columns of the raw file and the labels of excluded rows.
COUNT_COLUMNS = {
    "espanoleshombres": ("male", "ESP"),
    "espanolesmujeres": ("female", "ESP"),
    "extranjeroshombres": ("male", "EXT"),
    "extranjerosmujeres": ("female", "EXT"),
}
OPEN_LABEL = "100 o +"
EXCLUDED_LABELS = ("", "TOTAL", "Total", "DESCONOCIDA", "Unknown", "100+")
KEYS = ("cod_distrito", "cod_dist_barrio", "cod_dist_seccion", "cod_edad_int")
DATE_COLUMNS = ("fx_datos_ini", "fx_datos_fin")


def unpivot(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per wide row and count column: ``sex, nationality, population``; blanks stay NULL."""
    cells = F.array(*[
        F.struct(F.lit(sex).alias("sex"), F.lit(nat).alias("nationality"), F.col(c).alias("population"), F.lit(c).alias("count_column"))
        for c, (sex, nat) in COUNT_COLUMNS.items()
    ])
    return wide.select(*keep, F.inline(cells))


def counts(wide: DataFrame) -> DataFrame:
    """Text counts to BIGINT: a blank is NULL, anything but digits fails the job."""
    for c in COUNT_COLUMNS:
        text = F.trim(F.col(c).cast("string"))
        blank = text.isNull() | (text == "")
        number = F.when(is_digits(text), text.try_cast("bigint"))
        wide = wide.withColumn(c, F.when(~blank, F.coalesce(number, must_fail("invalid population count"))))
    return wide


def split_excluded(wide: DataFrame, open_label: str = OPEN_LABEL) -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)``: totals and unknown ages leave with a reason; a strange label fails."""
    label = F.trim("cod_edad_int")
    usable = F.coalesce(is_digits(label) | (label == open_label), F.lit(False))
    known = F.coalesce(label.isin(*EXCLUDED_LABELS), F.lit(True))
    rows = guard(wide, {"unrecognised age label": ~usable & ~known})
    reason = F.when(label.endswith("+"), "terminal_open").otherwise("total_or_unknown")
    return rows.filter(usable), rows.filter(~usable).withColumn("reason", reason)


def strict_rules() -> dict[str, Column]:
    missing = F.col("espanoleshombres").isNull()
    for c in list(COUNT_COLUMNS)[1:]:
        missing = missing | F.col(c).isNull()
    return {
        "section and district codes": F.col("geography_id").isNull(),
        "barrio and district codes": F.col("barrio_code").isNull(),
        "age": F.coalesce(~F.col("age").between(0, 130), F.lit(True)),
        "blank or suppressed count": missing,
    }


def coded(wide: DataFrame, prefix: str = SECTION_PREFIX, barrio_width: int = 4, open_age: int = 100) -> DataFrame:
    """Strict codes and ages beside the raw columns; bad codes are NULL."""
    label = F.trim("cod_edad_int")
    return wide.withColumns({
        "geography_id": canonical_section(F.col("cod_distrito"), F.col("cod_dist_seccion"), prefix),
        "district_code": F.lpad(F.trim(F.col("cod_distrito").cast("string")), 2, "0"),
        "barrio_code": canonical_barrio(F.col("cod_distrito"), F.col("cod_dist_barrio"), barrio_width),
        "age": F.when(label == OPEN_LABEL, open_age).otherwise(label.try_cast("int")),
        "age_kind": F.when(label == OPEN_LABEL, "open").otherwise("exact"),
    })


def to_long(wide: DataFrame, *, prefix: str = SECTION_PREFIX, barrio_width: int = 4, total_column: str | None = None) -> DataFrame:
    """Strict mode: four facts per row; blanks, bad codes and wrong row totals fail the job.

    A repeated source cell, or a section under two parents, fails it too. All rules are judged in the one scan that makes
    the facts, so what is checked is what is used.
    """
    kept, _ = split_excluded(counts(wide))
    rows = guard(coded(kept, prefix, barrio_width), strict_rules())
    if total_column:
        whole = sum((F.col(c) for c in COUNT_COLUMNS), F.lit(0))
        rows = guard(rows, {"row total": F.coalesce(F.col(total_column).cast("bigint") != whole, F.lit(True))})
    section, *others = sorted(KEYS, key=lambda c: c != "cod_dist_seccion")
    rows = guard_groups(rows, [section], single={"sections under several parents": F.col("cod_dist_barrio")}, keys=others)
    long = unpivot(rows, ["geography_id", "district_code", "barrio_code", "age", "age_kind"])
    return long.drop("count_column").withColumn("section_code", F.substring("geography_id", -3, 3))


def to_audit(
    wide: DataFrame, params: Params, reference_date: str, geometry_ids: DataFrame | None = None,
    *, source_id: str = "", schema_version: str = "1",
) -> DataFrame:
    """Audit mode: blanks stay unknown, missing sections stay visible, ages carry a cohort status."""
    section = F.col("cod_dist_seccion").cast("int")
    district, barrio = F.col("cod_distrito").cast("int"), F.col("cod_dist_barrio").cast("int")
    bad = F.coalesce(~district.between(1, DISTRICTS), F.lit(True)) | (section.isNotNull() & (F.floor(section / 1000) != district))
    rows = guard(counts(wide), {"district and section codes": bad})
    year = int(reference_date[:4])
    rows = rows.withColumns({
        "source_geography_id": F.coalesce(section_id(section, params.prefix), F.lit("")),
        "geography_status": F.when(section.isNull(), "missing_section").otherwise("coded"),
        "district_code": F.lpad(district.cast("string"), 2, "0"),
        "barrio_code": F.lpad(barrio.cast("string"), 4, "0"),
        "age_label": F.col("cod_edad_int"),
        "_age": age_fields(F.col("cod_edad_int"), F.lit(year), params),
    })
    keep = ["source_geography_id", "geography_status", "district_code", "barrio_code", "age_label", "_age"]
    long = unpivot(rows, keep).withColumns({
        "population_status": F.when(F.col("population").isNull(), "unknown_blank").otherwise("observed"),
        "reference_date": F.lit(reference_date).cast("date"),
        "source_file_id": F.lit(source_id),
        "schema_version": F.lit(schema_version),
    })
    if geometry_ids is None:
        long = long.withColumn("has_geometry", F.lit(None).cast("int"))
    else:
        known = geometry_ids.select(F.col("id").alias("source_geography_id"), F.lit(1).alias("_g")).distinct()
        long = long.join(known, "source_geography_id", "left").withColumn("has_geometry", F.coalesce("_g", F.lit(0)))
    return long.select(
        "reference_date", "source_geography_id", "geography_status", "district_code", "barrio_code",
        "_age.age", "age_label", "_age.age_kind", "sex", "nationality", "population", "population_status",
        "_age.cohort_status", "has_geometry", "source_file_id", "schema_version",
    )


def parents_per_section(wide: DataFrame) -> DataFrame:
    """Sections declared under more than one barrio: ``(section, barrios)``."""
    pairs = wide.filter("cod_dist_seccion is not null").groupBy(
        F.col("cod_dist_seccion").alias("section"), F.col("cod_dist_barrio").alias("barrio")
    ).count()
    grouped = pairs.groupBy("section").agg(F.array_sort(F.collect_list("barrio")).alias("barrios"))
    return grouped.filter(F.size("barrios") > 1)


def grain_duplicates(wide: DataFrame) -> DataFrame:
    """Full-grain keys that occur more than once."""
    return wide.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def date_mismatches(wide: DataFrame, reference_date: str, columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Per embedded date column: rows whose date, dashes ignored, is not the reference date."""
    want = reference_date.replace("-", "")
    present = [c for c in columns if c in wide.columns]
    bad = [F.count_if(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("-"), F.lit("")) != want, F.lit(True))).alias(c) for c in present]
    return wide.agg(*bad).unpivot([], present, "column", "mismatches")


def city_stock(wide: DataFrame, top: int = 100) -> DataFrame:
    """City cells by terminal-grouped age, and the count whose age is unusable (NULL age)."""
    label = F.col("cod_edad_int")
    age = F.when(label == OPEN_LABEL, F.lit(top)).otherwise(label.try_cast("int"))
    long = unpivot(wide.withColumn("age", capped_age(age, top)), ["age"])
    return long.groupBy("age", "sex", "nationality").agg(F.coalesce(F.sum("population"), F.lit(0)).alias("population"))


def conservation(wide: DataFrame, long: DataFrame) -> DataFrame:
    """Known sum and blank count of both shapes; equal when nothing was lost."""
    known = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS), F.lit(0))
    blank = sum((F.col(c).isNull().cast("int") for c in COUNT_COLUMNS), F.lit(0))
    a = wide.agg(F.struct(F.sum(known).alias("known"), F.sum(blank).alias("blank")).alias("s"))
    b = long.agg(F.sum("population").alias("long_known"), F.count_if(F.col("population").isNull()).alias("long_blank"))
    return b.withColumn("_w", a.scalar()).select(
        F.col("_w.known").alias("wide_known"), "long_known", F.col("_w.blank").alias("wide_blank"), "long_blank",
        ((F.col("_w.known") == F.col("long_known")) & (F.col("_w.blank") == F.col("long_blank"))).alias("conserved"),
    )
