"""Tabular inputs: every column is read as text, checked against its contract, then cast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.contracts import ContractError, covers, guard, must_fail, require_columns, unique
from cohort.functions.expressions import is_digits
from cohort.operators.normalise import COUNT_COLUMNS
from cohort.params import LEVELS, MAX_AGE, NATIONALITIES, SEXES, STATUSES

# Count fields of a control-bank record, by raw count column.
BANK_FIELDS = {
    "espanoleshombres": "NHombresNac",
    "espanolesmujeres": "NMujeresNac",
    "extranjeroshombres": "NHombresExt",
    "extranjerosmujeres": "NMujeresExt",
}


def read_text_table(
    spark: SparkSession, path: str, required: Sequence[str] = (), *, sep: str = ",", encoding: str = "UTF-8"
) -> DataFrame:
    """A delimited file as strings; a byte-order mark is dropped and a missing column refused."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, mode="FAILFAST")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return require_columns(df, required)


def read_wide(
    spark: SparkSession, path: str, *, sep: str = ";", encoding: str = "UTF-8", header: Mapping[str, str] | None = None
) -> DataFrame:
    """A raw wide file: trimmed lower-case headers, trimmed values, blanks as NULL.

    ``header`` is the reviewed alias contract (raw name → canonical name); unknown or missing
    names are refused.
    """
    df = read_text_table(spark, path, sep=sep, encoding=encoding)
    if header is not None:
        unknown, missing = set(df.columns) - set(header), set(header) - set(df.columns)
        if unknown or missing:
            raise ContractError(f"unreviewed header: unknown={sorted(unknown)}, missing={sorted(missing)}")
        df = df.toDF(*[header[c] for c in df.columns])
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns])


def population_rules() -> dict[str, Column]:
    count = F.col("population").try_cast("bigint")
    return {
        "age": F.coalesce(~F.col("age").try_cast("int").between(0, MAX_AGE), F.lit(True)),
        "sex": F.coalesce(~F.col("sex").isin(*SEXES), F.lit(True)),
        "nationality": F.coalesce(~F.col("nationality").isin(*NATIONALITIES), F.lit(True)),
        "population": F.coalesce(count < 0, F.lit(True)),
    }


def parse_population(text: DataFrame) -> DataFrame:
    rules = population_rules()
    if "age_kind" in text.columns:
        rules["open age below 100"] = (F.col("age_kind") == "open") & (F.col("age").try_cast("int") < 100)
    return guard(text, rules).select(
        "geography_id", F.col("age").cast("int").alias("age"), "sex", "nationality", F.col("population").cast("bigint").alias("population"))


def mortality_rules() -> dict[str, Column]:
    qx = F.col("qx").try_cast("double")
    return {
        "year": F.col("year").try_cast("int").isNull(),
        "age": F.coalesce(~F.col("age").try_cast("int").between(0, MAX_AGE), F.lit(True)),
        "sex": F.coalesce(~F.col("sex").isin(*SEXES), F.lit(True)),
        "qx": F.coalesce(~qx.between(0, 1), F.lit(True)),
    }


def parse_mortality(text: DataFrame) -> DataFrame:
    return guard(text, mortality_rules()).select(
        F.col("year").cast("int").alias("year"), F.col("age").cast("int").alias("age"), "sex", F.col("qx").cast("double").alias("qx"))


def hazard_rules() -> dict[str, Column]:
    rules = mortality_rules()
    del rules["qx"]
    return {**rules, "hazard": F.coalesce(~F.col("hazard").try_cast("double").between(0, 1), F.lit(True))}


def fertility_rules() -> dict[str, Column]:
    return {
        "year": F.col("year").try_cast("int").isNull(),
        "age": F.coalesce(~F.col("age").try_cast("int").between(0, MAX_AGE), F.lit(True)),
        "asfr_per_1000": F.coalesce(~F.col("asfr_per_1000").try_cast("double").between(0, 1000), F.lit(True)),
    }


def read_hazards(spark: SparkSession, path: str) -> DataFrame:
    text = guard(read_text_table(spark, path, ("year", "age", "sex", "hazard")), hazard_rules())
    typed = text.select(F.col("year").cast("int").alias("year"), F.col("age").cast("int").alias("age"), "sex", F.col("hazard").cast("double").alias("hazard"))
    return unique(typed, ["year", "age", "sex"])


def read_fertility(spark: SparkSession, path: str) -> DataFrame:
    text = guard(read_text_table(spark, path, ("year", "age", "asfr_per_1000")), fertility_rules())
    typed = text.select(F.col("year").cast("int").alias("year"), F.col("age").cast("int").alias("age"), F.col("asfr_per_1000").cast("double").alias("asfr_per_1000"))
    return unique(typed, ["year", "age"])


def geography_rules() -> dict[str, Column]:
    return {
        "area_id": F.coalesce(F.trim("area_id") == "", F.lit(True)),
        "level": F.coalesce(~F.col("level").isin(*LEVELS), F.lit(True)),
        "boundary_status": F.coalesce(~F.col("boundary_status").isin(*STATUSES), F.lit(True)),
    }


def parse_geographies(text: DataFrame) -> DataFrame:
    method = F.col("boundary_method") if "boundary_method" in text.columns else F.lit(None).cast("string")
    return guard(text, geography_rules()).select(
        "area_id", "name", "level", F.nullif(F.trim("parent_id"), F.lit("")).alias("parent_id"), "boundary_status", method.alias("boundary_method"))


def geography_problems(text: DataFrame) -> DataFrame:
    """``(problem, areas)``: rule violations, repeated ids and unknown parents."""
    from cohort.contracts import violations

    rows = violations(text, geography_rules()).select(F.col("rule").alias("problem"), F.col("violations").alias("areas"))
    repeated = text.groupBy("area_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("areas"))
    known = text.select(F.col("area_id").alias("parent_id")).distinct()
    lost = text.filter("parent_id <> ''").join(known, "parent_id", "left_anti").agg(F.count(F.lit(1)).alias("areas"))
    return rows.unionByName(repeated.withColumn("problem", F.lit("repeated id"))).unionByName(lost.withColumn("problem", F.lit("unknown parent")))


def read_population(spark: SparkSession, path: str) -> DataFrame:
    text = read_text_table(spark, path, ("geography_id", "age", "sex", "nationality", "population"))
    return unique(parse_population(text), ["geography_id", "age", "sex", "nationality"])


def read_mortality(spark: SparkSession, path: str) -> DataFrame:
    return unique(parse_mortality(read_text_table(spark, path, ("year", "age", "sex", "qx"))), ["year", "age", "sex"])


def read_geographies(spark: SparkSession, path: str) -> DataFrame:
    from cohort.operators.hierarchy import unreachable

    text = read_text_table(spark, path, ("area_id", "name", "level", "parent_id", "boundary_status"))
    tree = unique(parse_geographies(text), ["area_id"])
    lost = unreachable(tree).take(3)
    if lost:
        raise ContractError(f"hierarchy: {[tuple(r) for r in lost]}")
    return tree


def series_observations(
    series: DataFrame, dimensions: Mapping[str, str], age_variable: str, sex_variable: str,
    age_codes: DataFrame, sex_codes: DataFrame, start_year: int, end_year: int,
) -> DataFrame:
    """``(year, age, sex, value)`` of the series whose metadata match every wanted code.

    ``series`` has ``MetaData`` (array of struct Variable.Codigo, Codigo) and ``Data`` (array of
    struct Anyo, Valor). Code tables are (code, age) and (code, sex), the size of a code list.
    An unmapped age or sex, or a null value, fails the job, and so does a selection that matches no series.
    """
    codes = F.map_from_entries(F.transform("MetaData", lambda m: F.struct(m["Variable"]["Codigo"], m["Codigo"])))
    s = series.withColumn("_m", codes)
    for variable, code in dimensions.items():
        s = s.filter(F.col("_m")[variable] == code)
    if s.isEmpty():
        raise ContractError(f"no series matches {dict(dimensions)}")
    s = s.select(F.col("_m")[age_variable].alias("_a"), F.col("_m")[sex_variable].alias("_s"), F.inline("Data"))
    s = s.join(age_codes.select(F.col("code").alias("_a"), "age"), "_a", "left").join(
        sex_codes.select(F.col("code").alias("_s"), "sex"), "_s", "left")
    s = guard(s, {
        "unmapped age or sex code": F.col("age").isNull() | F.col("sex").isNull(),
        "missing observation": F.col("Valor").isNull(),
    })
    year = F.col("Anyo").cast("int")
    return s.filter((year >= start_year) & (year < end_year)).select(year.alias("year"), "age", "sex", F.col("Valor").cast("double").alias("value"))


BANK_SCHEMA = (
    "status string, errorTitulo string, mapaEpigrafesFiltros map<string,string>, "
    "listaConsulta array<struct<distrito:struct<VCodigo:string>,VEdad:string,"
    "NHombresNac:bigint,NMujeresNac:bigint,NHombresExt:bigint,NMujeresExt:bigint>>"
)


def read_bank(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Control-bank responses (plain or gzip JSON)."""
    return spark.read.schema(BANK_SCHEMA).option("multiLine", True).option("encoding", encoding).json(path)


def bank_controls(responses: DataFrame, filters: Mapping[str, str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``(district, age, sex, nationality, population)``; failed or out-of-scope responses fail the job.

    A repeated cell raises, as do records other than those of ``keys`` (district, age) where they are given.
    """
    bad = (F.col("status") != "success") | (F.coalesce("errorTitulo", F.lit("")) != "")
    rules = {"failed response": F.coalesce(bad, F.lit(True))}
    for name, value in (filters or {}).items():
        rules[f"response scope {name.strip(': ')}"] = F.coalesce(F.col("mapaEpigrafesFiltros")[name] != value, F.lit(True))
    rows = guard(responses, rules).select(F.explode("listaConsulta").alias("r"))
    cells = F.inline(F.array(*[
        F.struct(F.lit(sex).alias("sex"), F.lit(nat).alias("nationality"), F.col("r")[BANK_FIELDS[c]].alias("population"))
        for c, (sex, nat) in COUNT_COLUMNS.items()
    ]))
    long = rows.select(F.col("r.distrito.VCodigo").try_cast("int").alias("district"), F.col("r.VEdad").try_cast("int").alias("age"), cells)
    long = guard(long, {"control count": F.coalesce(F.col("population") < 0, F.lit(True))})
    unique(long, ["district", "age", "sex", "nationality"])
    return covers(long, keys, ["district", "age"]) if keys is not None else long


def sheet_rows(cells: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per sheet row from ``(sheet, row, col, value)``, columns renamed by letter."""
    wide = cells.groupBy("sheet", "row").pivot("col", sorted(columns)).agg(F.first("value"))
    return wide.select("sheet", "row", *[F.col(letter).alias(name) for letter, name in columns.items()])


# The columns of the section totals sheet.
SHEET_COLUMNS = {
    "A": "label", "B": "code", "C": "total", "D": "male", "E": "female", "G": "esp_total", "H": "esp_male", "I": "esp_female",
    "K": "ext_total", "L": "ext_male", "M": "ext_female", "O": "none_total", "P": "none_male", "Q": "none_female",
}
SHEET_COUNTS = tuple(v for k, v in SHEET_COLUMNS.items() if k not in "AB")


def _sheet_counts(rows: DataFrame) -> DataFrame:
    counted = rows.withColumns({c: F.col(c).try_cast("bigint") for c in SHEET_COUNTS})
    bad = F.lit(False)
    for total, male, female in (SHEET_COUNTS[i : i + 3] for i in range(0, 12, 3)):
        bad = bad | (F.col(total) != F.col(male) + F.col(female))
    split = F.col("total") != F.col("esp_total") + F.col("ext_total") + F.col("none_total")
    return guard(counted, {
        "blank sheet count": F.greatest(*[F.col(c).isNull().cast("int") for c in SHEET_COUNTS]) == 1,
        "sheet sex identity": F.coalesce(bad, F.lit(True)), "sheet nationality identity": F.coalesce(split, F.lit(True)),
    })


def sheet_city(cells: DataFrame, label: str) -> DataFrame:
    """The city row of each sheet with its counts; a sheet with no such row, or with several, fails the job."""
    rows = sheet_rows(cells, SHEET_COLUMNS).filter((F.col("label") == label) & is_digits(F.col("total")))
    kept = ["row", *SHEET_COUNTS]
    covers(rows, cells, ["sheet"])
    city = _sheet_counts(rows).groupBy("sheet").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in kept])
    return guard(city, {"several city rows": F.col("_n") != 1}).drop("_n")


def sheet_sections(cells: DataFrame, prefix: str) -> DataFrame:
    """Section rows (five-digit codes) with full ids; blank or inconsistent counts and repeated sections fail the job."""
    rows = sheet_rows(cells, SHEET_COLUMNS).filter(F.col("code").rlike("^[0-9]{5}$"))
    counted = _sheet_counts(rows).select("sheet", F.concat(F.lit(prefix), "code").alias("section_id"), *SHEET_COUNTS)
    return unique(counted, ["sheet", "section_id"])


def registry_rows(table: DataFrame, prefix: str) -> DataFrame:
    """Registry rows with full ids; sections outside 1–999 or bad parents fail the job.

    ``table`` is (row_number, district, barrio, section, created_raw, closed_raw, modified_raw, old_barrio).
    """
    from cohort.functions.expressions import canonical_parent

    d, s = F.col("district").try_cast("int"), F.col("section").try_cast("int")
    parent = canonical_parent(F.col("district"), F.col("barrio"))
    old = F.nullif(F.trim(F.col("old_barrio").cast("string")), F.lit(""))
    previous = F.when(old.isNotNull(), F.coalesce(canonical_parent(F.col("district"), old), must_fail("registry previous parent")))
    rows = guard(table, {"registry section": F.coalesce(~s.between(1, 999), F.lit(True)), "registry parent": parent.isNull()})
    return rows.select(
        "row_number", F.concat(F.lit(prefix), F.lpad(d.cast("string"), 2, "0"), F.lpad(s.cast("string"), 3, "0")).alias("section_id"),
        parent.alias("parent"), previous.alias("previous_parent"), "created_raw", "closed_raw", "modified_raw",
    )
