"""Registered queries on files: what a writer has written, read back through the reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohort.operators import mortality, normalise, profiling, qa
from cohort.operators.staging import shared_folder
from cohort.params import Params
from cohort.plans.core_queries import R, results
from cohort.plans.fixtures import Fixtures
from cohort.plans.registry import query, rounded
from cohort.sources import sinks, tables

P = Params()


def _folder(f: Fixtures) -> str:
    return f"{shared_folder(f.spark)}/trip-{uuid.uuid4().hex}"


@query("src1_population_file", "select geography_id, age, sex, nationality, population from fx_population_start")
def _(f):
    path = _folder(f)
    sinks.write_text_table(f.population_start.select("geography_id", "age", "sex", "nationality", "population"), path)
    return tables.read_population(f.spark, path)


@query("src5_wide_file", """
select cod_distrito::varchar as cod_distrito, cod_dist_seccion::varchar as cod_dist_seccion, nullif(trim(cod_edad_int), '') as cod_edad_int, espanoleshombres::varchar as espanoleshombres
from fx_wide""")
def _(f):
    path = _folder(f)
    spaced = f.wide.select(*[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("  ")).alias(c.upper()) for c in f.wide.columns])
    spaced.write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_wide(f.spark, path).select("cod_distrito", "cod_dist_seccion", "cod_edad_int", "espanoleshombres")


@query("src6_statistics_file", "select year, age, sex, round(micro / 1e9, 9) as qx from fx_micro where measure = 'Riesgo de muerte' and year between 2015 and 2024")
def _(f):
    path = _folder(f)
    f.stat_rows.write.csv(path, header=True, sep=";")
    rows = tables.read_text_table(f.spark, path, ("Sexo", "Edad", "Funciones", "Periodo", "Total"), sep=";")
    return rounded(mortality.national_extract(rows, 2015, 2025), 9)


@query("snk1_long_facts", """
select geography_id, sex, nationality, sum(population)::bigint as population, count(*) as rows, sum(population)::bigint as text_population from x_strict_long group by all""")
def _(f):
    folder, long = _folder(f), normalise.to_long(f.wide_strict, total_column="total")
    _, excluded = normalise.split_excluded(normalise.counts(f.wide_strict))
    sinks.write_long(long, excluded, profiling.facts(long, excluded), folder)
    keys = ["geography_id", "sex", "nationality"]
    facts = f.spark.read.parquet(f"{folder}/facts").groupBy(*keys).agg(F.sum("population").cast("bigint").alias("population"), F.count(F.lit(1)).alias("rows"))
    text = tables.read_text_table(f.spark, f"{folder}/facts_csv").groupBy(*keys).agg(F.sum(F.col("population").cast("bigint")).alias("text_population"))
    return facts.join(text, keys, "full").select(*keys, "population", "rows", "text_population")


@query("snk3_analytical_tables", f"select area_id, level, {R('baseline expected actual residual')} from x_index")
def _(f):
    folder = _folder(f)
    d, prof, index = results(f)
    written = sinks.write_bundle({"cohort_detail": d, "profile": prof, "area_index": index, "nothing": index.limit(0)}, folder)
    if written != ["cohort_detail", "profile", "area_index"]:
        raise ValueError(f"written: {written}")
    return rounded(f.spark.read.parquet(f"{folder}/area_index").select("area_id", "level", "baseline", "expected", "actual", "residual"))


@query("snk13_reports", """
select 'checks' as report, 3 * (select count(*) from fx_geographies) + (select count(distinct parent_id) from fx_geographies) as rows
union all select 'coverage', 1""")
def _(f):
    folder = _folder(f)
    d, _, index = results(f)
    cover = mortality.coverage(f.rates.filter("age < 100").select("year", "age", "sex", (1000 * F.col("qx")).alias("value")), 2015, 2025)
    sinks.write_reports({"checks": qa.invariants(d, index), "coverage": cover}, folder)
    count = [f.spark.read.json(f"{folder}/{name}").agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows")) for name in ("checks", "coverage")]
    return count[0].unionByName(count[1])
