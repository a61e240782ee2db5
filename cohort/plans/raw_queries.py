"""Registered queries on raw counts, profiles, controls, payloads and published extracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.contracts import coverage_gaps
from cohort.functions import expressions as ex
from cohort.operators import bands, controls, model, mortality, normalise, profiling, qa
from cohort.operators.staging import shared_folder, stage
from cohort.params import Params
from cohort.plans.core_queries import R, composition, detail, results, tree, variant_totals
from cohort.plans.fixtures import Fixtures
from cohort.plans.registry import query, rounded, shared
from cohort.sources import files, sinks, tables

P = Params()
COUNTS = "espanoleshombres espanolesmujeres extranjeroshombres extranjerosmujeres".split()
KNOWN = " + ".join(f"coalesce({c}, 0)" for c in COUNTS)
BLANK = " + ".join(f"({c} is null)::int" for c in COUNTS)
CELLS = [("espanoleshombres", "male", "ESP"), ("espanolesmujeres", "female", "ESP"), ("extranjeroshombres", "male", "EXT"), ("extranjerosmujeres", "female", "EXT")]


def _unpivot(table: str, keep: str) -> str:
    return " union all ".join(f"select {keep}, '{s}' as sex, '{n}' as nationality, {c} as population from {table}" for c, s, n in CELLS)


SECTION = "'28079' || lpad({d}::varchar, 2, '0') || lpad(({s}::int % 1000)::varchar, 3, '0')"
AGE = "try_cast(cod_edad_int as int)"
STATUS = f"""case when cod_edad_int = '100 o +' then 'excluded_terminal' when {AGE} is null or {AGE} not between 0 and 130 then 'excluded_invalid_age'
 when {AGE} + {{shift}} > 99 then 'excluded_terminal' when {AGE} + {{shift}} < 10 then 'observed_born_during_interval' else 'eligible' end"""
KIND = f"case when cod_edad_int = '100 o +' then 'open_100_plus' when {AGE} is null then 'unknown' when {AGE} not between 0 and 130 then 'outside_contract' else 'single' end"

# Normalisation

shared("x_strict", f"""
select {SECTION.format(d='cod_distrito', s='cod_dist_seccion')} as geography_id, lpad(cod_distrito, 2, '0') as district_code, lpad(cod_dist_barrio, 4, '0') as barrio_code,
       case when cod_edad_int = '100 o +' then 100 else {AGE} end as age, case when cod_edad_int = '100 o +' then 'open' else 'exact' end as age_kind, {', '.join(COUNTS)}
from fx_wide_strict where cod_edad_int <> 'TOTAL'""")
shared("x_strict_long", _unpivot("x_strict", "geography_id, district_code, barrio_code, age, age_kind, substr(geography_id, 8) as section_code"))


@query("nrm1_strict_long", "select * from x_strict_long")
def _(f):
    return normalise.to_long(f.wide_strict, total_column="total")


shared("x_audit", f"""
with w as (select *, coalesce(case when cod_dist_seccion is not null then {SECTION.format(d='cod_distrito', s='cod_dist_seccion')} end, '') as source_geography_id from fx_wide),
g as (select distinct {SECTION.format(d='cod_distrito', s='cod_dist_seccion')} as id from fx_wide where cod_dist_seccion % 3 <> 0),
l as ({_unpivot('w', 'source_geography_id, cod_distrito, cod_dist_barrio, cod_dist_seccion, cod_edad_int')})
select date '2015-01-01' as reference_date, source_geography_id, case when cod_dist_seccion is null then 'missing_section' else 'coded' end as geography_status,
  lpad(cod_distrito::varchar, 2, '0') as district_code, lpad(cod_dist_barrio::varchar, 4, '0') as barrio_code, {AGE} as age, cod_edad_int as age_label, {KIND} as age_kind,
  sex, nationality, population, case when population is null then 'unknown_blank' else 'observed' end as population_status, {STATUS.format(shift=10)} as cohort_status,
  (g.id is not null)::int as has_geometry, 'jan2015' as source_file_id, '1' as schema_version
from l left join g on g.id = source_geography_id""")


def audit(f: Fixtures) -> DataFrame:
    ids = f.wide.filter("cod_dist_seccion % 3 <> 0").select(ex.section_id(F.col("cod_dist_seccion")).alias("id")).distinct()
    return normalise.to_audit(f.wide, P, "2015-01-01", ids, source_id="jan2015")


@query("nrm2_audit_long", "select * from x_audit")
def _(f):
    return audit(f)


LABELS = "select cod_edad_int from fx_wide union all select cast(l_partkey % 140 as string) from lineitem union all select case when p_size % 2 = 0 then '100 o +' else 'TOTAL' end from part"


@query("nrm3_cohort_status", f"""
select cod_edad_int as age_label, year, {AGE} as age, {KIND} as age_kind, case when year = 2015 then {STATUS.format(shift=10)} else {STATUS.format(shift=0)} end as cohort_status, count(*) as rows
from ({LABELS}) cross join (values (2015), (2025)) y(year) group by all""")
def _(f):
    labels = f.sql(LABELS).withColumn("year", F.explode(F.array(F.lit(2015), F.lit(2025))))
    out = labels.select(F.col("cod_edad_int").alias("age_label"), "year", ex.age_fields(F.col("cod_edad_int"), F.col("year"), P).alias("a"))
    return out.groupBy("age_label", "year", "a.age", "a.age_kind", "a.cohort_status").agg(F.count(F.lit(1)).alias("rows"))


CODES = """
select l_orderkey, l_linenumber, cast(l_suppkey % 23 as string) as district,
  case l_orderkey % 6 when 0 then cast(l_partkey % 1000 as string) when 1 then lpad(cast(l_suppkey % 23 as string), 2, '0') || lpad(cast(l_partkey % 1000 as string), 3, '0')
    when 2 then cast((l_suppkey % 23) * 1000 + l_partkey % 1000 as string) when 3 then '28079' || lpad(cast(l_suppkey % 23 as string), 2, '0') || lpad(cast(l_partkey % 1000 as string), 3, '0')
    when 4 then '28079' || lpad(cast(l_partkey % 23 as string), 2, '0') || '001' else 'x1' end as section,
  cast((l_suppkey % 23) * (case when l_orderkey % 2 = 0 then 100 else 10 end) + l_partkey % 12 as string) as barrio
from lineitem"""


@query("nrm4_section_codes", f"""
select section, district, case when not regexp_full_match(section, '[0-9]+') then null
  when length(section) = 10 then case when starts_with(section, '28079' || lpad(district, 2, '0')) then section end
  when length(section) in (4, 5) then case when substr(lpad(section, 5, '0'), 1, 2) = lpad(district, 2, '0') then '28079' || lpad(district, 2, '0') || substr(lpad(section, 5, '0'), 3) end
  when length(section) <= 3 then '28079' || lpad(district, 2, '0') || lpad(section, 3, '0') end as code, count(*) as rows from ({CODES}) group by all""")
def _(f):
    code = ex.canonical_section(F.col("district"), F.col("section"))
    return f.sql(CODES).groupBy("section", "district", code.alias("code")).agg(F.count(F.lit(1)).alias("rows"))


@query("nrm5_barrio_codes", f"""
select barrio, district, case when length(barrio) <= 4 and substr(lpad(barrio, 4, '0'), 1, 2) = lpad(district, 2, '0') and substr(lpad(barrio, 4, '0'), 3)::int <> 0 then lpad(barrio, 4, '0') end as by_hundred,
  case when length(barrio) <= 3 and substr(lpad(barrio, 3, '0'), 1, 2) = lpad(district, 2, '0') and substr(lpad(barrio, 3, '0'), 3)::int <> 0 then lpad(barrio, 3, '0') end as by_ten, count(*) as rows
from ({CODES}) group by all""")
def _(f):
    d, b = F.col("district"), F.col("barrio")
    return f.sql(CODES).groupBy("barrio", "district", ex.canonical_barrio(d, b, 4).alias("by_hundred"), ex.canonical_barrio(d, b, 3).alias("by_ten")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("nrm6_parent_codes", f"""
select district, barrio, case when district::int between 1 and 21 then lpad(district, 2, '0') end as district_code,
  case when district::int between 1 and 21 and barrio::int // 10 = district::int and barrio::int % 10 >= 1 then lpad(district, 2, '0') || lpad((barrio::int % 10)::varchar, 2, '0') end as parent_code, count(*) as rows
from ({CODES}) group by all""")
def _(f):
    d, b = F.col("district"), F.col("barrio")
    return f.sql(CODES).groupBy("district", "barrio", ex.canonical_parent(d).alias("district_code"), ex.canonical_parent(d, b).alias("parent_code")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("nrm7_section_ids", f"""
select cod_dist_seccion as section, case when cod_dist_seccion is not null then {SECTION.format(d='(cod_dist_seccion // 1000)', s='cod_dist_seccion')} end as section_id, count(*) as rows from fx_wide group by all""")
def _(f):
    return f.wide.groupBy(F.col("cod_dist_seccion").alias("section"), ex.section_id(F.col("cod_dist_seccion")).alias("section_id")).agg(F.count(F.lit(1)).alias("rows"))


@query("nrm8_excluded_rows", "select cod_distrito, cod_dist_barrio, cod_dist_seccion, cod_edad_int, total, 'total_or_unknown' as reason from fx_wide_strict where cod_edad_int = 'TOTAL'")
def _(f):
    _, out = normalise.split_excluded(f.wide_strict)
    return out.select("cod_distrito", "cod_dist_barrio", "cod_dist_seccion", "cod_edad_int", "total", "reason")


@query("nrm9_ambiguous_parents", """
select cod_dist_seccion as section, array_to_string(list_sort(list(distinct cod_dist_barrio)), '|') as barrios from fx_wide where cod_dist_seccion is not null group by 1 having count(distinct cod_dist_barrio) > 1""")
def _(f):
    return normalise.parents_per_section(f.wide).select("section", F.array_join(F.transform("barrios", lambda b: b.cast("string")), "|").alias("barrios"))


@query("nrm10_date_mismatches", """
select 'fx_datos_ini' as column, count(*) filter (cod_dist_barrio % 5 = 2) as mismatches from fx_wide union all select 'fx_datos_fin', count(*) filter (cod_dist_barrio % 7 = 3) from fx_wide""")
def _(f):
    dated = f.wide.withColumns({
        "fx_datos_ini": F.when(F.col("cod_dist_barrio") % 5 == 2, "2014-12-31").otherwise("2015-01-01"),
        "fx_datos_fin": F.when(F.col("cod_dist_barrio") % 7 == 3, "").otherwise("20150101")})
    return normalise.date_mismatches(dated, "2015-01-01")


@query("nrm12_grain_duplicates", """
select district as cod_distrito, barrio as cod_dist_barrio, section as cod_dist_seccion, age_label as cod_edad_int, count(*) as rows from fx_wide_cells group by all having count(*) > 1""")
def _(f):
    return normalise.grain_duplicates(f.wide_cells.select(
        F.col("district").alias("cod_distrito"), F.col("barrio").alias("cod_dist_barrio"), F.col("section").alias("cod_dist_seccion"), F.col("age_label").alias("cod_edad_int")))


@query("nrm13_city_stock", f"""
select case when cod_edad_int = '100 o +' then 100 when {AGE} between 0 and 130 then least({AGE}, 100) end as age, sex, nationality, coalesce(sum(population), 0)::bigint as population
from ({_unpivot('fx_wide', 'cod_edad_int')}) group by all""")
def _(f):
    return normalise.city_stock(f.wide)


@query("nrm16_conservation", f"""
select wide_known, long_known, wide_blank, long_blank, wide_known = long_known and wide_blank = long_blank as conserved
from (select sum({KNOWN})::bigint as wide_known, sum({BLANK})::bigint as wide_blank from fx_wide)
cross join (select sum(population)::bigint as long_known, count(*) filter (population is null) as long_blank from x_audit)""")
def _(f):
    return normalise.conservation(f.wide, audit(f))


# Profiles

WIDE_VINTAGES = f"""
select 'jan2015' as source_id, * from fx_wide
union all select 'broken', case when cod_distrito = 4 then 30 else cod_distrito end, case when cod_dist_barrio % 10 = 3 then 0 else cod_dist_barrio end, cod_dist_seccion,
  case when cod_edad_int = '7' then '700' when cod_edad_int = '8' then 'ocho' when cod_edad_int = '9' then '10' else cod_edad_int end,
  case when cod_edad_int = '12' then -1 else espanoleshombres end, espanolesmujeres, extranjeroshombres, extranjerosmujeres from fx_wide"""
SPECIAL = "sec is not null and (cod_dist_barrio = 0 or sec % 1000 in (0, 888, 999))"


def _profile_sql(source: str, by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    join = f"join d on d.{by} = w.{by} join k on k.{by} = w.{by}" if by else "cross join d cross join k"
    own = f"w.{by}, " if by else ""
    final = f"group by w.{by}" if by else ""
    good = [f"case when {c} >= 0 then {c} end" for c in COUNTS]
    return f"""
with w as (select *, case when cod_distrito between 1 and 21 and cod_dist_seccion // 1000 = cod_distrito and cod_dist_barrio is not null then cod_dist_seccion end as sec, {AGE} as age,
    {' + '.join(f'coalesce({g}, 0)' for g in good)} as known, {' + '.join(f'({c} is not null and {c} < 0)::int' for c in COUNTS)} as bad from ({source})),
d as (select {key}sum(n - 1)::bigint as dup from (select {key}coalesce(sec::varchar, cod_distrito || '/' || coalesce(cod_dist_barrio::varchar, '')) as place, sec is null as lost, coalesce(age::varchar, cod_edad_int) as label, count(*) as n
    from w group by all) {group}),
k as (select {key}count(*) filter (b > 1) as multi from (select {key}sec, count(distinct cod_dist_barrio) as b from w where sec is not null group by all) {group})
select {own}count(*) as rows, count(*) filter (cod_edad_int <> '100 o +' and (age is null or age not between 0 and 130)) as invalid_ages, sum(bad)::bigint as invalid_counts,
  count(*) filter (sec is null) as invalid_geography_rows, coalesce(sum(known) filter (sec is null), 0)::bigint as invalid_geography_known_population, count(*) filter ({SPECIAL}) as special_geography_rows,
  coalesce(sum(known) filter ({SPECIAL}), 0)::bigint as special_geography_known_population, count(*) filter (cod_edad_int = '100 o +') as open_age_rows, sum(known)::bigint as known_population_sum,
  {', '.join(f'count(*) filter ({c} is null) as blank_{c}' for c in COUNTS)}, {', '.join(f'sum(coalesce({g}, 0))::bigint as known_{c}' for g, c in zip(good, COUNTS))},
  any_value(dup) as duplicate_section_age_rows, count(distinct sec) as sections, count(distinct case when sec is not null then cod_distrito end) as districts, any_value(multi) as sections_with_multiple_barrios,
  'requires_review' as status
from w {join} {final}"""


@query("prf1_snapshot", _profile_sql("select * from fx_wide", ""))
def _(f):
    return profiling.snapshot(f.wide)


@query("prf1_age_histogram", "select cod_edad_int as age_label, count(*) as rows from fx_wide group by 1")
def _(f):
    return profiling.age_histogram(f.wide)


@query("prf1_section_population", f"select cod_dist_seccion as section, sum({KNOWN})::bigint as population from fx_wide where cod_dist_seccion is not null group by 1")
def _(f):
    return profiling.section_population(f.wide)


@query("prf2_fact_profile", """
select count(*) as fact_count, min(age) as minimum_age, max(age) as maximum_age, count(distinct age) as ages, count(distinct geography_id) as section_count, sum(population)::bigint as total,
  (select count(*) from fx_wide_strict where cod_edad_int = 'TOTAL') as excluded_rows from x_strict_long""")
def _(f):
    _, out = normalise.split_excluded(f.wide_strict)
    return profiling.facts(normalise.to_long(f.wide_strict), out)


@query("prf5_many_snapshots", _profile_sql(WIDE_VINTAGES, "source_id"))
def _(f):
    broken = f.sql(WIDE_VINTAGES)
    return profiling.snapshot(broken, by=["source_id"])


# Controls

PUBLISHED_ROWS = """
select 'Town' as Municipios, s.Sexo as Sexo, cast(year as string) as Periodo,
  case when n >= 1000000 then cast(cast(floor(n / 1000000) as bigint) as string) || '.' || lpad(cast(cast(floor(n / 1000) as bigint) % 1000 as string), 3, '0') || '.' || lpad(cast(n % 1000 as string), 3, '0')
       when n >= 1000 then cast(cast(floor(n / 1000) as bigint) as string) || '.' || lpad(cast(n % 1000 as string), 3, '0') else cast(n as string) end as Total
from (select year, 'Hombres' as Sexo, sum(case when sex = 'male' then population else 0 end) as n from fx_snapshots group by year
  union all select year, 'Mujeres', sum(case when sex = 'female' then population else 0 end) from fx_snapshots group by year
  union all select year, 'Total', sum(population) from fx_snapshots group by year) s"""


@query("src12_published_totals", """
select year, sum(population)::bigint as total, sum(population) filter (sex = 'male')::bigint as male, sum(population) filter (sex = 'female')::bigint as female from fx_snapshots where year in (2015, 2016, 2020) group by 1""")
def _(f):
    return controls.published_totals(f.sql(PUBLISHED_ROWS), "Town", [2015, 2016, 2020])


@query("ctl1_by_sex", """
with k as (select year, sum(population) filter (sex = 'male')::bigint as m, sum(population) filter (sex = 'female')::bigint as w from fx_snapshots group by 1)
select year, m + w as known_total, (year % 2)::bigint as difference_male, 0::bigint as difference_female, (year % 2)::bigint as difference_total,
  round(100 * (year % 2) / (m + w - year % 2), 6) as difference_percent, case when year % 2 = 0 then 'exact_match' else 'different_series_unresolved' end as status from k""")
def _(f):
    sexes = f.snapshots.groupBy("year").agg(F.sum(F.when(F.col("sex") == "male", F.col("population"))).alias("known_male"), F.sum(F.when(F.col("sex") == "female", F.col("population"))).alias("known_female"))
    published = controls.published_totals(f.sql(PUBLISHED_ROWS), "Town", range(2015, 2022))
    off = F.col("year") % 2
    return rounded(controls.by_sex(sexes, published.withColumns({"male": F.col("male") - off, "total": F.col("total") - off})))


shared("x_sec_raw", f"select {SECTION.format(d='cod_distrito', s='cod_dist_seccion')} as section_id, sum({KNOWN})::bigint as population from fx_wide where cod_dist_seccion is not null group by all")
shared("x_sec_pub", "select case when substr(section_id, 10) = '5' then section_id || 'x' else section_id end as section_id, population + (case when substr(section_id, 10) = '7' then 2 else 0 end) as population from x_sec_raw")


def section_pair(f: Fixtures) -> DataFrame:
    raw = profiling.section_population(f.wide).select(ex.section_id(F.col("section")).alias("section_id"), "population")
    last = F.substring("section_id", 10, 1)
    published = raw.select(F.when(last == "5", F.concat("section_id", F.lit("x"))).otherwise(F.col("section_id")).alias("section_id"), (F.col("population") + F.when(last == "7", 2).otherwise(0)).alias("population"))
    return controls.sections(raw, published)


SECTION_DIFF = """select coalesce(r.section_id, p.section_id) as section_id, r.population as raw, p.population as published, coalesce(r.population, 0) - coalesce(p.population, 0) as difference,
  case when p.population is null then 'raw_only' when r.population is null then 'published_only' else 'both' end as side from x_sec_raw r full join x_sec_pub p on p.section_id = r.section_id"""


@query("ctl2_sections", SECTION_DIFF)
def _(f):
    return section_pair(f)


@query("ctl2_section_summary", f"""
select count(*) filter (side <> 'raw_only' and difference = 0) as matching, count(*) filter (side <> 'raw_only' and difference <> 0) as differing, count(*) filter (side = 'raw_only') as raw_only,
  count(*) filter (side = 'published_only') as published_only, sum(difference)::bigint as difference, sum(raw)::bigint as raw_total, sum(published)::bigint as published_total,
  sum(difference) = sum(coalesce(raw, 0)) - sum(coalesce(published, 0)) as accounted from ({SECTION_DIFF})""")
def _(f):
    return controls.section_summary(section_pair(f))


@query("ctl3_reconciliation", """
select p.area_id, p.year, p.age, p.nationality, p.population, p.tolerance, coalesce(sum(c.population), 0)::double as calculated, (coalesce(sum(c.population), 0) - p.population)::double as difference,
  abs(coalesce(sum(c.population), 0) - p.population) <= p.tolerance as passed
from fx_published p left join x_comp c on c.area_id = p.area_id and c.year = p.year and (p.age is null or p.age = c.age) and (p.nationality is null or p.nationality = c.nationality)
group by p.area_id, p.year, p.age, p.nationality, p.population, p.tolerance""")
def _(f):
    return controls.reconcile(composition(f), f.published, f.geographies)


shared("x_known", f"""
select {AGE} as age, sex, nationality, coalesce(sum(population), 0)::bigint as known, count(*) filter (population is null) as blank from ({_unpivot('fx_wide', 'cod_edad_int')}) where {AGE} < 100 group by all""")


@query("ctl4_age_controls", """
select coalesce(k.age, c.age) as age, coalesce(k.sex, c.sex) as sex, coalesce(k.nationality, c.nationality) as nationality, k.known, c.population as control,
  coalesce(k.known, 0) - coalesce(c.population, 0) as difference, coalesce(k.known = c.population, false) as matched
from x_known k full join fx_controls c on c.age = k.age and c.sex = k.sex and c.nationality = k.nationality""")
def _(f):
    return controls.match(controls.known_cells(f.wide), f.controls, ["age", "sex", "nationality"])


@query("ctl4_city_report", f"""
select count(*) as rows, sum({KNOWN})::bigint as known_total, sum({KNOWN})::bigint as modelled_stock, 0::bigint as invalid_age_population, sum({BLANK})::bigint as raw_blank_cells,
  (select count(*) from fx_controls where age = 30) as control_differences, false as controls_matched, 0::bigint as inferred_blank_cells from fx_wide""")
def _(f):
    off = F.col("population") + F.when(F.col("age") == 30, 1).otherwise(0)
    return controls.city_report(f.wide, f.controls.withColumn("population", off))


@query("ctl4_city_report_matched", f"""
select count(*) as rows, sum({KNOWN})::bigint as known_total, sum({BLANK})::bigint as raw_blank_cells,
  (select count(*) from (select age, sex, nationality, sum(population)::bigint as known from x_audit where age < 100 group by all) k
   full join fx_controls c on c.age = k.age and c.sex = k.sex and c.nationality = k.nationality where coalesce(k.known, 0) <> c.population or c.population is null) as control_differences from fx_wide""")
def _(f):
    return controls.city_report(f.wide, f.controls).select("rows", "known_total", "raw_blank_cells", "control_differences")


@query("ctl4_barrio_stock", f"select cod_distrito as district, cod_dist_barrio as barrio, sum({KNOWN})::bigint as population from fx_wide group by all")
def _(f):
    return controls.barrio_stock(f.wide)


shared("x_district_known", f"""
select cod_distrito as district, {AGE} as age, sex, nationality, coalesce(sum(population), 0)::bigint as known from ({_unpivot('fx_wide', 'cod_distrito, cod_edad_int')}) where {AGE} < 100 group by all""")
DISTRICT_MATCH = """
select coalesce(k.district, c.district) as district, coalesce(k.known = c.population, false) as matched from x_district_known k
full join fx_district_controls c on c.district = k.district and c.age = k.age and c.sex = k.sex and c.nationality = k.nationality"""
DISTRICT_KEYS = ["district", "age", "sex", "nationality"]


def district_known(f: Fixtures) -> DataFrame:
    return controls.known_cells(f.wide.withColumn("district", F.col("cod_distrito")), ["district"])


@query("ctl5_group_counts", f"select district, count(*) as cells, count(*) filter (not matched) as mismatches, bool_and(matched) as matched from ({DISTRICT_MATCH}) group by 1")
def _(f):
    return controls.match_summary(controls.match(district_known(f), f.district_controls, DISTRICT_KEYS), ["district"])


@query("ctl5_verified_cells", "select count(*) as verified_cells from fx_controls")
def _(f):
    return controls.verified(controls.match(controls.known_cells(f.wide), f.controls, ["age", "sex", "nationality"]))


@query("ctl6_policy_cells", f"""
select cod_distrito as district, {AGE} as age, sex, nationality, coalesce(sum(population), 0)::bigint as known, count(*) filter (population is null) as blank
from ({_unpivot('fx_wide', 'cod_distrito, cod_edad_int')}) where {AGE} between 0 and 89 group by all""")
def _(f):
    return district_known(f).filter("age <= 89")


@query("ctl7_zero_fill", """
select source_geography_id, barrio_code, age_label, sex, nationality, population_status as raw_population_status, case when population_status = 'unknown_blank' and cohort_status = 'eligible' then 'zero-v1' end as count_policy_id,
  case when population_status = 'unknown_blank' and cohort_status = 'eligible' then 0 else population end as population,
  case when population_status = 'unknown_blank' and cohort_status = 'eligible' then 'inferred_zero_monthly_control' else population_status end as population_status from x_audit""")
def _(f):
    filled = controls.fill_zero(audit(f), "zero-v1")
    return filled.select("source_geography_id", "barrio_code", "age_label", "sex", "nationality", "raw_population_status", "count_policy_id", "population", "population_status")


@query("ctl7_fill_summary", """
select count(*) filter (population is null) as raw_blanks, count(*) filter (population is null and cohort_status = 'eligible') as inferred_zero_cells,
  count(*) filter (population is null and cohort_status <> 'eligible') as out_of_scope_blanks, sum(population)::bigint as population from x_audit""")
def _(f):
    return controls.fill_summary(controls.fill_zero(audit(f), "zero-v1"))


@query("ctl8_row_equality", """
select o_orderkey as row_number, case when o_orderkey % 50 = 1 then 'left_only' when o_orderkey % 50 = 2 then 'right_only' else 'different' end as kind from orders where o_orderkey % 50 in (1, 2) or o_orderkey % 70 = 3""")
def _(f):
    o = f.table("orders").select(F.col("o_orderkey").alias("row_number"), "o_custkey", "o_orderstatus", "o_totalprice")
    left = o.filter("row_number % 50 <> 2")
    right = o.filter("row_number % 50 <> 1").withColumn("o_orderstatus", F.when(F.col("row_number") % 70 == 3, "?").otherwise(F.col("o_orderstatus")))
    return controls.rows_equal(left, right)


@query("ctl8_multiset_difference", """
select geography_id, age, sex, nationality, population, 'left_only' as side from (select * from fx_population_start except all select * from fx_population_end)
union all select geography_id, age, sex, nationality, population, 'right_only' from (select * from fx_population_end except all select * from fx_population_start)""")
def _(f):
    return controls.multiset_difference(f.population_start, f.population_end)


@query("ctl9_missing_totals", """
select area_id, y as year from fx_geographies cross join (values (2015), (2025)) t(y) where level <> 'section'
  and not exists (select 1 from fx_published p where p.area_id = fx_geographies.area_id and p.year = y and p.age is null and p.nationality is null)""")
def _(f):
    return controls.missing_totals(f.published, f.geographies, [2015, 2025])


@query("ctl10_snapshot_coverage", """
select make_date(y, 1, 1) as reference_date, 'no_profile' as problem from range(2014, 2026) t(y) where y not in (select distinct year from fx_snapshots)
union all select make_date(year, 1, 1), 'not_pinned' from (select distinct year from fx_snapshots) where year % 3 = 0""")
def _(f):
    day = F.make_date("year", F.lit(1), F.lit(1))
    years = f.snapshots.groupBy("year").agg(F.sum("population").alias("n")).select(day.alias("reference_date"), "year", F.sha2(F.col("n").cast("string"), 256).alias("sha256"))
    pinned = years.withColumn("sha256", F.when(F.col("year") % 3 == 0, "changed").otherwise(F.col("sha256"))).select("reference_date", "sha256")
    return controls.missing_snapshots(years.select("reference_date", "sha256"), pinned, 2014, 2025)


CITY_COLUMNS = ", ".join(f"sum(case when sex = '{s}' and nationality = '{n}' then population else 0 end)::bigint as {c}" for c, s, n in CELLS)


@query("ctl11_column_match", f"""
with k as (select year, {CITY_COLUMNS} from fx_snapshots group by 1), l as (unpivot k on {', '.join(COUNTS)} into name count_column value known)
select year, count_column, known, known + (case when year = 2018 and count_column = 'extranjeroshombres' then 1 else 0 end) as control,
  -(case when year = 2018 and count_column = 'extranjeroshombres' then 1 else 0 end)::bigint as difference, not (year = 2018 and count_column = 'extranjeroshombres') as matched from l""")
def _(f):
    sums = [F.sum(F.when((F.col("sex") == s) & (F.col("nationality") == n), F.col("population")).otherwise(0)).alias(c) for c, s, n in CELLS]
    ours = f.snapshots.groupBy("year").agg(*sums)
    bank = ours.withColumn("extranjeroshombres", F.col("extranjeroshombres") + F.when(F.col("year") == 2018, 1).otherwise(0))
    return controls.column_match(ours, bank)


@query("con1_key_coverage", """
with a as (select distinct geography_id, age, sex, nationality from fx_population_start), b as (select distinct geography_id, age, sex, nationality from fx_population_end)
select *, 'missing' as gap from (select * from b except select * from a) union all select *, 'unexpected' from (select * from a except select * from b)""")
def _(f):
    return coverage_gaps(f.population_start, f.population_end, list(model.CELL))


GATES = ["arithmetic", "published_totals", "mortality_coverage", "independent_survival"]


def gate_results(f: Fixtures) -> DataFrame:
    """Computed checks for an inclusive and an exact tier of one window."""
    d, _, index = results(f)
    exact = F.col("boundary_status").isin("unchanged", "exact_harmonisation")
    checks = qa.invariants(d, index).join(index.select("area_id", "boundary_status"), "area_id")
    tiers = F.explode(F.when(exact, F.array(F.lit("inclusive"), F.lit("exact"))).otherwise(F.array(F.lit("inclusive")))).alias("tier")
    arithmetic = checks.select(tiers, F.lit("arithmetic").alias("gate"), "passed")
    totals = controls.reconcile(composition(f), f.published, f.geographies).select(F.lit("inclusive").alias("tier"), F.lit("published_totals").alias("gate"), "passed")
    cover = mortality.coverage(f.mortality.withColumn("value", 1000 * F.col("qx")), 2015, 2025).select(
        F.explode(F.array(F.lit("inclusive"), F.lit("exact"))).alias("tier"), F.lit("mortality_coverage").alias("gate"), F.col("covered").alias("passed"))
    return arithmetic.unionByName(totals).unionByName(cover)


@query("qa7_gates", """
select tier, gate, gate in ('arithmetic', 'mortality_coverage') as passed from (values ('inclusive'), ('exact')) t(tier)
cross join (values ('arithmetic'), ('published_totals'), ('mortality_coverage'), ('independent_survival')) g(gate)""")
def _(f):
    return qa.gates(gate_results(f), GATES, ["tier"])


@query("qa7_release", "select tier, false as released, 'independent_survival|published_totals' as blocked_by from (values ('inclusive'), ('exact')) t(tier)")
def _(f):
    verdict = qa.released(qa.gates(gate_results(f), GATES, ["tier"]), ["tier"])
    return verdict.withColumn("blocked_by", F.array_join("blocked_by", "|"))


# Structured sources

@query("src7_series", "select year, age, sex, round(qx, 9) as qx from fx_rates where year between 2015 and 2024 and age <= 100")
def _(f):
    rates = f.rates.filter("age <= 100")
    sex, age = F.when(F.col("sex") == "male", "M1").otherwise("F6"), F.concat(F.lit("A"), F.col("age"))
    def meta(variable: str, code):
        return F.struct(F.struct(F.lit(variable).alias("Codigo")).alias("Variable"), code.alias("Codigo"))
    kind = F.explode(F.array(F.lit("risk"), F.lit("other")))
    rows = rates.groupBy("sex", "age").agg(F.collect_list(F.struct(F.col("year").alias("Anyo"), F.col("qx").alias("Valor"))).alias("Data")).withColumn("k", kind)
    text = rows.select(F.to_json(F.struct(F.array(meta("18", sex), meta("366", age), meta("3", F.col("k"))).alias("MetaData"), "Data")).alias("j"))
    schema = "MetaData array<struct<Variable:struct<Codigo:string>,Codigo:string>>, Data array<struct<Anyo:int,Valor:double>>"
    series = text.select(F.from_json("j", schema).alias("s")).select("s.*")
    ages = f.spark.range(101).select(F.concat(F.lit("A"), F.col("id")).alias("code"), F.col("id").cast("int").alias("age"))
    sexes = f.spark.createDataFrame([("M1", "male"), ("F6", "female")], "code string, sex string")
    found = tables.series_observations(series, {"3": "risk"}, "366", "18", ages, sexes, 2015, 2025)
    return rounded(mortality.to_qx(found.withColumnRenamed("value", "qx"), "qx"), 9)


@query("src8_bank_controls", """
select g.district, g.age, k.sex, k.nationality, coalesce(c.population, 0) as population
from (select distinct district, age from fx_district_controls) g
cross join (select distinct s as sex, n as nationality from (values ('male'), ('female')) a(s) cross join (values ('ESP'), ('EXT')) b(n)) k
left join fx_district_controls c on c.district = g.district and c.age = g.age and c.sex = k.sex and c.nationality = k.nationality""")
def _(f):
    wide = f.district_controls.groupBy("district", "age").agg(*[
        F.max(F.when((F.col("sex") == s) & (F.col("nationality") == n), F.col("population"))).alias(tables.BANK_FIELDS[c]) for c, s, n in CELLS])
    records = wide.select("district", F.struct(
        F.struct(F.col("district").cast("string").alias("VCodigo")).alias("distrito"), F.col("age").cast("string").alias("VEdad"),
        *[F.coalesce(b, F.lit(0)).alias(b) for b in tables.BANK_FIELDS.values()]).alias("r"))
    body = records.groupBy("district").agg(F.collect_list("r").alias("listaConsulta")).select(F.to_json(F.struct(
        F.lit("success").alias("status"), F.create_map(F.lit("Año: "), F.lit("2015")).alias("mapaEpigrafesFiltros"), "listaConsulta")).alias("j"))
    responses = body.select(F.from_json("j", tables.BANK_SCHEMA).alias("b")).select("b.*")
    keys = f.district_controls.select("district", "age").distinct()
    return tables.bank_controls(responses, {"Año: ": "2015"}, keys)


def sheet(f: Fixtures) -> DataFrame:
    """Totals sheet cells derived from section counts: a city row and one row per section."""
    counts = f.wide.filter("cod_dist_seccion is not null").groupBy("cod_dist_seccion").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS])
    city = counts.agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("cod_dist_seccion", F.lit(3))
    m, w, x, y = (F.col(c) for c in COUNTS)
    none = F.col("cod_dist_seccion") % 2
    values = {"C": m + w + x + y + none, "D": m + x + none, "E": w + y, "G": m + w, "H": m, "I": w, "K": x + y, "L": x, "M": y, "O": none, "P": none, "Q": F.lit(0)}
    first = F.when(F.col("cod_dist_seccion") == 3, "City total")
    code = F.when(F.col("cod_dist_seccion") != 3, F.lpad(F.col("cod_dist_seccion").cast("string"), 5, "0"))
    cells = F.inline(F.array(
        F.struct(F.lit("A").alias("col"), first.alias("value")), F.struct(F.lit("B"), code).cast("struct<col:string,value:string>"),
        *[F.struct(F.lit(k), v.cast("string")).cast("struct<col:string,value:string>") for k, v in values.items()]))
    return counts.unionByName(city).select(F.lit("2015").alias("sheet"), F.col("cod_dist_seccion").alias("row"), cells).filter("value is not null")


shared("x_sheet", f"select cod_dist_seccion as s, {', '.join(f'sum(coalesce({c}, 0))::bigint as {c}' for c in COUNTS)} from fx_wide where cod_dist_seccion is not null group by 1")
SHEET = """(a + b + c + d + n)::bigint as total, (a + c + n)::bigint as male, (b + d)::bigint as female, (a + b)::bigint as esp_total, a::bigint as esp_male, b::bigint as esp_female,
(c + d)::bigint as ext_total, c::bigint as ext_male, d::bigint as ext_female, n::bigint as none_total, n::bigint as none_male, 0::bigint as none_female"""


@query("src13_sheet_sections", f"""
select '2015' as sheet, '28079' || lpad(s::varchar, 5, '0') as section_id, {SHEET} from (select s, s % 2 as n, {', '.join(f'{c} as {k}' for c, k in zip(COUNTS, 'abcd'))} from x_sheet)""")
def _(f):
    return tables.sheet_sections(sheet(f), "28079")


@query("src13_sheet_city", f"""
select '2015' as sheet, 3 as row, {SHEET} from (select 1 as n, {', '.join(f'sum({c}) as {k}' for c, k in zip(COUNTS, 'abcd'))} from x_sheet)""")
def _(f):
    return tables.sheet_city(sheet(f), "City total")


REGISTRY_TABLE = """
select cast(s_suppkey as int) as row_number, cast(s_nationkey % 21 + 1 as string) as district, cast((s_nationkey % 21 + 1) * 10 + s_suppkey % 9 + 1 as string) as barrio,
  cast(s_suppkey % 999 + 1 as string) as section, '19880101' as created_raw, '' as closed_raw, '' as modified_raw,
  case when s_suppkey % 4 = 0 then cast((s_nationkey % 21 + 1) * 10 + s_suppkey % 8 + 1 as string) else '' end as old_barrio from supplier"""


@query("src14_registry_rows", f"""
select row_number, '28079' || lpad(district, 2, '0') || lpad(section, 3, '0') as section_id, lpad(district, 2, '0') || lpad((barrio::int % 10)::varchar, 2, '0') as parent,
  case when old_barrio <> '' then lpad(district, 2, '0') || lpad((old_barrio::int % 10)::varchar, 2, '0') end as previous_parent, created_raw, closed_raw, modified_raw from ({REGISTRY_TABLE})""")
def _(f):
    return tables.registry_rows(f.sql(REGISTRY_TABLE), "28079")


# Payloads

@query("src15_verified_payloads", """
select url as name, case when page_id % 7 = 0 then 'changed' else sha256(html) end as sha256, strlen(html)::bigint + (page_id % 5 = 0)::int as bytes, not (page_id % 7 = 0 or page_id % 5 = 0) as passed from pages""")
def _(f):
    pages = f.table("pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    found = files.inventory(pages)
    lock = pages.select(F.col("path").alias("name"), F.when(F.col("page_id") % 7 == 0, "changed").otherwise(F.sha2("content", 256)).alias("sha256"),
                        (F.octet_length("content") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).cast("bigint").alias("bytes"))
    return files.verify(lock, found)


@query("src17_payload_kinds", """
select doc_id as name, kind, case when content = '' then 'empty payload' when kind = 'pdf' and not starts_with(content, '%PDF-') then 'no PDF signature' end as problem,
  case when content <> '' and kind = 'csv' then lower(hex(split_part(content, chr(10), 1))) end as detail
from (select doc_id, case doc_id % 3 when 0 then 'pdf' when 1 then 'csv' else 'html' end as kind, case when doc_id % 11 = 0 then '' when doc_id % 4 = 0 then '%PDF-' || text else text end as content from documents)""")
def _(f):
    i = F.col("doc_id")
    docs = f.table("documents").select(
        "doc_id", F.when(i % 3 == 0, "pdf").when(i % 3 == 1, "csv").otherwise("html").alias("kind"),
        F.when(i % 11 == 0, "").when(i % 4 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).alias("content"))
    return files.sniff(docs, name="doc_id")


@query("src18_page_links", """
with h as (select page_id, url, unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*?\\shref\\s*=\\s*"([^"]*)"', 1)) as h from pages)
select distinct page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(h, '&amp;', '&') as resource_url from h where h <> '' and (contains(lower(h), 'th') or contains(lower(h), 'un'))""")
def _(f):
    return files.links(f.table("pages"), ("th", "un"))


# Published extracts

@query("snk2_mortality_rows", "select year, age, sex, round(qx, 12) as qx from fx_rates order by year, age, sex")
def _(f):
    return rounded(f.rates.select("year", "age", "sex", "qx").orderBy("year", "age", "sex"), 12)


@query("snk4_detail_with_quality", f"""
select d.area_id, age, sex, nationality, cohort_eligible, exclusion_reason, {R('d.baseline d.expected d.actual d.residual').replace('as d.', 'as ')}, name, level, effective_status as boundary_status
from x_detail d join fx_geographies g on g.area_id = d.area_id join x_quality q on q.area_id = d.area_id""")
def _(f):
    d, _, index = results(f)
    return rounded(sinks.detail_with_quality(d, index))


@query("snk7_area_payloads", """
with s as (select cast(age - (year - 2015) as int) as age, sex, list_reduce(list(1 - qx order by year), lambda a, b: a * b) as survival
  from fx_mortality where year between 2015 and 2024 and age >= year - 2015 group by 1, 2 having count(*) = 10),
n as (select ancestor_id as area_id, p.age + 10 as age, nationality, sum(cast(floor(population * survival * 1e9 + 0.5) as bigint)) as nano
  from fx_population_start p join s on s.age = p.age and s.sex = p.sex join x_closure on geography_id = area_id where p.age + 10 < 100 group by all),
t as (select area_id, sum(nano) as nano from n group by 1),
p as (select area_id, list({'age': age, 'nationality': nationality, 'baseline': baseline::decimal(18,6), 'expected': (coalesce(nano, 0)::decimal(28,0) * 0.000000001::decimal(10,9))::decimal(18,6),
    'actual': actual::decimal(18,6)} order by age, nationality) as profile
  from x_profile left join n using (area_id, age, nationality) where cohort_eligible group by 1),
j as (select i.area_id, to_json({'area_id': i.area_id, 'name': name, 'level': level, 'boundary_status': boundary_status,
    'expected': (coalesce(nano, 0)::decimal(28,0) * 0.000000001::decimal(10,9))::decimal(18,6), 'actual': actual::decimal(18,6), 'profile': profile})::varchar as body
  from x_index i join p on p.area_id = i.area_id left join t on t.area_id = i.area_id)
select area_id, body, sha256(body) as sha256, strlen(body)::int as bytes from j""")
def _(f):
    _, prof, index = results(f)
    exact = stage(model.exact_expected(f.population_start, mortality.survival(f.mortality, P.start_year, P.end_year), tree(f), P))
    total = exact.groupBy("area_id").agg(F.sum("expected").alias("expected"))

    def exactly(df: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
        return df.drop("expected").join(sums, keys, "left").withColumn("expected", F.coalesce("expected", F.lit(0)))

    return sinks.area_payloads(exactly(prof.filter("cohort_eligible"), exact, ["area_id", "age", "nationality"]), exactly(index, total, ["area_id"]))


@query("snk7_sensitivity_payloads")
def _(f):
    _, prof, index = results(f)
    return sinks.area_payloads(prof, index, variant_totals(f))


@query("snk8_indicator_partitions", "select level, preset, count(*) as areas from x_indicators group by all")
def _(f):
    _, prof, index = results(f)
    return bands.indicators(prof, index, P).groupBy("level", "preset").agg(F.count(F.lit(1)).alias("areas"))


@query("snk10_small_areas", f"""
select area_id, name, level, parent_id, boundary_status, rate_suppressed, {R('baseline expected actual residual residual_per_1000')} from x_index where level = 'section'""")
def _(f):
    _, _, index = results(f)
    return rounded(sinks.small_areas(index))


@query("snk11_publication_count", """
select count(*) filter (population is null and cohort_status = 'eligible') as inferred, count(*) as rows,
       count(*) filter (population is null and cohort_status = 'eligible') as recorded from x_audit""")
def _(f):
    """Published and read back; the verified count is that of the source's blank cells, not of the table that is written."""
    blank = " + ".join(f"if({c} is null, 1, 0)" for c in COUNTS)
    blanks = f.sql(f"select coalesce(sum({blank}), 0) as n from fx_wide where try_cast(cod_edad_int as int) between 0 and 89").head().n
    path = f"{shared_folder(f.spark)}/trip-{uuid.uuid4().hex}/filled"
    sinks.publish_checked(controls.fill_zero(audit(f), "zero-v1"), path, blanks, "count_policy_id")
    recorded = sinks.manifest(f.spark, path).filter("column = 'count_policy_id'").agg(F.sum("n").alias("n"))
    back = f.spark.read.parquet(path).agg(F.count("count_policy_id").alias("inferred"), F.count(F.lit(1)).alias("rows"))
    return back.withColumn("recorded", recorded.scalar())


@query("snk12_table_inventory")
def _(f):
    return files.file_inventory(f.spark, f.folder, "*.parquet")


@query("snk12_changed_payloads", """
with recorded as (select url as name, sha256(case when page_id % 7 = 0 then html || '!' else html end) as sha from pages),
found as (select url as name, sha256(html) as sha from pages where page_id % 9 <> 4)
select name, case when name in (select name from found) then 'changed' else 'missing' end as problem from recorded r
where not exists (select 1 from found f where f.name = r.name and f.sha = r.sha)
union all select name, 'unrecorded' from found where name not in (select name from recorded)""")
def _(f):
    pages = f.table("pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    recorded = files.inventory(pages.withColumn("content", F.when(F.col("page_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return files.changed(recorded, files.inventory(pages.filter("page_id % 9 <> 4")))
