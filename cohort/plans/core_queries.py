"""Registered queries of the cohort core, hierarchy, life tables, bands, scenarios and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.contracts import violations
from cohort.operators import bands, controls, hierarchy, model, mortality, profiling, qa, scenarios
from cohort.operators.staging import stage
from cohort.params import Params
from cohort.plans.fixtures import Fixtures
from cohort.plans.registry import query, rounded, shared
from cohort.sources import tables

P = Params()
SPARSE = Params(min_expected=4000.0)
WINDOWS = [("2015-2018", 2015, 2018, 100), ("2016-2020", 2016, 2020, 100), ("2015-2021", 2015, 2021, 95)]


_TREES: dict[tuple[str, str], hierarchy.Tree] = {}


def tree(f: Fixtures) -> hierarchy.Tree:
    """The tree of a data folder, written once in a session."""
    key = f.spark.sparkContext.applicationId, f.folder
    if key not in _TREES:
        _TREES[key] = hierarchy.tree(f.geographies)
    return _TREES[key]


def detail(f: Fixtures, params: Params = P, **kw) -> DataFrame:
    return model.cohort_detail(f.population_start, f.population_end, f.mortality, tree(f), params, **kw)


def index(f: Fixtures, params: Params = P) -> DataFrame:
    return model.area_index(f.population_start, f.population_end, detail(f, params), f.geographies, tree(f), params)


def profile(f: Fixtures, params: Params = P) -> DataFrame:
    return model.profile(detail(f, params), params)


def results(f: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(detail, profile, index)`` over one written detail table, for queries that need several."""
    d = stage(detail(f))
    return d, model.profile(d, P), model.area_index(f.population_start, f.population_end, d, f.geographies, tree(f), P)


def composition(f: Fixtures) -> DataFrame:
    return model.composition(f.population_start, f.population_end, tree(f), P)


shared("x_closure", """/*cols: area_id, ancestor_id, depth*/
select area_id, area_id, 0 from fx_geographies
union all select c.area_id, g.parent_id, c.depth + 1 from x_closure c join fx_geographies g on g.area_id = c.ancestor_id where g.parent_id is not null""")
shared("x_survival", """
select cast(age - (year - 2015) as int) as age, sex, case when count(*) = 10 then product(1 - qx) end as survival
from fx_mortality where year between 2015 and 2024 and age >= year - 2015 group by 1, 2""")
shared("x_aged", """
select p.geography_id, cast(p.age + 10 as int) as age, p.sex, p.nationality, cast(population as double) as baseline,
       case when p.age + 10 < 100 and population <> 0 then population * survival else 0 end as expected
from fx_population_start p left join x_survival s on s.age = p.age and s.sex = p.sex""")
shared("x_leafcells", """
select geography_id, age, sex, nationality, baseline, expected, 0::double as actual from x_aged
union all select geography_id, age, sex, nationality, 0, 0, population from fx_population_end""")
shared("x_summed", """
select ancestor_id as area_id, age, sex, nationality, sum(baseline)::double as baseline, sum(expected)::double as expected, sum(actual)::double as actual
from x_leafcells join x_closure on geography_id = area_id group by all""")
FLAGS = """
baseline, case when age between 10 and 99 then expected end as expected, actual, age between 10 and 99 as cohort_eligible,
case when age between 10 and 99 then actual - expected end as residual,
case when age < 10 then 'born_during_interval' when age >= 100 then 'terminal_age' end as exclusion_reason"""
shared("x_detail", f"select area_id, age, sex, nationality, {FLAGS} from x_summed")
shared("x_by_age", """
select area_id, age, nationality, sum(baseline) as baseline, sum(expected) as expected, sum(actual) as actual from x_summed group by all""")
shared("x_profile", f"select area_id, age, nationality, {FLAGS}, not (age between 10 and 99) or expected < 20 as rate_suppressed from x_by_age")
shared("x_totals", """
select area_id, coalesce(sum(baseline) filter (cohort_eligible), 0) as baseline, coalesce(sum(expected) filter (cohort_eligible), 0) as expected,
       coalesce(sum(actual) filter (cohort_eligible), 0) as actual, coalesce(sum(actual) filter (age < 10), 0) as observed_under_interval,
       coalesce(sum(actual) filter (age >= 100), 0) as observed_terminal
from x_detail group by area_id""")
RANK = "case {} when 'unchanged' then 0 when 'exact_harmonisation' then 1 when 'estimated_harmonisation' then 2 else 3 end"
shared("x_leaf", """
select geography_id, sum(population) as total from (select geography_id, population from fx_population_start union all select geography_id, 0 from fx_population_end) group by 1""")
shared("x_quality", f"""
select a.area_id, case greatest({RANK.format('a.boundary_status')}, coalesce(worst, 0)) when 0 then 'unchanged' when 1 then 'exact_harmonisation'
       when 2 then 'estimated_harmonisation' else 'unreliable' end as effective_status,
       coalesce(affected / nullif(total, 0), 0)::double as affected_share
from fx_geographies a left join (
  select c.ancestor_id, max({RANK.format('g.boundary_status')}) as worst, sum(total) as total,
         sum(case when {RANK.format('g.boundary_status')} >= 2 then total else 0 end) as affected
  from x_leaf l join fx_geographies g on g.area_id = l.geography_id join x_closure c on c.area_id = l.geography_id group by 1) b on b.ancestor_id = a.area_id""")
RATES = """actual - expected as residual, actual - baseline as observed_change, baseline - expected as modelled_deaths,
case when expected >= {m} then 1000 * (actual - expected) / nullif(expected, 0) end as residual_per_1000,
case when expected >= {m} then 1000 * (actual - expected) / nullif(expected, 0) / 10 end as annualised_residual_per_1000,
expected < {m} as rate_suppressed"""
shared("x_index", f"""
select g.area_id, name, level, parent_id, effective_status as boundary_status, affected_share,
       coalesce(baseline, 0) as baseline, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual,
       coalesce(observed_under_interval, 0) as observed_under_interval, coalesce(observed_terminal, 0) as observed_terminal,
       coalesce(actual, 0) - coalesce(expected, 0) as residual, coalesce(actual, 0) - coalesce(baseline, 0) as observed_change,
       coalesce(baseline, 0) - coalesce(expected, 0) as modelled_deaths,
       case when expected >= 20 then 1000 * (actual - expected) / nullif(expected, 0) end as residual_per_1000,
       case when expected >= 20 then 1000 * (actual - expected) / nullif(expected, 0) / 10 end as annualised_residual_per_1000,
       coalesce(expected, 0) < 20 as rate_suppressed, effective_status in ('unchanged', 'exact_harmonisation') as default_visible
from fx_geographies g join x_quality q on q.area_id = g.area_id left join x_totals t on t.area_id = g.area_id""")
shared("x_comp", """
select ancestor_id as area_id, year, age, nationality, sum(population)::double as population
from (select 2015 as year, * from fx_population_start union all select 2025, * from fx_population_end) join x_closure on geography_id = area_id group by all""")


def R(columns: str) -> str:
    """``a b`` to ``round(a, 6) as a, round(b, 6) as b``."""
    return ", ".join(f"round({c}, 6) as {c}" for c in columns.split())


INDEX_COLUMNS = (
    "area_id, name, level, parent_id, boundary_status, rate_suppressed, default_visible, "
    + R("affected_share baseline expected actual observed_under_interval observed_terminal residual observed_change modelled_deaths residual_per_1000 annualised_residual_per_1000")
)


# Hierarchy

@query("hie1_closure", "select area_id, ancestor_id, depth from x_closure")
def _(f):
    return hierarchy.closure(f.geographies)


@query("hie1_intervals", """
with recursive p as (select area_id, [area_id] as path from fx_geographies where parent_id is null
  union all select g.area_id, list_append(p.path, g.area_id) from p join fx_geographies g on g.parent_id = p.area_id),
n as (select ancestor_id as area_id, count(*) as n from x_closure group by 1)
select area_id, low, low + n - 1 as high, depth
from (select area_id, row_number() over (order by path) - 1 as low, len(path) - 1 as depth from p) join n using (area_id)""")
def _(f):
    return hierarchy.intervals(tree(f))


@query("hie2_mixed_grain", """
with ids as (select distinct geography_id as area_id from fx_population_start union select 'N' || cast(c_nationkey as string) from customer)
select distinct i.area_id from ids i join x_closure c on c.ancestor_id = i.area_id and c.depth > 0 join ids l on l.area_id = c.area_id""")
def _(f):
    extra = f.sql("select 'N' || cast(c_nationkey as string) as area_id from customer")
    return hierarchy.mixed_grain(f.population_start.select(F.col("geography_id").alias("area_id")).unionByName(extra), tree(f))


@query("hie3_roll_up", """
select ancestor_id as area_id, nationality, sum(population)::bigint as population from fx_population_start join x_closure on geography_id = area_id group by all""")
def _(f):
    return hierarchy.roll_up(f.population_start, tree(f), ["nationality"], ["population"])


@query("hie4_effective_status", "select area_id, effective_status from x_quality")
def _(f):
    leaves = hierarchy.leaf_totals(f.population_start, f.population_end)
    return hierarchy.effective_status(f.geographies, tree(f), leaves).select("area_id", "effective_status")


@query("hie5_affected_share", "select area_id, round(affected_share, 6) as affected_share from x_quality")
def _(f):
    leaves = hierarchy.leaf_totals(f.population_start, f.population_end)
    return rounded(hierarchy.effective_status(f.geographies, tree(f), leaves).select("area_id", "affected_share"))


@query("hie8_parent_mismatch", """
select a.area_id, g.parent_id as supplied, a.audited from (select section_id as area_id, max(barrio) as audited from fx_membership where vintage = 'old' group by 1) a
left join fx_geographies g on g.area_id = a.area_id where g.parent_id is distinct from a.audited""")
def _(f):
    audited = f.membership.filter("vintage = 'old'").groupBy(F.col("section_id").alias("area_id")).agg(F.max("barrio").alias("parent_id"))
    return hierarchy.parent_mismatch(f.geographies, audited)


# Contracts on text input

@query("src2_population_contract", """
with t as (select try_cast(age as int) as a, sex, nationality, try_cast(population as bigint) as p from fx_raw_population)
select 'age' as rule, count(*) filter (a is null or a not between 0 and 130) as violations from t
union all select 'sex', count(*) filter (sex not in ('male', 'female')) from t
union all select 'nationality', count(*) filter (nationality not in ('ESP', 'EXT')) from t
union all select 'population', count(*) filter (p is null or p < 0) from t""")
def _(f):
    return violations(f.raw_population, tables.population_rules())


@query("src3_mortality_contract", """
with t as (select year, try_cast(age as int) as a, sex, try_cast(qx as double) as q from fx_raw_mortality)
select 'year' as rule, count(*) filter (try_cast(year as int) is null) as violations from t
union all select 'age', count(*) filter (a is null or a not between 0 and 130) from t
union all select 'sex', count(*) filter (sex not in ('male', 'female')) from t
union all select 'qx', count(*) filter (q is null or q not between 0 and 1) from t""")
def _(f):
    return violations(f.raw_mortality, tables.mortality_rules())


@query("src4_geography_contract", """
select 'area_id' as problem, count(*) filter (trim(area_id) = '') as areas from fx_raw_geographies
union all select 'level', count(*) filter (level not in ('section', 'barrio', 'district', 'city')) from fx_raw_geographies
union all select 'boundary_status', count(*) filter (boundary_status not in ('unchanged', 'exact_harmonisation', 'estimated_harmonisation', 'unreliable')) from fx_raw_geographies
union all select 'repeated id', count(*) from (select area_id from fx_raw_geographies group by 1 having count(*) > 1)
union all select 'unknown parent', count(*) from fx_raw_geographies where parent_id <> '' and parent_id not in (select area_id from fx_raw_geographies)""")
def _(f):
    return tables.geography_problems(f.raw_geographies)


# Life tables

shared("x_lxq", """
select year, age, sex, case when lead(age) over w = age + 1 then 1 - lead(lx) over w / lx end as qx
from fx_lx window w as (partition by year, sex order by age)""")


@query("mor1_lx_to_qx", "select year, age, sex, round(qx, 9) as qx from x_lxq where qx is not null")
def _(f):
    return rounded(mortality.to_qx(f.lx, "lx", "survivors"), 9)


@query("mor1_px_per_thousand", "select year, age, sex, round(1 - (1000 - 1000 * qx) / 1000, 9) as qx from fx_rates")
def _(f):
    px = f.rates.select("year", "age", "sex", (1000.0 - 1000.0 * F.col("qx")).alias("px"))
    return rounded(mortality.to_qx(px, "px", "per_1000"), 9)


@query("mor2_national_extract", "select year, age, sex, round(micro / 1e9, 9) as qx from fx_micro where measure = 'Riesgo de muerte' and year between 2015 and 2024")
def _(f):
    return rounded(mortality.national_extract(f.stat_rows, 2015, 2025), 9)


@query("mor3_national_schedules", """
with q as (select year, age, sex, micro / 1e9 as qx from fx_micro where measure = 'Riesgo de muerte'),
l as (select year, age, sex, micro / 1e6 as lx from fx_micro where measure = 'Supervivientes'),
p as (select *, lead(lx) over (partition by year, sex order by age) as after from l)
select q.year, q.age, q.sex, round(qx, 9) as qx, round(lx, 9) as lx, round(1 - after / lx, 9) as lx_qx from q join p on p.year = q.year and p.age = q.age and p.sex = q.sex""")
def _(f):
    return rounded(mortality.national_schedules(f.stat_rows, 2014, 2025), 9)


shared("x_calibrated", """
select r.year, r.age, r.sex, 1 - exp(-(-ln(1 - r.qx)) * (-ln(1 - nqx)) / sum(-ln(1 - r.qx)) over (partition by r.year, r.sex, n.age_lo)) as qx
from fx_nqx n join fx_rates r on r.year = n.year and r.sex = n.sex and r.age between n.age_lo and n.age_hi""")


@query("mor4_calibrated_bands", "select year, age, sex, round(qx, 9) as qx from x_calibrated")
def _(f):
    return rounded(mortality.calibrate_bands(f.rates, f.nqx), 9)


@query("mor5_regional_schedule", """
with n as (select year, sex, age_lo, age_hi, floor(nqx * 1e9) / 1e9 as nqx from fx_nqx where year between 2014 and 2024)
select r.year, r.age, r.sex, round(1 - exp(-(-ln(1 - r.qx)) * (-ln(1 - nqx)) / sum(-ln(1 - r.qx)) over (partition by r.year, r.sex, n.age_lo)), 8) as qx
from n join fx_rates r on r.year = n.year and r.sex = n.sex and r.age between n.age_lo and n.age_hi""")
def _(f):
    regional = mortality.regional_bands(f.region_rows, "13 Region", 2014, 2025, region_column="region")
    return rounded(mortality.calibrate_bands(f.rates, regional), 8)


@query("mor6_survival", """
select cast(age - (year - 2015) as int) as age, sex, round(case when count(*) = 10 then product(1 - qx) end, 9) as survival
from fx_rates where year between 2015 and 2024 and age >= year - 2015 group by 1, 2""")
def _(f):
    return rounded(mortality.survival(f.rates, 2015, 2025), 9)


shared("x_half", """
select year, age, sex, 0.5 * (qx + case when lead(age) over w = age + 1 then lead(qx) over w end) as qx
from fx_mortality window w as (partition by year, sex order by age)""")
shared("x_half_survival", """
select cast(age - (year - 2015) as int) as age, sex, case when count(*) = 10 then product(1 - qx) end as survival
from x_half where qx is not null and year between 2015 and 2024 and age >= year - 2015 group by 1, 2""")


@query("mor6_half_age_survival", """
with half as (select year, age, sex, case when lead(age) over w = age + 1 then 0.5 * (qx + lead(qx) over w) end as qx from fx_rates window w as (partition by year, sex order by age))
select cast(age - (year - 2015) as int) as age, sex, round(case when count(*) = 10 then product(1 - qx) end, 9) as survival
from half where qx is not null and year between 2015 and 2024 and age >= year - 2015 group by 1, 2""")
def _(f):
    return rounded(mortality.survival(f.rates.select("year", "age", "sex", "qx"), 2015, 2025, half_age=True), 9)


shared("x_lx_steps", """
select cast(age - (year - 2015) as int) as age, sex, product(after / lx) as factor, sum(0.5e-9 + 1e-6 / lx) as slack
from (select *, case when lead(age) over (partition by year, sex order by age) = age + 1 then lead(lx) over (partition by year, sex order by age) end as after from fx_lx)
where after is not null and year between 2015 and 2024 and age >= year - 2015 group by 1, 2 having count(*) = 10""")


@query("mor7_propagated_survivors", """
select geography_id, cast(p.age + 10 as int) as age, p.sex, nationality, round(population * factor, 6) as expected_lx, round(population * slack, 6) as bound
from fx_population_start p left join x_lx_steps s on s.age = p.age and s.sex = p.sex where p.age + 10 < 100""")
def _(f):
    return rounded(mortality.propagate_lx(f.population_start, f.lx, 2015, 2025, 100))


@query("mor8_survival_comparison", """
with a as (select cast(age - (year - 2015) as int) as age, sex, case when count(*) = 10 then product(1 - qx) end as s from fx_rates
           where year between 2015 and 2024 and age >= year - 2015 group by 1, 2),
b as (select age, sex, factor as s from x_lx_steps)
select coalesce(a.age, b.age) as age, coalesce(a.sex, b.sex) as sex, round(a.s, 9) as survival_a, round(b.s, 9) as survival_b, coalesce(abs(a.s - b.s) <= 0.3, false) as agrees
from a full join b on a.age = b.age and a.sex = b.sex""")
def _(f):
    left = mortality.survival(f.rates, 2015, 2025)
    right = mortality.survival(mortality.lx_to_qx(f.lx), 2015, 2025).filter("survival is not null")
    return rounded(mortality.compare_survival(left, right, tolerance=0.3), 9)


# Cohort core

def _broken_cells(df: DataFrame, first: int) -> DataFrame:
    """One fault of each kind, each at an age of its own from ``first`` on."""
    age = F.col("age")
    return df.select(
        "geography_id",
        F.when(age == first + 2, 200).otherwise(age).alias("age"),
        F.when(age == first, "other").otherwise(F.col("sex")).alias("sex"),
        F.when(age == first + 1, "ZZZ").otherwise(F.col("nationality")).alias("nationality"),
        F.when(age == first + 3, -1).otherwise(F.col("population")).alias("population"),
    )


@query("coh1_cell_guard", """
select s.side, r.rule, coalesce(n, 0) as violations
from (values ('start', 20), ('end', 40)) s(side, first) cross join (values ('sex', 0), ('nationality', 1), ('age', 2), ('population', 3)) r(rule, nth)
left join (select 'start' as side, age, count(*) as n from fx_population_start group by 1, 2 union all select 'end', age, count(*) from fx_population_end group by 1, 2) c
  on c.side = s.side and c.age = s.first + r.nth""")
def _(f):
    return qa.checked_inputs(_broken_cells(f.population_start, 20), _broken_cells(f.population_end, 40))


@query("coh2_age_shift", "select geography_id, cast(age + 10 as int) as age, sex, nationality, population from fx_population_start")
def _(f):
    return model.shift(f.population_start, P.interval)


@query("coh3_survivors", f"select geography_id, age, sex, nationality, {R('baseline expected')} from x_aged")
def _(f):
    return rounded(model.survivors(f.population_start, mortality.survival(f.mortality, 2015, 2025), P))


@query("coh4_combined_cells", f"""
select geography_id, age, sex, nationality, {R('baseline expected actual')} from (
  select geography_id, age, sex, nationality, sum(baseline)::double as baseline, sum(expected)::double as expected, sum(actual)::double as actual from x_leafcells group by all)""")
def _(f):
    aged = model.survivors(f.population_start, mortality.survival(f.mortality, 2015, 2025), P)
    return rounded(model.combine(aged, f.population_end).groupBy(*model.CELL).agg(*[F.sum(m).alias(m) for m in model.MEASURES]))


@query("coh5_cohort_detail", f"select area_id, age, sex, nationality, cohort_eligible, exclusion_reason, {R('baseline expected actual residual')} from x_detail")
def _(f):
    return rounded(detail(f))


@query("coh6_profile", f"select area_id, age, nationality, cohort_eligible, exclusion_reason, rate_suppressed, {R('baseline expected actual residual')} from x_profile")
def _(f):
    return rounded(profile(f))


@query("coh7_composition", f"select area_id, year, age, nationality, {R('population')} from x_comp")
def _(f):
    return rounded(composition(f))


@query("coh8_area_totals", f"select area_id, {R('baseline expected actual observed_under_interval observed_terminal')} from x_totals")
def _(f):
    return rounded(model.area_totals(detail(f), P))


@query("coh9_rates", f"""
select area_id, rate_suppressed, {R('baseline expected actual observed_under_interval observed_terminal residual observed_change modelled_deaths residual_per_1000 annualised_residual_per_1000')}
from (select *, {RATES.format(m=4000)} from x_totals)""")
def _(f):
    return rounded(model.with_rates(model.area_totals(detail(f), P), SPARSE))


@query("coh10_area_index", f"select {INDEX_COLUMNS} from x_index order by level, name")
def _(f):
    return rounded(index(f)).orderBy("level", "name")


shared("x_windows", "select * from (values ('2015-2018', 2015, 2018, 100), ('2016-2020', 2016, 2020, 100), ('2015-2021', 2015, 2021, 95)) w(window_id, y0, y1, terminal)")
shared("x_fixed_windows", "select '2015-' || (2015 + i) as window_id, 2015 as y0, 2015 + i as y1, 90 + i as terminal from range(1, 7) t(i)")
WINDOW_TOTALS = """
with s as (select window_id, y1 - y0 as n, m.age - (m.year - y0) as age, sex, product(1 - qx) as survival, count(*) as c
           from {w} join fx_mortality m on m.year >= y0 and m.year < y1 and m.age >= m.year - y0 group by all),
cells as (
  select w.window_id, y1 - y0 as interval, terminal, geography_id, p.age + y1 - y0 as age, p.population as baseline,
         case when p.age + y1 - y0 < terminal then p.population * s.survival else 0 end as expected, 0 as actual
  from {w} w join fx_snapshots p on p.year = w.y0 left join s on s.window_id = w.window_id and s.age = p.age and s.sex = p.sex and s.c = s.n
  union all select w.window_id, y1 - y0, terminal, geography_id, p.age, 0, 0, p.population from {w} w join fx_snapshots p on p.year = w.y1),
t as (select window_id, interval, terminal as terminal_age, ancestor_id as area_id,
       coalesce(sum(baseline) filter (age >= interval and age < terminal), 0)::double as baseline, coalesce(sum(expected) filter (age >= interval and age < terminal), 0)::double as expected,
       coalesce(sum(actual) filter (age >= interval and age < terminal), 0)::double as actual, coalesce(sum(actual) filter (age < interval), 0)::double as observed_under_interval,
       coalesce(sum(actual) filter (age >= terminal), 0)::double as observed_terminal
from cells join x_closure on geography_id = area_id group by all)
select window_id, interval::int as interval, terminal_age::int as terminal_age, area_id,
       round(baseline, 6) as baseline, round(expected, 6) as expected, round(actual, 6) as actual, round(observed_under_interval, 6) as observed_under_interval,
       round(observed_terminal, 6) as observed_terminal, round(actual - expected, 6) as residual from t"""


@query("coh12_windows", WINDOW_TOTALS.format(w="x_windows"))
def _(f):
    return rounded(model.window_totals(model.window_detail(f.snapshots, f.mortality, tree(f), WINDOWS)))


@query("coh13_intermediate_years", WINDOW_TOTALS.format(w="x_fixed_windows"))
def _(f):
    windows = model.intermediate_windows(Params(start_year=2015, end_year=2021))
    return rounded(model.window_totals(model.window_detail(f.snapshots, f.mortality, tree(f), windows)))


@query("coh14_annual_fallback", """
with bad as (select distinct c.year from fx_annual_controls c left join fx_annual_cells f on f.year = c.year and f.age = c.age and f.sex = c.sex and f.nationality = c.nationality
             where f.population is distinct from c.population)
select year, age::int as age, sex, nationality, population::bigint as population, 'file' as source from fx_annual_cells where year not in (select year from bad)
union all select year, age::int, sex, nationality, population::bigint, 'controls' from fx_annual_controls where year in (select year from bad)
union all select t.year, 100, t.sex, t.nationality, (t.population - s.p)::bigint, 'controls'
from fx_annual_totals t join (select year, sex, nationality, sum(population) as p from fx_annual_controls group by all) s
  on s.year = t.year and s.sex = t.sex and s.nationality = t.nationality where t.year in (select year from bad)""")
def _(f):
    keys = ["year", "age", "sex", "nationality"]
    known = f.annual_cells.filter("age < 100").withColumnRenamed("population", "known")
    flags = controls.match_summary(controls.match(known, f.annual_controls, keys), ["year"])
    return controls.with_fallback(f.annual_cells, flags, f.annual_controls, f.annual_totals)


@query("coh15_city_summary", f"select {INDEX_COLUMNS} from x_index where level = 'city'")
def _(f):
    return rounded(model.city_summary(index(f)))


# Bands

shared("x_presets", """
select * from (values ('cohorts', 10, 99), ('10-17', 10, 17), ('18-24', 18, 24), ('25-34', 25, 34), ('35-44', 35, 44), ('45-54', 45, 54), ('55-64', 55, 64),
('65-74', 65, 74), ('75-130', 75, 99), ('born', 0, 9)) p(preset, low, high)""")
BAND = """sum(actual) as observed, sum(expected) filter (cohort_eligible) as exp, sum(baseline) filter (cohort_eligible) as base,
count(*) as n, count(*) filter (cohort_eligible) as e"""
BAND_OUT = """round(coalesce(observed, 0), 6) as actual, round(case when ok then coalesce(exp, 0) end, 6) as expected,
round(case when ok then coalesce(observed, 0) - coalesce(exp, 0) end, 6) as residual, round(case when ok then base end, 6) as baseline,
round(case when ok and coalesce(exp, 0) >= {m} then 1000 * (coalesce(observed, 0) - coalesce(exp, 0)) / nullif(coalesce(exp, 0), 0) end, 6) as residual_per_1000,
round(coalesce(exp, 0), 6) as denominator, not (ok and coalesce(exp, 0) >= {m}) as rate_suppressed, ok as cohort_eligible"""
shared("x_preset_sums", f"select area_id, preset, {BAND} from x_profile join x_presets on age between low and high group by all")
shared("x_indicators", f"""
select area_id, preset, level, name, boundary_status, round(affected_share, 6) as affected_share, {BAND_OUT.format(m=20)}
from (select i.area_id, p.preset, i.level, i.name, i.boundary_status, i.affected_share, s.observed, s.exp, s.base, coalesce(s.e > 0 and s.e = s.n, false) as ok
      from x_index i cross join x_presets p left join x_preset_sums s on s.area_id = i.area_id and s.preset = p.preset)""")


def indicators(f: Fixtures) -> DataFrame:
    _, prof, idx = results(f)
    return bands.indicators(prof, idx, P)


@query("bnd1_band_summary", f"select area_id, preset, {BAND_OUT.format(m=20)} from (select *, e > 0 and e = n as ok from x_preset_sums)")
def _(f):
    return rounded(bands.summarise(profile(f), bands.validated(bands.presets(f.spark, P)), P))


@query("bnd3_indicators", "select * from x_indicators")
def _(f):
    return rounded(indicators(f))


@query("bnd4_five_year", f"""
select area_id, age_min, age_max, nationality, {BAND_OUT.format(m=20)} from (
  select i.area_id, b::int as age_min, least(b + 4, 99)::int as age_max, n.nationality, s.observed, s.exp, s.base, coalesce(s.e > 0 and s.e = s.n, false) as ok
  from x_index i cross join range(0, 100, 5) r(b) cross join (values ('ESP'), ('EXT')) n(nationality)
  left join (select area_id, (age // 5) * 5 as band, nationality, {BAND} from x_profile where age <= 99 group by all) s
    on s.area_id = i.area_id and s.band = r.b and s.nationality = n.nationality)""")
def _(f):
    _, prof, idx = results(f)
    return rounded(bands.five_year(prof, idx, P))


@query("bnd5_rank", """
with k as (select *, residual_per_1000 is not null and boundary_status in ('unchanged', 'exact_harmonisation') as ranked from x_indicators)
select area_id, preset, level, residual_per_1000, case when ranked then row_number() over (partition by level, preset, ranked order by residual_per_1000 desc, name, area_id) end as rank from k""")
def _(f):
    return bands.rank(rounded(indicators(f))).select("area_id", "preset", "level", "residual_per_1000", "rank")


@query("bnd6_custom_range", f"""
select area_id, actual, expected, residual, residual_per_1000 from (select area_id, {BAND_OUT.format(m=20)} from (
  select i.area_id, s.observed, s.exp, s.base, coalesce(s.e > 0 and s.e = s.n, false) as ok from x_index i
  left join (select area_id, {BAND} from x_profile where age between 23 and 61 group by all) s on s.area_id = i.area_id))""")
def _(f):
    _, prof, idx = results(f)
    return rounded(bands.custom_range(prof, idx, 23, 61, P))


@query("bnd7_variable_bands", f"""
select area_id, age_min, age_max, round(coalesce(esp, 0), 6) as residual_esp, round(coalesce(ext, 0), 6) as residual_ext, actual, expected, residual, residual_per_1000 from (
  select *, {BAND_OUT.format(m=0)} from (select *, coalesce(e > 0 and e = n, false) as ok from (
    select area_id, (((age - 4) // 7) * 7 + 4)::int as age_min, least(((age - 4) // 7) * 7 + 10, 90)::int as age_max, {BAND},
           sum(residual) filter (nationality = 'ESP') as esp, sum(residual) filter (nationality = 'EXT') as ext
    from x_profile where age between 4 and 90 group by 1, 2, 3)))""")
def _(f):
    return rounded(bands.variable_bands(profile(f), 4, 90, 7))


@query("bnd8_composition_shares", """
select area_id, year, age_min::int as age_min, round(esp, 6) as esp, round(ext, 6) as ext, round(esp + ext, 6) as total, round(100 * esp / (esp + ext), 6) as esp_share, round(100 * ext / (esp + ext), 6) as ext_share
from (select area_id, year, (age // 5) * 5 as age_min, coalesce(sum(population) filter (nationality = 'ESP'), 0) as esp, coalesce(sum(population) filter (nationality = 'EXT'), 0) as ext
      from x_comp where age between 0 and 104 group by all) where esp + ext <> 0""")
def _(f):
    return rounded(bands.shares(composition(f), 0, 104))


@query("bnd9_robust_extent", """
with v as (select level, preset, abs(residual_per_1000) as v, row_number() over (partition by level, preset order by abs(residual_per_1000)) as rn,
                  count(*) over (partition by level, preset) as n from x_indicators where residual_per_1000 is not null)
select level, preset, case when v = 0 then 1 else v end as extent from v where rn = floor((n - 1) * 0.95) + 1""")
def _(f):
    return bands.robust_extent(rounded(indicators(f)), "residual_per_1000", ["level", "preset"])


@query("bnd10_listing", """
select area_id, name, boundary_status, actual, case when boundary_status <> 'unreliable' then expected end as expected,
       case when boundary_status <> 'unreliable' then residual end as residual, case when boundary_status <> 'unreliable' then residual_per_1000 end as residual_per_1000
from x_indicators where level = 'section' and preset = '25-34' order by residual_per_1000 desc nulls last, name""")
def _(f):
    return bands.listing(rounded(indicators(f)), "section", "25-34")


@query("bnd11_level_lookup", "select area_id, preset, actual, residual_per_1000 from x_indicators where level = 'barrio'")
def _(f):
    return rounded(indicators(f)).filter("level = 'barrio'").select("area_id", "preset", "actual", "residual_per_1000")


# Scenarios

shared("x_scn", """
select 'half_age' as scenario, age, sex, survival from x_half_survival
union all select 'lower_mortality', cast(age - (year - 2015) as int), sex, case when count(*) = 10 then product(1 - 0.9 * qx) end
from fx_mortality where year between 2015 and 2024 and age >= year - 2015 group by 2, 3
union all select 'observed_rates', cast(age - (year - 2015) as int), sex, case when count(*) = 10 then product(1 - qx) end
from fx_rates where year between 2015 and 2024 and age >= year - 2015 group by 2, 3""")
shared("x_variant_totals", """
select scenario, area_id, baseline, expected, actual, actual - expected as residual from (
  select scenario, ancestor_id as area_id, coalesce(sum(baseline) filter (age between 10 and 99), 0)::double as baseline,
         coalesce(sum(expected) filter (age between 10 and 99), 0)::double as expected, coalesce(sum(actual) filter (age between 10 and 99), 0)::double as actual
  from (select s.scenario, geography_id, p.age + 10 as age, population as baseline, case when p.age + 10 < 100 then population * s.survival else 0 end as expected, 0 as actual
        from fx_population_start p join x_scn s on s.age = p.age and s.sex = p.sex
        union all select s.scenario, geography_id, age, 0, 0, population from fx_population_end cross join (select distinct scenario from x_scn) s)
  join x_closure on geography_id = area_id group by all)""")


def schedules(f: Fixtures) -> DataFrame:
    """Survival by schedule; the base schedule is one of them."""
    m = f.mortality
    lowered = m.withColumn("qx", 0.9 * F.col("qx")).withColumn("scenario", F.lit("lower_mortality"))
    observed = f.rates.select("year", "age", "sex", "qx").withColumn("scenario", F.lit("observed_rates"))
    chains = mortality.survival(lowered.unionByName(observed), 2015, 2025, by=["scenario"])
    half = mortality.survival(m, 2015, 2025, half_age=True).withColumn("scenario", F.lit("half_age"))
    base = mortality.survival(m, 2015, 2025).withColumn("scenario", F.lit("base"))
    return chains.unionByName(half).unionByName(base)


def variant_totals(f: Fixtures) -> DataFrame:
    """Three variants in one job: scenario is one more key of schedule, stock and result."""
    chains = schedules(f).filter("scenario <> 'base'")
    return scenarios.variant_totals(f.population_start, f.population_end, chains, tree(f), P, ["half_age", "lower_mortality", "observed_rates"]).drop("terminal_age")


COMPARED = f"""
select v.scenario, v.area_id, {{cols}} from (
  select v.scenario, v.area_id, v.expected, v.residual, v.expected - t.expected as expected_difference, v.expected / nullif(t.expected, 0) - 1 as relative_difference
  from x_variant_totals v join x_totals t on t.area_id = v.area_id) v"""
CMP = R("expected residual expected_difference relative_difference")


@query("scn1_comparison", COMPARED.format(cols=CMP))
def _(f):
    return rounded(scenarios.compare(model.area_totals(detail(f), P), variant_totals(f)))


@query("scn2_half_age_detail", f"""
select area_id, {R('baseline expected actual')} from x_variant_totals where scenario = 'half_age'""")
def _(f):
    return rounded(model.area_totals(detail(f, half_age=True), P).select("area_id", *model.MEASURES))


@query("scn3_variants", f"select scenario, area_id, {R('baseline expected actual residual')} from x_variant_totals")
def _(f):
    return rounded(variant_totals(f))


VARIANTS = [("endpoint_under90", "base", 90), ("endpoint_under95", "base", 95), ("endpoint_under100", "base", 100),
            ("half_age_under100", "half_age", 100), ("observed_under100", "observed_rates", 100), ("lower_under95", "lower_mortality", 95)]


@query("scn3_terminal_ages", f"""
with v(scenario, schedule, terminal_age) as (values {', '.join(map(str, VARIANTS))}),
c as (select * from x_scn union all select 'base', age, sex, survival from x_survival)
select scenario, terminal_age, area_id, {R('baseline expected actual residual')} from (
  select *, actual - expected as residual from (
    select scenario, terminal_age, ancestor_id as area_id, coalesce(sum(baseline) filter (age >= 10 and age < terminal_age), 0)::double as baseline,
           coalesce(sum(expected) filter (age >= 10 and age < terminal_age), 0)::double as expected, coalesce(sum(actual) filter (age >= 10 and age < terminal_age), 0)::double as actual
    from (select v.scenario, terminal_age, geography_id, p.age + 10 as age, population as baseline, case when p.age + 10 < terminal_age then population * c.survival else 0 end as expected, 0 as actual
          from fx_population_start p cross join v left join c on c.scenario = v.schedule and c.age = p.age and c.sex = p.sex
          union all select v.scenario, terminal_age, geography_id, age, 0, 0, population from fx_population_end cross join v)
    join x_closure on geography_id = area_id group by all))""")
def _(f):
    """Six variants of four schedules and three terminal ages, from one pass over both population tables."""
    return rounded(scenarios.variant_totals(f.population_start, f.population_end, schedules(f), tree(f), P, [scenarios.Variant(*v) for v in VARIANTS]))


@query("scn4_material", COMPARED.format(cols=CMP) + " where scenario = 'half_age' and abs(relative_difference) > 0.005")
def _(f):
    return rounded(scenarios.material(scenarios.compare(model.area_totals(detail(f), P), variant_totals(f))))


shared("x_women", "select geography_id as area_id, age, sum(population)::double as women from fx_population_start where sex = 'female' and age <= 49 group by all")
shared("x_chain", """
select cast(age - (year - 2015) as int) as a0, year, age, sex, qx,
       coalesce(product(1 - qx) over (partition by age - (year - 2015), sex order by year rows between unbounded preceding and 1 preceding), 1) as reach
from fx_mortality where year between 2015 and 2024 and age >= year - 2015""")
shared("x_births", """
select area_id, c.year, sum(women * c.reach * (1 + (1 - c.qx)) / 2 * asfr_per_1000 / 1000) as births
from x_women w join x_chain c on c.a0 = w.age and c.sex = 'female' join fx_fertility f on f.year = c.year and f.age = c.age group by all""")


@query("scn5_births", f"select area_id, year, {R('births')} from x_births")
def _(f):
    return rounded(scenarios.births(f.population_start, f.mortality, f.fertility, P))


@query("scn5_children", """
with infant as (select year, sex, sqrt(1 - qx) as s from fx_mortality where age = 0 and year between 2015 and 2024),
later as (select cast(year - age as int) as year, sex, product(1 - qx) as s from fx_mortality where age >= 1 and year < 2025 and year - age >= 2015 group by 1, 2)
select area_id, cast(2024 - b.year as int) as age, i.sex, round(births * (case when i.sex = 'male' then 0.512 else 1 - 0.512 end) * i.s * coalesce(l.s, 1), 6) as expected
from x_births b join infant i on i.year = b.year left join later l on l.year = b.year and l.sex = i.sex""")
def _(f):
    born = scenarios.births(f.population_start, f.mortality, f.fertility, P)
    return rounded(scenarios.children(born, f.mortality, P))


@query("scn6_nationality", """
with m as (select unnest([0.5, 1.0, 1.5])::double as multiplier),
c as (select multiplier, c.a0, c.sex, c.year, c.age, c.qx, least(h.hazard * multiplier, 1) as take
      from x_chain c join fx_hazards h on h.year = c.year and h.age = c.age and h.sex = c.sex cross join m),
k as (select *, coalesce(product((1 - take) * (1 - qx)) over (partition by multiplier, a0, sex order by year rows between unbounded preceding and 1 preceding), 1) as kept,
             product(1 - qx) over (partition by multiplier, a0, sex order by year rows between current row and unbounded following) as alive,
             count(*) over (partition by multiplier, a0, sex) as n from c),
t as (select multiplier, a0, sex, sum(kept * take * alive) as factor from k where n = 10 group by all),
s as (select geography_id as area_id, age, sex, sum(population) as stock from fx_population_start where nationality = 'EXT' group by all)
select multiplier, area_id, cast(age + 10 as int) as age, s.sex, round(-stock * factor, 6) as esp, round(stock * factor, 6) as ext, 0::double as total
from s join t on t.a0 = s.age and t.sex = s.sex""")
def _(f):
    return rounded(scenarios.nationality(f.population_start, f.mortality, f.hazards, P))


RAW_HAZARDS = "select cast(year as string) as year, cast(age as string) as age, sex, case when age % 50 = 3 then '1.2' when age % 50 = 4 then '?' else cast(events % 2 as string) end as hazard from fx_observed"


@query("scn7_scenario_inputs", f"""
with t as (select *, try_cast(hazard as double) as h from ({RAW_HAZARDS}))
select 'year' as rule, count(*) filter (try_cast(year as int) is null) as violations from t union all select 'age', count(*) filter (age::int not between 0 and 130) from t
union all select 'sex', count(*) filter (sex not in ('male', 'female')) from t union all select 'hazard', count(*) filter (h is null or h not between 0 and 1) from t""")
def _(f):
    return violations(f.sql(RAW_HAZARDS), tables.hazard_rules())


@query("nrm14_exact_tier", """
select * from fx_geographies where boundary_status in ('unchanged', 'exact_harmonisation')""")
def _(f):
    return scenarios.tier(f.geographies)


@query("nrm15_eligible_start", "select * from fx_population_start where age + 10 < 100")
def _(f):
    return scenarios.eligible_start(f.population_start, P)


# Profiles that need no raw file

@query("prf3_discontinuities", """
select lag(y) over (order by y) as from_date, y as to_date, round(total / lag(total) over (order by y)::double - 1, 6) as relative_change, false as schema_changed,
       section_count - lag(section_count) over (order by y) as section_count_change, coalesce(abs(total / lag(total) over (order by y)::double - 1) > 0.05, true) as flagged
from fx_annual qualify lag(y) over (order by y) is not null""")
def _(f):
    return rounded(profiling.discontinuities(f.annual.withColumnRenamed("y", "reference_date")))


shared("x_stat_values", """
select year, age, sex, case when age % 33 = 32 and year = 2019 then null else micro / 1e6 end as value
from fx_micro where measure = 'Riesgo de muerte' and not (age = 77 and year = 2020)""")


def stat_values(f: Fixtures) -> DataFrame:
    hole = (F.col("age") == 77) & (F.col("year") == 2020)
    value = F.when((F.col("age") % 33 == 32) & (F.col("year") == 2019), None).otherwise(F.col("micro") / 1e6)
    return f.micro.filter("measure = 'Riesgo de muerte'").filter(~hole).select("year", "age", "sex", value.alias("value"))


@query("prf4_mortality_coverage", """
select 2000::bigint as required_cells, count(*) filter (value is not null) as present_cells, count(*) filter (value is null) as missing_values,
       coalesce(bool_and(value between 0 and 1000), true) as values_in_range, 2000 - count(*) filter (value is not null) as missing_cells,
       2000 - count(*) filter (value is not null) = 0 and count(*) filter (value is null) = 0 as covered
from x_stat_values where year between 2015 and 2024""")
def _(f):
    return mortality.coverage(stat_values(f), 2015, 2025)


@query("prf4_missing_cells", """
select g.year, g.age, g.sex from fx_grid g left join (select * from x_stat_values where value is not null) v on v.year = g.year and v.age = g.age and v.sex = g.sex
where g.year between 2015 and 2024 and g.age <= 99 and v.value is null""")
def _(f):
    return mortality.missing_cells(stat_values(f), 2015, 2025)


# Checks

def _index_with_fault(f):
    """The detail, and an index whose first section has a residual that its cells do not have."""
    d, _, idx = results(f)
    first = idx.filter("level = 'section'").agg(F.min("area_id").alias("area_id")).withColumn("_off", F.lit(1000.0))
    return d, idx.join(first, "area_id", "left").withColumn("residual", F.col("residual") + F.coalesce("_off", F.lit(0.0))).drop("_off")


shared("x_invariants", """
with off as (select area_id, parent_id from fx_geographies where area_id = (select min(area_id) from fx_geographies where level = 'section')),
kids as (select parent_id as area_id from fx_geographies where parent_id is not null group by 1)
select area_id, check_name, not (check_name <> 'survival-bounds' and area_id in (select area_id from off)) as passed
from fx_geographies cross join (values ('sex-nationality-sums'), ('survival-bounds'), ('stock-accounting')) c(check_name)
union all select area_id, 'hierarchy', area_id not in (select parent_id from off) from kids""")


@query("qa1_invariants", "select * from x_invariants")
def _(f):
    return qa.invariants(*_index_with_fault(f))


@query("qa1_summary", "select bool_and(passed) as passed, count(*) as checks, count(*) filter (not passed) as failed from x_invariants")
def _(f):
    return qa.summary(qa.invariants(*_index_with_fault(f)))


@query("qa6_independent", """
with q as (select year, age, sex, round(1 - after / lx, 9) as qx from (
  select *, case when lead(age) over (partition by year, sex order by age) = age + 1 then lead(lx) over (partition by year, sex order by age) end as after from fx_lx) where after is not null),
s as (select cast(age - (year - 2015) as int) as age, sex, case when count(*) = 10 then product(1 - qx) end as survival from q where year between 2015 and 2024 and age >= year - 2015 group by 1, 2),
c as (select p.population * survival as e, p.population * factor as l, p.population * slack as b from fx_population_start p join s on s.age = p.age and s.sex = p.sex
      join x_lx_steps x on x.age = p.age and x.sex = p.sex where p.age + 10 < 100)
select count(*) as cells, bool_and(abs(e - l) <= b + 1e-7) as passed, round(max(abs(e - l)), 5) as maximum_difference, round(sum(e), 5) as total_expected_qx,
       round(sum(l), 5) as total_expected_lx, round(sum(b), 5) as total_bound from c""")
def _(f):
    qx = mortality.lx_to_qx(f.lx).withColumn("qx", F.round("qx", 9))
    chains = mortality.survival(qx, 2015, 2025)
    aged = model.survivors(f.population_start, chains, P).filter(model.eligible(F.col("age"), P))
    leaf = aged.select(F.col("geography_id").alias("area_id"), "age", "sex", "nationality", "expected", F.lit(True).alias("cohort_eligible"))
    propagated = mortality.propagate_lx(f.population_start, f.lx, 2015, 2025, 100)
    return rounded(qa.independent_summary(qa.independent(leaf, propagated)), 5)
