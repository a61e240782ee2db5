"""Inputs for the registered queries, derived from the whole star-schema tables.

Each view is SQL text that Spark and DuckDB both accept, so the oracle of a query reads exactly
what the query reads. Arithmetic is limited to ``+ - * /`` and integer sums, which both engines
compute bit for bit alike. The remainders in the text shape the data (which sections split,
merge or move, which codes are blank); they never drop rows to make a check cheaper.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The (year, age, sex) domain is the one view whose text differs between the engines.
GRID_SPARK = """
select y as year, a as age, s as sex, cast(a as double) / 1e2 as x, cast(y - 2014 as double) as k
from (select explode(sequence(2014, 2024)) as y)
lateral view explode(sequence(0, 130)) as a
lateral view explode(array('male', 'female')) as s
"""
GRID_DUCKDB = """
select cast(y as int) as year, cast(a as int) as age, s as sex, cast(a as double) / 1e2 as x, cast(y - 2014 as double) as k
from range(2014, 2025) t(y), range(0, 131) u(a), (values ('male'), ('female')) v(s)
"""

_CELL = """
select 'S' || cast(l_suppkey as string) as geography_id, cast(l_partkey % 111 as int) as age,
       case when l_linestatus = 'F' then 'female' else 'male' end as sex,
       case when l_returnflag = 'R' then 'EXT' else 'ESP' end as nationality,
       cast(sum(l_quantity) as bigint) as population
from lineitem where l_shipdate {when}
group by l_suppkey, l_partkey % 111, l_linestatus, case when l_returnflag = 'R' then 'EXT' else 'ESP' end
"""

# Boxes open to the five vertices of a closed ring; generators differ in spelling only.
CORNERS = "CORNERS"
CORNERS_SPARK = "lateral view explode(array(0, 1, 2, 3, 4)) corners as corner"
CORNERS_DUCKDB = "cross join (values (0), (1), (2), (3), (4)) corners(corner)"

VIEWS: dict[str, str] = {
    "fx_geographies": """
select 'S' || cast(s_suppkey as string) as area_id, 'Section ' || cast(s_suppkey as string) as name, 'section' as level,
       'N' || cast(s_nationkey as string) as parent_id,
       case s_suppkey % 20 when 0 then 'unreliable' when 1 then 'estimated_harmonisation'
            when 2 then 'exact_harmonisation' when 3 then 'exact_harmonisation' else 'unchanged' end as boundary_status
from supplier
union all select 'N' || cast(n_nationkey as string), n_name, 'barrio', 'R' || cast(n_regionkey as string), 'unchanged' from nation
union all select 'R' || cast(r_regionkey as string), r_name, 'district', case when r_regionkey >= 0 then 'ALL' end, 'unchanged' from region
union all select case when r_regionkey >= 0 then 'ALL' end, 'All', 'city', cast(null as string), 'unchanged' from region where r_regionkey = 0
""",
    "fx_population_start": _CELL.format(when="< date '1998-01-01'"),
    "fx_population_end": _CELL.format(when=">= date '1998-01-01'"),
    "fx_grid": GRID_SPARK,
    "fx_mortality": """
select year, age, sex,
       least(5e-4 + x * x * x * x * x * 3e-1 * (case when sex = 'male' then 11e-1 else 9e-1 end), 5e-1) * (1e0 - 5e-3 * k) as qx
from fx_grid
""",
    # Exposure and events of every line item, by year, age and sex.
    "fx_observed": """
select cast(2014 + l_orderkey % 11 as int) as year, cast(l_partkey % 131 as int) as age,
       case when l_linestatus = 'F' then 'female' else 'male' end as sex,
       cast(sum(l_quantity) as bigint) as exposure,
       cast(sum(case when l_returnflag = 'R' then l_quantity else 0e0 end) as bigint) as events
from lineitem group by l_orderkey % 11, l_partkey % 131, l_linestatus
""",
    "fx_rates": """
select g.year, g.age, g.sex,
       coalesce(cast(o.events as double) / cast(o.exposure as double), 5e-1) as load,
       least(5e-4 + x * x * x * x * x * 3e-1 * (5e-1 + coalesce(cast(o.events as double) / cast(o.exposure as double), 5e-1)), 5e-1) as qx
from fx_grid g left join fx_observed o on g.year = o.year and g.age = o.age and g.sex = o.sex
""",
    "fx_lx": """
select g.year, g.age, g.sex,
       1e5 - 7e2 * cast(g.age as double) - 1e1 * g.k - (case when g.sex = 'male' then 5e0 * cast(g.age as double) else 0e0 end)
       - 3e2 * coalesce(cast(o.events as double) / cast(o.exposure as double), 5e-1) as lx
from fx_grid g left join fx_observed o on g.year = o.year and g.age = o.age and g.sex = o.sex
where g.age <= 101
""",
    "fx_fertility": """
select year, age, 1e0 + 3e0 * cast(least(age - 14, 50 - age) as double) as asfr_per_1000
from fx_grid where age between 15 and 49 and sex = 'female'
""",
    "fx_hazards": "select year, age, sex, 5e-3 + 2e-2 / (1e0 + x) as hazard from fx_grid",
    "fx_nqx": """
select year, sex, cast(floor(age / 5) as int) * 5 as age_lo, cast(floor(age / 5) as int) * 5 + 4 as age_hi,
       least(4e0 * max(qx), 8e-1) as nqx
from fx_rates where age < 95 group by year, sex, cast(floor(age / 5) as int)
""",
    # Published-style rows with Spanish numerals: risks per thousand and survivors.
    "fx_micro": """
select year, age, sex, 'Riesgo de muerte' as measure, cast(floor(qx * 1e9 + 5e-1) as bigint) as micro from fx_rates where age <= 99
union all
select year, age, sex, 'Supervivientes', cast(floor(lx * 1e6 + 5e-1) as bigint) from fx_lx where age <= 100
""",
    "fx_stat_rows": """
select case when sex = 'male' then 'Hombres' else 'Mujeres' end as Sexo,
       case when age = 1 then '1 año' when age = 100 then '100 y más años' else cast(age as string) || ' años' end as Edad,
       measure as Funciones, cast(year as string) as Periodo,
       case when micro >= 1000000000 then cast(cast(floor(micro / 1000000000) as bigint) as string) || '.'
                 || lpad(cast(cast(floor(micro / 1000000) as bigint) % 1000 as string), 3, '0')
            else cast(cast(floor(micro / 1000000) as bigint) as string) end
       || ',' || lpad(cast(micro % 1000000 as string), 6, '0') as Total
from fx_micro
""",
    "fx_region_rows": """
select '13 Region' as region, case when sex = 'male' then 'Hombres' else 'Mujeres' end as Sexo,
       'De ' || cast(age_lo as string) || ' a ' || cast(age_hi as string) || ' años' as Edad,
       'Riesgo de muerte' as Funciones, cast(year as string) as Periodo,
       cast(cast(floor(nqx * 1e3) as bigint) as string) || ','
       || lpad(cast(cast(floor(nqx * 1e9) as bigint) % 1000000 as string), 6, '0') as Total
from fx_nqx
""",
    "fx_annual": """
select cast(year(l_shipdate) as int) as y, count(*) as total, count(distinct l_suppkey) as section_count
from lineitem group by year(l_shipdate)
""",
    # Dated snapshots: one per ship year, twenty years on.
    "fx_snapshots": """
select cast(year(l_shipdate) + 20 as int) as year, 'S' || cast(l_suppkey as string) as geography_id, cast(l_partkey % 111 as int) as age,
       case when l_linestatus = 'F' then 'female' else 'male' end as sex,
       case when l_returnflag = 'R' then 'EXT' else 'ESP' end as nationality,
       cast(sum(l_quantity) as bigint) as population
from lineitem group by year(l_shipdate), l_suppkey, l_partkey % 111, l_linestatus, case when l_returnflag = 'R' then 'EXT' else 'ESP' end
""",
    "fx_annual_cells": """
select year, least(age, 100) as age, sex, nationality, cast(sum(population) as bigint) as population
from fx_snapshots group by year, least(age, 100), sex, nationality
""",
    # Annual controls; the 2018 file misses one person at age 33.
    "fx_annual_controls": """
select year, age, sex, nationality, population + (case when year = 2018 and age = 33 then 1 else 0 end) as population
from fx_annual_cells where age < 100
""",
    "fx_annual_totals": """
select year, sex, nationality, cast(sum(population) + (case when year = 2018 then 1 else 0 end) as bigint) as population
from fx_annual_cells group by year, sex, nationality
""",
    # Text input as a file would give it, with broken cells of every kind.
    "fx_raw_population": """
select 'S' || cast(l_suppkey as string) as geography_id,
       case when l_orderkey % 97 = 0 then 'n/a' when l_orderkey % 101 = 0 then '131' else cast(l_partkey % 111 as string) end as age,
       case when l_orderkey % 89 = 0 then 'F' when l_linestatus = 'F' then 'female' else 'male' end as sex,
       case when l_returnflag = 'R' then 'EXT' else 'ESP' end as nationality,
       case when l_orderkey % 83 = 0 then '-' || cast(cast(l_quantity as int) as string) else cast(cast(l_quantity as int) as string) end as population
from lineitem
""",
    "fx_raw_mortality": """
select cast(year as string) as year, cast(age as string) as age, sex,
       case when age % 40 = 7 then '1.5' when age % 40 = 9 then 'x' else '0.25' end as qx
from fx_observed
""",
    "fx_raw_geographies": """
select area_id, name, level, case when level = 'section' and name like '%9' then 'N99' else coalesce(parent_id, '') end as parent_id,
       case when name like '%8' then 'doubtful' else boundary_status end as boundary_status
from fx_geographies
union all select 'S' || cast(s_suppkey as string), 'Twin', 'parish', 'N' || cast(s_nationkey as string), 'unchanged' from supplier where s_acctbal < 0
""",
    "fx_wide_cells": """
select cast(s_nationkey % 21 + 1 as int) as district,
       cast((s_nationkey % 21 + 1) * 100 + 1 + (case when s_suppkey % 17 = 0 and age % 2 = 0 then 8 else s_suppkey % 3 end) as int) as barrio,
       case when s_suppkey % 50 = 7 then cast(null as int) else cast((s_nationkey % 21 + 1) * 1000 + s_suppkey % 999 + 1 as int) end as section,
       case when age >= 100 then '100 o +' else cast(age as string) end as age_label, sex, nationality, population
from fx_population_start join supplier on geography_id = 'S' || cast(s_suppkey as string)
""",
    "fx_wide": """
select district as cod_distrito, barrio as cod_dist_barrio, section as cod_dist_seccion, age_label as cod_edad_int,
       cast(sum(case when sex = 'male' and nationality = 'ESP' then population end) as bigint) as espanoleshombres,
       cast(sum(case when sex = 'female' and nationality = 'ESP' then population end) as bigint) as espanolesmujeres,
       cast(sum(case when sex = 'male' and nationality = 'EXT' then population end) as bigint) as extranjeroshombres,
       cast(sum(case when sex = 'female' and nationality = 'EXT' then population end) as bigint) as extranjerosmujeres
from fx_wide_cells group by district, barrio, section, age_label
""",
    # Strict input: one barrio per section, no blanks, text columns, a total per row and some total rows.
    "fx_wide_strict": """
select cast(cod_distrito as string) as cod_distrito, cast(cod_distrito * 100 + 1 + cod_dist_seccion % 3 as string) as cod_dist_barrio,
       cast(cod_dist_seccion as string) as cod_dist_seccion, cod_edad_int,
       cast(sum(coalesce(espanoleshombres, 0)) as bigint) as espanoleshombres,
       cast(sum(coalesce(espanolesmujeres, 0)) as bigint) as espanolesmujeres,
       cast(sum(coalesce(extranjeroshombres, 0)) as bigint) as extranjeroshombres,
       cast(sum(coalesce(extranjerosmujeres, 0)) as bigint) as extranjerosmujeres,
       cast(sum(coalesce(espanoleshombres, 0) + coalesce(espanolesmujeres, 0) + coalesce(extranjeroshombres, 0) + coalesce(extranjerosmujeres, 0)) as bigint) as total
from fx_wide where cod_dist_seccion is not null
group by cod_distrito, cod_dist_seccion, cod_edad_int
union all
select cast(cod_distrito as string), cast(cod_distrito * 100 + 1 as string), cast(min(cod_dist_seccion) as string), 'TOTAL',
       cast(sum(coalesce(espanoleshombres, 0)) as bigint), cast(sum(coalesce(espanolesmujeres, 0)) as bigint),
       cast(sum(coalesce(extranjeroshombres, 0)) as bigint), cast(sum(coalesce(extranjerosmujeres, 0)) as bigint),
       cast(sum(coalesce(espanoleshombres, 0) + coalesce(espanolesmujeres, 0) + coalesce(extranjeroshombres, 0) + coalesce(extranjerosmujeres, 0)) as bigint)
from fx_wide where cod_dist_seccion is not null group by cod_distrito
""",
    "fx_controls": """
select age, sex, nationality, cast(sum(population) as bigint) as population
from fx_population_start where age < 100 group by age, sex, nationality
""",
    # District controls; two ages are off by one, so that mismatches exist.
    "fx_district_controls": """
select district, cast(age_label as int) as age, sex, nationality,
       cast(sum(population) + (case when district = 3 and (age_label = '40' or age_label = '41') then 1 else 0 end) as bigint) as population
from fx_wide_cells where age_label <> '100 o +' group by district, age_label, sex, nationality
""",
    "fx_published": """
select 2015 as year, 'ALL' as area_id, cast(null as int) as age, cast(null as string) as nationality, cast(sum(population) as bigint) as population, 0 as tolerance from fx_population_start
union all select 2025, 'ALL', cast(null as int), 'EXT', cast(sum(population) + 3 as bigint), 5 from fx_population_end where nationality = 'EXT'
union all select 2025, 'ALL', 40, cast(null as string), cast(sum(population) + 1 as bigint), 0 from fx_population_end where age = 40
union all select 2015, 'N' || cast(s_nationkey as string), cast(null as int), cast(null as string), cast(sum(population) as bigint), 0
from fx_population_start join supplier on geography_id = 'S' || cast(s_suppkey as string) group by s_nationkey
""",
    "fx_boxes": """
select 'old' as vintage, 'S' || cast(s_suppkey as string) as id, s_suppkey as k, 0 as skew,
       (s_suppkey % 10) * 100 as x0, cast(floor(s_suppkey / 10) as int) * 100 as y0, (s_suppkey % 10) * 100 + 100 as x1, cast(floor(s_suppkey / 10) as int) * 100 + 100 as y1
from supplier
union all
select 'new', case s_suppkey % 10 when 0 then 'S' || cast(s_suppkey as string) || 'a' when 4 then 'M' || cast(s_suppkey - s_suppkey % 10 as string)
       when 7 then 'X' || cast(s_suppkey as string) else 'S' || cast(s_suppkey as string) end, s_suppkey, case when s_suppkey % 10 = 9 then 20 else 0 end,
       (s_suppkey % 10) * 100, cast(floor(s_suppkey / 10) as int) * 100,
       (s_suppkey % 10) * 100 + (case s_suppkey % 10 when 0 then 50 when 4 then 200 else 100 end), cast(floor(s_suppkey / 10) as int) * 100 + 100
from supplier where s_suppkey % 10 <> 5
union all
select 'new', 'S' || cast(s_suppkey as string) || 'b', s_suppkey, 0, 50, cast(floor(s_suppkey / 10) as int) * 100, 100, cast(floor(s_suppkey / 10) as int) * 100 + 100
from supplier where s_suppkey % 10 = 0
""",
    "fx_polygons": """
select vintage, id, 0 as ring, corner as seq,
       cast(case when corner in (1, 2) then x1 else x0 end + (case when corner in (2, 3) then skew else 0 end) as double) as x,
       cast(case when corner in (2, 3) then y1 else y0 end as double) as y
from fx_boxes CORNERS
""",
    # One enclosing polygon per layer, 50 wider than the sections on the left side.
    "fx_municipality": """
select 'CITY' as id, 0 as ring, corner as seq,
       case when corner in (1, 2) then x1 else x0 - 5e1 end as x, case when corner in (2, 3) then y1 else y0 end as y
from (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from fx_polygons where vintage = 'old') b CORNERS
""",
    # Parent layer: one strip of ten sections per id, named by its row.
    "fx_parent_layer": """
select 'P' || cast(cast(floor(s_suppkey / 10) as int) as string) as id, 0 as ring, corner as seq,
       case when corner in (1, 2) then 95e1 else 0e0 end as x,
       cast(case when corner in (2, 3) then min(s_suppkey) * 10 + 100 else min(s_suppkey) * 10 end as double) as y
from supplier CORNERS group by floor(s_suppkey / 10), corner
""",
    "fx_population_end_new": """
select case k when 0 then g || (case when age % 2 = 0 then 'a' else 'b' end) when 4 then 'M' || cast(s - 4 as string)
       when 5 then 'M' || cast(s - 5 as string) when 7 then 'X' || cast(s as string) else g end as geography_id,
       age, sex, nationality, cast(sum(population) as bigint) as population
from (select geography_id as g, s_suppkey as s, s_suppkey % 10 as k, age, sex, nationality, population
      from fx_population_end join supplier on geography_id = 'S' || cast(s_suppkey as string)) t
group by 1, 2, 3, 4
""",
    "fx_vintage_population": """
select 'old' as vintage, geography_id, population from fx_population_start
union all select 'new', geography_id, population from fx_population_end_new
""",
    # Raw membership of both vintages: some sections lie in two barrios, some barrios are unknown, some move.
    "fx_membership": """
select 'old' as vintage, geography_id as section_id, 'R' || cast(n_regionkey as string) as district,
       case when s_suppkey % 33 = 7 then '0000' when s_suppkey % 17 = 0 and age % 2 = 0 then 'N' || cast((s_nationkey + 1) % 25 as string)
            else 'N' || cast(s_nationkey as string) end as barrio,
       cast(sum(population) as bigint) as population
from fx_population_start join supplier on geography_id = 'S' || cast(s_suppkey as string) join nation on n_nationkey = s_nationkey
group by 1, 2, 3, 4
union all
select 'new', case s_suppkey % 10 when 0 then geography_id || (case when age % 2 = 0 then 'a' else 'b' end) when 4 then 'M' || cast(s_suppkey - 4 as string)
       when 5 then 'M' || cast(s_suppkey - 5 as string) when 7 then 'X' || cast(s_suppkey as string) else geography_id end,
       'R' || cast(n_regionkey as string),
       case when s_suppkey % 12 = 3 then 'N' || cast((s_nationkey + 2) % 25 as string) else 'N' || cast(s_nationkey as string) end,
       cast(sum(population) as bigint)
from fx_population_end join supplier on geography_id = 'S' || cast(s_suppkey as string) join nation on n_nationkey = s_nationkey
group by 1, 2, 3, 4
""",
    "fx_registry": """
select cast(s_suppkey as int) + 5 as row_number, 'S' || cast(s_suppkey as string) as section_id,
       'N' || cast(s_nationkey as string) as parent,
       case when s_suppkey % 4 = 0 then 'N' || cast((s_nationkey + 1) % 25 as string) end as previous_parent,
       case when s_suppkey % 31 = 30 then '' else cast(19880101 + s_suppkey % 28 as string) end as created_raw,
       case when s_suppkey % 13 = 0 then '20200701' else '' end as closed_raw,
       case s_suppkey % 12 when 0 then '20171101' when 4 then '20171606' else '' end as modified_raw
from supplier
""",
    # Buildings: one box in each half of every old section that splits, capacity from the order book.
    "fx_buildings": """
select id || '-' || cast(corner as string) as id, k, corner as half, cast(capacity as double) as capacity,
       cast(x0 + (case when corner = 0 then 10 else 40 end) as double) as x0, cast(y0 + 20 as double) as y0,
       cast(x0 + (case when corner = 0 then 30 else 80 end) as double) as x1, cast(y0 + 60 as double) as y1
from (select vintage, id, k, x0, y0, count(*) as capacity from fx_boxes join lineitem on l_suppkey = k group by vintage, id, k, x0, y0) b CORNERS
where corner <= 1 and vintage = 'old' and k % 10 = 0
""",
    "fx_building_rings": """
select id, 0 as ring, corner as seq, case when corner in (1, 2) then x1 else x0 end as x, case when corner in (2, 3) then y1 else y0 end as y
from fx_buildings CORNERS
""",
}


def duckdb_views() -> dict[str, str]:
    """The same views in DuckDB's spelling."""
    views = {name: text.replace(CORNERS, CORNERS_DUCKDB) for name, text in VIEWS.items()}
    return {**views, "fx_grid": GRID_DUCKDB}


def dependencies(text: str, known: dict[str, str]) -> list[str]:
    """Names of ``known`` that ``text`` needs, each after the ones it builds on."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", body):
                visit_one(name)

    def visit_one(name: str) -> None:
        for other in known:
            if other != name and other not in order and re.search(rf"\b{other}\b", known[name]):
                visit_one(other)
        if name not in order:
            order.append(name)

    visit(text)
    return order


class Fixtures:
    """Tables of one data directory and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        view = f"fx_{name}"
        if view not in VIEWS:
            raise AttributeError(name)
        if view not in self._made:
            self._made[view] = self.sql(VIEWS[view].replace(CORNERS, CORNERS_SPARK))
        return self._made[view]

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables and views it names; the names are bound to this directory."""
        args = {}
        for name in dependencies(text, VIEWS):
            args[name] = getattr(self, name[3:])
        for name in TABLES:
            if re.search(rf"\b(from|join)\s+{name}\b", text):
                args[name] = self.table(name)
        for name in args:
            pattern = rf"\b(from|join)\s+{name}\b" if name in TABLES else rf"\b{name}\b"
            text = re.sub(pattern, lambda m, n=name: m.group(0)[: -len(n)] + "{" + n + "}", text)
        return self.spark.sql(text, **args)

    def layer(self, vintage: str) -> DataFrame:
        return self.polygons.filter(f"vintage = '{vintage}'").drop("vintage")
