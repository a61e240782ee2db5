"""Registered queries on boundaries, zones, crosswalks, parents and the change registry."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.contracts import violations
from cohort.operators import crosswalk as xwk
from cohort.operators import dissolve, graph, parents, polygons, qa, registry
from cohort.operators.staging import shared_folder, stage
from cohort.params import Params
from cohort.plans.core_queries import R
from cohort.plans.fixtures import Fixtures
from cohort.plans.registry import query, rounded, shared
from cohort.sources import layers, sinks

P = Params()
GOOD = ("unchanged_candidate", "renumbered_candidate", "exact_aggregate_candidate")


def flat(df: DataFrame) -> DataFrame:
    """Lists of text joined with ``|``."""
    return df.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def overlay(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    zones, met = xwk.overlay(f.layer("old"), f.layer("new"), P)
    return stage(zones), met


# Shared SQL: edges, areas, the strip integral, components and zones.

def _edges(layer: str) -> str:
    return f"select a.*, b.x as xb, b.y as yb from {layer} a join {layer} b on b.id = a.id and b.ring = a.ring and b.seq = a.seq + 1"


def _area(layer: str) -> str:
    return f"select id, abs(sum(x * yb - xb * y)) / 2 as area from ({_edges(layer)}) group by id"


def _inter(left: str, right: str) -> str:
    """Overlap area of every pair with touching boxes, as the sum over all edge pairs."""
    box = "select id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {} group by id"
    ne = ("select e.id, least(x, xb) as x0, greatest(x, xb) as x1, case when x < xb then y else yb end as y, (yb - y) / (xb - x) as m, "
          "case when x < xb then 1 else -1 end * o.s as t from ({}) e join (select id, sign(sum(x * yb - xb * y)) as s from ({}) group by id) o on o.id = e.id where x <> xb")
    return f"""
select a, b, sum(ta * tb * case when (ya - yb) * (za - zb) < 0 then
    w * ((ya - yb) / ((ya - yb) - (za - zb)) * (least(ya, yb) + ya + (ya - yb) / ((ya - yb) - (za - zb)) * (za - ya))
       + (1 - (ya - yb) / ((ya - yb) - (za - zb))) * (ya + (ya - yb) / ((ya - yb) - (za - zb)) * (za - ya) + least(za, zb))) / 2
  else w * (least(ya, yb) + least(za, zb)) / 2 end) as area
from (select a, b, ta, tb, hi - lo as w, ey + (lo - ex0) * em - base as ya, ey + (hi - ex0) * em - base as za, fy + (lo - fx0) * fm - base as yb, fy + (hi - fx0) * fm - base as zb
  from (select p.a, p.b, p.base, e.t as ta, g.t as tb, e.y as ey, e.x0 as ex0, e.m as em, g.y as fy, g.x0 as fx0, g.m as fm,
               greatest(e.x0, g.x0) as lo, least(e.x1, g.x1) as hi
        from (select l.id as a, r.id as b, least(l.y0, r.y0) as base from ({box.format(left)}) l join ({box.format(right)}) r
              on greatest(l.x0, r.x0) < least(l.x1, r.x1) and greatest(l.y0, r.y0) < least(l.y1, r.y1)) p
        join ({ne.format(_edges(left), _edges(left))}) e on e.id = p.a join ({ne.format(_edges(right), _edges(right))}) g on g.id = p.b) where lo < hi)
group by a, b"""


shared("x_old", "select id, ring, seq, x, y from fx_polygons where vintage = 'old'")
shared("x_new", "select id, ring, seq, x, y from fx_polygons where vintage = 'new'")
shared("x_both", "select vintage || '|' || id as id, ring, seq, x, y from fx_polygons")
shared("x_old_area", _area("x_old"))
shared("x_new_area", _area("x_new"))
shared("x_meet", _inter("x_old", "x_new"))
shared("x_overlaps", """
select a as old_id, b as new_id, m.area, o.area as area_a, n.area as area_b from x_meet m join x_old_area o on o.id = a join x_new_area n on n.id = b""")
shared("x_nodes", "select 'old|' || id as node, 'old' as vintage, id, area from x_old_area union all select 'new|' || id, 'new', id, area from x_new_area")


def _components(prefix: str, material: str) -> None:
    shared(f"{prefix}_link", f"""
select 'old|' || old_id as src, 'new|' || new_id as dst from x_overlaps where {material}
union all select 'new|' || new_id, 'old|' || old_id from x_overlaps where {material}""")
    shared(f"{prefix}_reach", f"""/*cols: node, other*/
select node, node from x_nodes union select r.node, l.dst from {prefix}_reach r join {prefix}_link l on l.src = r.other""")
    shared(f"{prefix}_member", f"""
select vintage, id, area, component from x_nodes n join (select node, min(other) as component from {prefix}_reach group by 1) r on r.node = n.node""")
    shared(f"{prefix}_sides", f"""
select m.component, list_sort(list(id) filter (vintage = 'old')) as old_ids, list_sort(list(id) filter (vintage = 'new')) as new_ids,
       coalesce(sum(area) filter (vintage = 'old'), 0) as old_area, coalesce(sum(area) filter (vintage = 'new'), 0) as new_area,
       coalesce(any_value(shared), 0) as shared
from {prefix}_member m left join (select a.component, sum(o.area) as shared from x_overlaps o join {prefix}_member a on a.vintage = 'old' and a.id = o.old_id
  join {prefix}_member b on b.vintage = 'new' and b.id = o.new_id and b.component = a.component group by 1) s on s.component = m.component group by 1""")


_components("x_mat", "area > 1e-6 * least(area_a, area_b)")
_components("x_prov", "area > greatest(1.0, 1e-3 * least(area_a, area_b))")
shared("x_ratio", """
select component, coalesce(old_ids, []) as old_ids, coalesce(new_ids, []) as new_ids, old_area, new_area,
       (old_area + new_area - 2 * shared) / greatest(old_area, new_area, 1e-12) as ratio from x_mat_sides""")
shared("x_class", """
select *, len(old_ids) > 0 and len(new_ids) > 0 and ratio <= 1e-3 as compatible, len(old_ids) as b, len(new_ids) as a from x_ratio""")
shared("x_kind", """
select *, case when b = 0 then 'extra' when a = 0 then 'missing' when b = 1 and a = 1 and compatible and old_ids = new_ids then 'unchanged'
  when b = 1 and a = 1 and compatible then 'renumbered' when b = 1 and a = 1 then 'materially_redrawn' when b = 1 then 'split' when a = 1 then 'merged'
  else 'materially_redrawn' end as classification from x_class""")
shared("x_zones", """
select *, case when classification = 'unchanged' then new_ids[1] else 'Z-' || substr(sha256(array_to_string(list_concat(old_ids, new_ids), '|')), 1, 12) end as zone_id,
  case when classification = 'unchanged' then 'unchanged' when compatible then 'exact_harmonisation' else 'unreliable' end as quality_status from x_kind""")
shared("x_walk", """
select vintage, source_id, zone_id, 1::double as weight, quality_status, case when compatible then 'exact_union' else 'excluded_union' end as weight_basis,
  case when quality_status = 'unchanged' then 'unchanged' when compatible then 'exact_aggregate' else 'excluded' end as boundary_method
from (select *, 'old' as vintage, unnest(old_ids) as source_id from x_zones union all select *, 'new', unnest(new_ids) from x_zones)""")


# Geometry

@query("geo1_candidates", """
with b as (select vintage, id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from fx_polygons group by all)
select o.id as a, n.id as b from b o join b n on o.vintage = 'old' and n.vintage = 'new' and greatest(o.x0, n.x0) < least(o.x1, n.x1) and greatest(o.y0, n.y0) < least(o.y1, n.y1)""")
def _(f):
    return polygons.candidates(f.layer("old"), f.layer("new")).select("a", "b")


@query("geo2_overlaps", f"""
select old_id, new_id, {R('area old_share new_share')} from (select *, area / area_a as old_share, area / area_b as new_share from x_overlaps)
where area > 1e-6 * least(area_a, area_b)""")
def _(f):
    met = polygons.overlaps(f.layer("old"), f.layer("new"))
    material = F.col("area") > P.material_overlap * F.least("area_a", "area_b")
    return rounded(met.filter(material).select("old_id", "new_id", "area", "old_share", "new_share"))


@query("geo3_self_overlaps", f"""
select a, b, round(m.area, 6) as overlap_area from ({_inter('x_both', 'x_both')}) m join ({_area('x_both')}) p on p.id = a join ({_area('x_both')}) q on q.id = b
where a < b and m.area > 1e-3 * least(p.area, q.area)""")
def _(f):
    both = f.polygons.withColumn("id", F.concat_ws("|", "vintage", "id")).drop("vintage")
    return rounded(polygons.self_overlaps(both))


@query("geo3_topology", f"""
select (select count(*) from x_old_area) as polygons, round((select sum(area) from x_old_area), 6) as union_area,
       round((select sum(area) from ({_area('fx_municipality')})) - i.s, 6) as gap_area, round((select sum(area) from x_old_area) - i.s, 6) as outside_area
from (select sum(area) as s from ({_inter('x_old', 'fx_municipality')})) i""")
def _(f):
    return rounded(polygons.topology(f.layer("old"), f.municipality))


ZONE_COLUMNS = """zone_id, array_to_string(old_ids, '|') as old_ids, array_to_string(new_ids, '|') as new_ids, classification, quality_status,
round(ratio, 6) as symmetric_difference_ratio"""


@query("geo4_components", f"select {ZONE_COLUMNS} from x_zones")
def _(f):
    zones, _ = overlay(f)
    return flat(rounded(zones.select("zone_id", "old_ids", "new_ids", "classification", "quality_status", "symmetric_difference_ratio")))


@query("geo5_zone_ids", "select zone_id, len(old_ids)::int as old_sections, len(new_ids)::int as new_sections from x_zones")
def _(f):
    zones, _ = overlay(f)
    return zones.select("zone_id", F.size("old_ids").alias("old_sections"), F.size("new_ids").alias("new_sections"))


@query("geo6_crosswalk", """
select w.*, r.review from x_walk w left join (select zone_id, case when classification = 'split' then 'approved' end as review from x_zones) r on r.zone_id = w.zone_id""")
def _(f):
    first, _ = overlay(f)
    reviews = first.filter("classification = 'split'").select("zone_id", F.lit("approved").alias("review"))
    return xwk.crosswalk(first.drop("review").join(reviews, "zone_id", "left"))


shared("x_prov_zones", """
select component, coalesce(old_ids, []) as old_ids, coalesce(new_ids, []) as new_ids,
  case when len(old_ids) > 0 and len(new_ids) > 0 then shared / nullif(old_area, 0) end as old_mutual_overlap,
  case when len(old_ids) > 0 and len(new_ids) > 0 then shared / nullif(new_area, 0) end as new_mutual_overlap,
  case when len(old_ids) > 0 and len(new_ids) > 0 then old_area + new_area - 2 * shared end as symmetric_difference,
  case when old_ids is null or new_ids is null then 'unreliable_candidate' when least(shared / old_area, shared / new_area) < 0.999 then 'redrawn_candidate'
       when old_ids = new_ids and len(old_ids) = 1 then 'unchanged_candidate' when len(old_ids) = 1 and len(new_ids) = 1 then 'renumbered_candidate'
       else 'exact_aggregate_candidate' end as status
from x_prov_sides""")


@query("geo7_provisional", f"""
select array_to_string(old_ids, '|') as old_ids, array_to_string(new_ids, '|') as new_ids, {R('old_mutual_overlap new_mutual_overlap symmetric_difference')}, status from x_prov_zones""")
def _(f):
    zones, _, _ = xwk.provisional(f.layer("old"), f.layer("new"))
    return flat(rounded(zones.select("old_ids", "new_ids", "old_mutual_overlap", "new_mutual_overlap", "symmetric_difference", "status")))


@query("geo7_provisional_summary", """
select status, count(*) as components, (select round(coalesce(sum(area) filter (area <= greatest(1.0, 1e-3 * least(area_a, area_b))), 0), 6) from x_overlaps) as ignored_area
from x_prov_zones group by 1""")
def _(f):
    zones, met, _ = xwk.provisional(f.layer("old"), f.layer("new"))
    return rounded(xwk.provisional_summary(zones, met))


@query("geo8_coverage", """
with p as (select vintage, geography_id as id, sum(population)::double as stock from fx_vintage_population group by all),
s as (select m.vintage, m.id, z.status from x_prov_member m join x_prov_zones z on z.component = m.component)
select coalesce(p.vintage, s.vintage) as vintage,
  round(coalesce(sum(stock) filter (status in ('unchanged_candidate', 'renumbered_candidate', 'exact_aggregate_candidate')) , 0) / sum(stock), 6) as covered_share,
  round(sum(stock) filter (s.id is not null), 6) as population_with_geometry, count(*) filter (s.id is null) as population_ids_without_geometry,
  count(*) filter (stock is null) as geometry_ids_without_population
from p full join s on s.vintage = p.vintage and s.id = p.id group by 1""")
def _(f):
    zones, _, members = xwk.provisional(f.layer("old"), f.layer("new"))
    return rounded(xwk.coverage(f.vintage_population, members, zones, GOOD))


def _lonlat_sql() -> str:
    radius, _, inverse, to_lat = polygons._series()
    xi, eta = f"((y + 4470000) / {polygons._K0 * radius!r})", f"((x + 440000 - 500000) / {polygons._K0 * radius!r})"
    xi1 = xi + "".join(f" - ({b!r}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(inverse, 1))
    eta1 = eta + "".join(f" - ({b!r}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(inverse, 1))
    lat = "chi" + "".join(f" + ({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(to_lat, 1))
    return f"""
select vintage, id, seq, round(degrees(atan2(sinh(eta1), cos(xi1)) + ({math.radians(-3.0)!r})), 8) as lon, round(degrees({lat}), 8) as lat
from (select *, asin(sin(xi1) / cosh(eta1)) as chi from (select vintage, id, seq, {xi1} as xi1, {eta1} as eta1 from fx_polygons))"""


@query("geo9_lonlat", _lonlat_sql())
def _(f):
    moved = f.polygons.withColumns({"x": F.col("x") + 440000, "y": F.col("y") + 4470000})
    return rounded(polygons.to_lonlat(moved).select("vintage", "id", "seq", "lon", "lat"), 8)


@query("geo9_round_trip", "select vintage, id, seq, true as same from fx_polygons")
def _(f):
    moved = f.polygons.withColumns({"x0": F.col("x") + 440000, "y0": F.col("y") + 4470000}).withColumns({"x": F.col("x") + 440000, "y": F.col("y") + 4470000})
    back = polygons.from_lonlat(polygons.to_lonlat(moved))
    same = (F.abs(F.col("x") - F.col("x0")) < 1e-3) & (F.abs(F.col("y") - F.col("y0")) < 1e-3)
    return back.select("vintage", "id", "seq", same.alias("same"))


MEASURES = f"""
select m.id, {R('area cx cy x0 y0 x1 y1')} from (
  select id, abs(sum(c)) / 2 as area, sum((x + xb) * c) / (3 * sum(c)) as cx, sum((y + yb) * c) / (3 * sum(c)) as cy, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1
  from (select *, x * yb - xb * y as c from ({_edges('x_new')})) group by id) m"""


@query("geo10_measures", MEASURES)
def _(f):
    return rounded(polygons.measures(f.layer("new")))


@query("bnd12_centroids", f"select id as area_id, cx, cy from ({MEASURES.replace('x_new', 'x_old')}) where id in (select area_id from fx_geographies)")
def _(f):
    areas = f.geographies.select("area_id")
    return rounded(polygons.measures(f.layer("old")).join(areas, F.col("id") == F.col("area_id")).select("area_id", "cx", "cy"))


shared("x_bent", """
select id, ring, case when k % 11 = 3 and seq = 2 then 3 when k % 11 = 3 and seq = 3 then 2 when k % 11 = 5 and seq = 4 then 5 else seq end as seq, x, y
from (select p.*, s_suppkey as k from x_old p join supplier on p.id = 'S' || cast(s_suppkey as string)) where not (k % 11 = 5 and seq = 4)""")


@query("geo11_validity", f"""
with e as ({_edges('x_bent')}),
o as (select id, (arg_min(x, seq) <> arg_max(x, seq) or arg_min(y, seq) <> arg_max(y, seq) or count(*) < 4)::bigint as open_rings from x_bent group by id),
z as (select id, (sum(x * yb - xb * y) = 0)::bigint as flat_rings from e group by id),
c as (select a.id, count(*) as crossings from e a join e b on b.id = a.id and a.seq < b.seq
  where sign((a.xb - a.x) * (b.y - a.y) - (a.yb - a.y) * (b.x - a.x)) * sign((a.xb - a.x) * (b.yb - a.y) - (a.yb - a.y) * (b.xb - a.x)) < 0
    and sign((b.xb - b.x) * (a.y - b.y) - (b.yb - b.y) * (a.x - b.x)) * sign((b.xb - b.x) * (a.yb - b.y) - (b.yb - b.y) * (a.xb - b.x)) < 0 group by 1)
select o.id, open_rings, flat_rings, coalesce(crossings, 0) as crossings, open_rings = 0 and flat_rings = 0 and coalesce(crossings, 0) = 0 as valid
from o join z on z.id = o.id left join c on c.id = o.id""")
def _(f):
    k = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    bent = F.when((k % 11 == 3) & (F.col("seq") == 2), 3).when((k % 11 == 3) & (F.col("seq") == 3), 2).otherwise(F.col("seq"))
    layer = f.layer("old").filter(~((k % 11 == 5) & (F.col("seq") == 4))).withColumn("seq", bent)
    return polygons.validity(layer)


@query("geo12_boundaries", f"""
select group_id, xa, ya, xb, yb from (
  select zone_id as group_id, case when x < xb or (x = xb and y < yb) then x else xb end as xa, case when x < xb or (x = xb and y < yb) then y else yb end as ya,
         case when x < xb or (x = xb and y < yb) then xb else x end as xb, case when x < xb or (x = xb and y < yb) then yb else y end as yb
  from ({_edges('x_old')}) e join x_walk w on w.vintage = 'old' and w.source_id = e.id) group by all having count(*) = 1""")
def _(f):
    zones, _ = overlay(f)
    groups = xwk.crosswalk(zones).filter("vintage = 'old'").select(F.col("source_id").alias("id"), F.col("zone_id").alias("group_id"))
    return dissolve.boundary(f.layer("old"), groups)


shared("x_outlines", """
with latest as (select zone_id, max(vintage = 'new') as has_new from x_walk group by 1),
e as (select w.zone_id, w.vintage, a.id, a.x as xa, a.y as ya, b.x as xb, b.y as yb, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) as size
  from x_walk w join latest using (zone_id) join fx_polygons a on a.vintage = w.vintage and a.id = w.source_id
  join fx_polygons b on b.vintage = a.vintage and b.id = a.id and b.ring = a.ring and b.seq = a.seq + 1 where w.vintage = case when has_new then 'new' else 'old' end),
-- Members share the part of a line that edges of both have.
s as (select p.zone_id, sum(case when p.ya = p.yb then greatest(0, least(greatest(p.xa, p.xb), greatest(q.xa, q.xb)) - greatest(least(p.xa, p.xb), least(q.xa, q.xb)))
    else greatest(0, least(greatest(p.ya, p.yb), greatest(q.ya, q.yb)) - greatest(least(p.ya, p.yb), least(q.ya, q.yb))) * p.size / abs(p.yb - p.ya) end) as shared
  from e p join e q on q.zone_id = p.zone_id and q.id > p.id and abs((p.xb - p.xa) * (q.ya - p.ya) - (p.yb - p.ya) * (q.xa - p.xa)) < 1e-6
    and abs((p.xb - p.xa) * (q.yb - p.ya) - (p.yb - p.ya) * (q.xb - p.xa)) < 1e-6 group by 1)
select e.zone_id, max(vintage) as vintage, sum(one) as area, sum(around) - 2 * coalesce(any_value(shared), 0) as perimeter
from (select zone_id, vintage, id, abs(sum(xa * yb - xb * ya)) / 2 as one, sum(size) as around from e group by all) e left join s on s.zone_id = e.zone_id group by 1""")


def outline_measures(vertices: DataFrame) -> DataFrame:
    """Area, perimeter and open rings of each polygon."""
    e = stage(polygons.edges(vertices))
    around = e.groupBy("id").agg(F.sum(F.hypot(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"))).alias("perimeter"))
    open_rings = polygons.validity(vertices).select("id", "open_rings")
    return polygons.areas(e).join(around, "id").join(open_rings, "id").withColumnRenamed("id", "zone_id")


@query("geo12_zone_polygons", f"select zone_id, {R('area perimeter')}, 0::bigint as open_rings from x_outlines")
def _(f):
    zones, _ = overlay(f)
    return rounded(outline_measures(dissolve.zone_polygons(stage(xwk.crosswalk(zones)), f.layer("old"), f.layer("new"))))


shared("x_grid", """
select id, ring, seq, round_even((x - x0) / case when x1 = x0 then 1 else (x1 - x0) / 99999 end, 0)::bigint as gx,
       round_even((y - y0) / case when y1 = y0 then 1 else (y1 - y0) / 99999 end, 0)::bigint as gy
from x_new cross join (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from x_new)""")


@query("geo13_quantised_deltas", """
select id, 0 as part, ring, seq, gx - coalesce(lag(gx) over w, 0) as dx, gy - coalesce(lag(gy) over w, 0) as dy from x_grid window w as (partition by id, ring order by seq)""")
def _(f):
    return polygons.quantise(f.layer("new"))


@query("geo13_restored", """
select id, 0 as part, ring, seq, gx, gy from x_grid""")
def _(f):
    summed = polygons.restore(polygons.quantise(f.layer("new")), (0.0, 0.0, 99999.0, 99999.0))
    return summed.select("id", "part", "ring", "seq", F.col("x").cast("bigint").alias("gx"), F.col("y").cast("bigint").alias("gy"))


@query("gra1_components", "select 'old|' || id as node, component from x_mat_member where vintage = 'old' union all select 'new|' || id, component from x_mat_member where vintage = 'new'")
def _(f):
    met = polygons.overlaps(f.layer("old"), f.layer("new"))
    material = F.col("area") > P.material_overlap * F.least("area_a", "area_b")
    members = xwk.memberships(met, polygons.areas(f.layer("old")), polygons.areas(f.layer("new")), material)
    return members.select(F.concat_ws("|", "vintage", "id").alias("node"), "component")


ORDER_EDGES = "select 'o' || cast(l_orderkey as string) as src, 'p' || cast(l_partkey as string) as dst from lineitem"
ORDER_GRAPH = ORDER_EDGES.replace("select", "select distinct")


@query("gra1_order_graph", f"""
with recursive n as ({ORDER_GRAPH}), l as (select src as a, dst as b from n union all select dst, src from n),
lab(node, low, it) as (select a, a, 0 from (select a from l group by 1)
  union all select node, low, it + 1 from (select p.node, least(p.low, min(q.low)) as low, p.it from lab p join l on l.a = p.node join lab q on q.node = l.b group by p.node, p.low, p.it) where it < 16)
select node, min(low) as component from lab group by 1 union all select 'c' || c_custkey, 'c' || c_custkey from customer""")
def _(f):
    e = f.sql(ORDER_EDGES)
    alone = f.sql("select 'c' || cast(c_custkey as string) as node from customer")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().unionByName(alone)
    return graph.components(e, nodes)


# Crosswalks

def walk(f: Fixtures, vintage: str = "old") -> DataFrame:
    zones, _ = overlay(f)
    return xwk.crosswalk(zones).filter(f"vintage = '{vintage}'")


@query("xwk1_row_rules", """
select 'weight' as rule, count(*) filter (weight not between 0 and 1) as violations from x_bad_walk
union all select 'fractional exact weight', count(*) filter (quality_status in ('unchanged', 'exact_harmonisation') and weight not in (0, 1)) from x_bad_walk
union all select 'estimated allocation without evidence', count(*) filter (quality_status = 'estimated_harmonisation') from x_bad_walk""")
def _(f):
    bad = walk(f).withColumns({
        "weight": F.when(F.col("source_id").like("%3"), 1.5).when(F.col("source_id").like("%4"), 0.5).otherwise(F.col("weight")),
        "quality_status": F.when(F.col("source_id").like("%6"), "estimated_harmonisation").otherwise(F.col("quality_status"))})
    return violations(bad, xwk.rules())


shared("x_bad_walk", """
select source_id, case when source_id like '%3' then 1.5 when source_id like '%4' then 0.5 else weight end as weight,
       case when source_id like '%6' then 'estimated_harmonisation' else quality_status end as quality_status from x_walk where vintage = 'old'""")


@query("xwk1_problems", """
with w as (select source_id, count(*) as n, abs(sum(weight) - 1) as gap from x_walk where vintage = 'old' group by 1), p as (select distinct geography_id as id from fx_population_end_new)
select coalesce(source_id, id) as source_id, case when source_id is null then 'population without crosswalk' else 'crosswalk without population' end as problem
from w full join p on p.id = w.source_id where source_id is null or id is null""")
def _(f):
    return xwk.problems(walk(f), f.population_end_new)


shared("x_harmonised", """
select zone_id as geography_id, age, sex, nationality, sum(population * weight)::double as population from fx_population_end_new join x_walk on vintage = 'new' and source_id = geography_id group by all""")


@query("xwk2_harmonised", "select geography_id, age, sex, nationality, round(population, 6) as population from x_harmonised")
def _(f):
    return rounded(xwk.harmonise(f.population_end_new, walk(f, "new")))


@query("xwk2_total_preserved", """
select round(b, 6) as population_before, round(a, 6) as population_after, abs(a - b) <= 1e-6 * greatest(b, 1) as preserved
from (select sum(population)::double as b from fx_population_end_new)
cross join (select sum(population * weight)::double as a from fx_population_end_new join x_walk on vintage = 'new' and source_id = geography_id)""")
def _(f):
    return rounded(xwk.preserved(f.population_end_new, xwk.harmonise(f.population_end_new, walk(f, "new"))))


@query("xwk3_capacity_weights", """
with v as (select k, half, sum(capacity) over (partition by k) as total, capacity, capacity / sum(capacity) over (partition by k) as one from fx_buildings),
-- The left building lies in the left half; the right one from 40 to 80 puts a quarter left of 50.
l as (select k, max(total) as total, sum(case when half = 0 then capacity else capacity * 0.25 end) as left_value from v group by 1)
select 'S' || k as source_id, 'S' || k || 'a' as target_id, round(left_value / total, 6) as weight, round(left_value / total - 0.5, 6) as area_difference from l
union all select 'S' || k, 'S' || k || 'b', round(1 - left_value / total, 6), round(0.5 - left_value / total, 6) from l""")
def _(f):
    split = f.boxes.filter("vintage = 'new' and k % 10 = 0").select(F.concat(F.lit("S"), F.col("k")).alias("source_id"), F.col("id").alias("target_id"))
    sources = f.layer("old").join(split.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    targets = f.layer("new").join(split.select(F.col("target_id").alias("id")), "id", "left_semi")
    capacity = f.buildings.select("id", "capacity", F.lit(True).alias("vintage_ok"), F.lit(True).alias("licensed"))
    return rounded(xwk.capacity_weights(sources, targets, split, f.building_rings, capacity))


@query("xwk4_one_sided_ids", """
with p as (select distinct geography_id as id from fx_population_end_new), g as (select distinct id from fx_polygons where vintage = 'old')
select coalesce(p.id, g.id) as id, case when g.id is null then 'population' else 'geometry' end as side from p full join g on g.id = p.id where p.id is null or g.id is null""")
def _(f):
    return xwk.one_sided(f.population_end_new, f.layer("old"))


@query("xwk4_status_mismatch", """
select zone_id, quality_status, boundary_status from x_zones left join fx_geographies on area_id = zone_id where quality_status is distinct from boundary_status""")
def _(f):
    zones, _ = overlay(f)
    return xwk.status_mismatch(zones, f.geographies)


@query("xwk5_zone_facts", """
select zone_id, sum(population)::bigint as population from fx_population_start left join (select * from x_walk where vintage = 'new') w on source_id = geography_id group by 1""")
def _(f):
    mapped = xwk.map_to_zones(f.population_start, walk(f, "new"))
    return mapped.groupBy("zone_id").agg(F.sum("population").alias("population"))


shared("x_shares", """
with p as (select vintage, geography_id as id, sum(population) as p from fx_vintage_population group by all),
j as (select coalesce(p.vintage, w.vintage) as vintage, coalesce(quality_status, 'unreliable') as quality_status, coalesce(p, 0) as p, source_id from p full join x_walk w on w.vintage = p.vintage and w.source_id = p.id)
select vintage, quality_status, sum(p)::double as population, sum(p)::double / sum(sum(p)) over (partition by vintage) as share, count(source_id) as sections from j group by 1, 2""")


@query("qa5_status_shares", f"select vintage, quality_status, sections, {R('population share')} from x_shares")
def _(f):
    zones, _ = overlay(f)
    return rounded(qa.status_shares(f.vintage_population, xwk.crosswalk(zones)))


@query("qa5_feasibility", """
select round(min(e), 6) as exact_population_share, min(e) >= 0.95 as section_gate_passed, case when min(e) >= 0.95 then 'section' else 'barrio' end as recommended_level,
       (select count(*) from x_zones where classification <> 'unchanged') as pending_reviews
from (select vintage, coalesce(sum(share) filter (quality_status in ('unchanged', 'exact_harmonisation')), 0) as e from x_shares group by 1)""")
def _(f):
    zones, _ = overlay(f)
    return rounded(qa.feasibility(f.vintage_population, xwk.crosswalk(zones), zones))


@query("qa11_geometry_match", """
with a as (select level, area_id as id from fx_geographies), g as (select distinct 'section' as level, id from fx_polygons where vintage = 'new')
select coalesce(a.level, g.level) as level, coalesce(a.id, g.id) as id, case when g.id is null then 'area_only' else 'geometry_only' end as side
from a full join g on g.level = a.level and g.id = a.id where a.id is null or g.id is null""")
def _(f):
    return qa.geometry_match(f.geographies, f.layer("new").select(F.lit("section").alias("level"), "id"))


# Parents

shared("x_sections", "select zone_id, 'old' as vintage, unnest(old_ids) as section_id from x_zones union all select zone_id, 'new', unnest(new_ids) from x_zones")
shared("x_section_parents", """
select s.zone_id, s.vintage, s.section_id, count(distinct m.district || '/' || m.barrio) as n, list(distinct m.district || '/' || m.barrio) filter (m.barrio is not null) as p
from x_sections s left join fx_membership m on m.vintage = s.vintage and m.section_id = s.section_id group by all""")
shared("x_zone_parents", """
select zone_id, list_sort(list_distinct(flatten(list(p) filter (vintage = 'old' and p is not null)))) as op, list_sort(list_distinct(flatten(list(p) filter (vintage = 'new' and p is not null)))) as np,
       count(*) filter (n = 0) as missing, count(*) filter (vintage = 'old' and n > 1) as amb_old, count(*) filter (vintage = 'new' and n > 1) as amb_new
from x_section_parents group by 1""")
shared("x_parent_flags", """
select *, coalesce(len(op), 0) as lo, coalesce(len(np), 0) as ln, coalesce(len(list_filter(list_concat(coalesce(op, []), coalesce(np, [])), lambda q: q like '%/0000')), 0) > 0 as unknown,
       list_distinct(list_transform(coalesce(op, []), lambda q: split_part(q, '/', 1))) as od, list_distinct(list_transform(coalesce(np, []), lambda q: split_part(q, '/', 1))) as nd from x_zone_parents""")
shared("x_assessed", """
select *, lo = 1 and ln = 1 and op = np and missing = 0 and not unknown as stable_parent, len(od) = 1 and od = nd and missing = 0 as stable_district,
  case when missing > 0 then 'missing_raw_membership' when unknown then 'unknown_raw_barrio' when amb_old > 0 or amb_new > 0 then 'ambiguous_section_membership'
       when lo = 1 and ln = 1 and op = np then 'stable_raw_parent_code_only' when lo = 1 and ln = 1 then 'raw_parent_reassignment' else 'multi_parent_zone' end as raw_parent_status
from x_parent_flags""")


def assessed(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    zones, _ = overlay(f)
    return zones, stage(parents.assess(zones, f.membership))


def slashed(column: str):
    return F.array_join(F.transform(column, lambda p: F.concat_ws("/", p["district"], p["barrio"])), "|").alias(column)


@query("par1_raw_membership", """
select case when cod_dist_seccion is not null then '28079' || lpad(cod_distrito::varchar, 2, '0') || lpad((cod_dist_seccion % 1000)::varchar, 3, '0') end as section_id,
       lpad(cod_distrito::varchar, 2, '0') as district, lpad(cod_dist_barrio::varchar, 4, '0') as barrio,
       sum(coalesce(espanoleshombres, 0) + coalesce(espanolesmujeres, 0) + coalesce(extranjeroshombres, 0) + coalesce(extranjerosmujeres, 0))::bigint as population
from fx_wide group by all""")
def _(f):
    return parents.raw_membership(f.wide)


@query("par2_assessment", """
select zone_id, array_to_string(coalesce(op, []), '|') as old_parents, array_to_string(coalesce(np, []), '|') as new_parents, raw_parent_status, stable_parent, stable_district from x_assessed""")
def _(f):
    _, a = assessed(f)
    return a.select("zone_id", slashed("old_parents"), slashed("new_parents"), "raw_parent_status", "stable_parent", "stable_district")


shared("x_declared", """
select id as section_id, case when k % 13 = 0 then 'PX' else 'P' || cast(cast(floor(k / 10) as int) as string) end as parent_id from fx_boxes where vintage = 'new'""")
shared("x_contained", f"""
select a.id as section_id, d.parent_id, d.parent_id = 'PX' as lost, 1 - coalesce(i.area, 0) / a.area as outside, coalesce(s.population, 0)::bigint as known_population
from x_new_area a join x_declared d on d.section_id = a.id left join ({_inter('x_new', 'fx_parent_layer')}) i on i.a = a.id and i.b = d.parent_id
left join (select geography_id, sum(population) as population from fx_population_end_new group by 1) s on s.geography_id = a.id""")


def contained(f: Fixtures) -> DataFrame:
    declared = f.boxes.filter("vintage = 'new'").select(
        F.col("id").alias("section_id"),
        F.when(F.col("k") % 13 == 0, "PX").otherwise(F.concat(F.lit("P"), F.floor(F.col("k") / 10).cast("int"))).alias("parent_id"))
    stock = f.population_end_new.groupBy(F.col("geography_id").alias("section_id")).agg(F.sum("population").alias("population"))
    return parents.containment(f.layer("new"), f.parent_layer, declared, stock)


CONTAINED = "case when lost then 'missing_parent' when outside <= 1e-3 then 'contained_candidate' else 'outside_declared_parent' end"


@query("par3_containment", f"""
select section_id, parent_id as parent_ids, {CONTAINED} as status, round(case when not lost then outside end, 6) as outside_area_ratio, known_population,
       case when not lost then false end as ambiguous_parent from x_contained""")
def _(f):
    return flat(rounded(contained(f)))


@query("par4_assignment", f"""
select o.id as zone_id, coalesce(p.id, '') as parents from x_old_area o left join (
  select i.a as zone, i.b as id from ({_inter('x_old', 'fx_parent_layer')}) i join x_old_area z on z.id = i.a where 1 - i.area / z.area <= 1e-3) p on p.zone = o.id""")
def _(f):
    return flat(parents.assign(f.layer("old"), f.parent_layer, f.parent_layer))


shared("x_layers", """
select 'L' || cast(s_suppkey as string) as candidate_id, case when s_suppkey % 2 = 0 then '2015' else '2025' end as target, s_suppkey % 3 <> 0 as verified,
       case when s_suppkey % 7 = 0 then '' else 'decree' end as evidence, case when s_suppkey % 5 = 0 then '2015-02-30' else '2010-01-01' end as valid_from,
       case when s_suppkey % 4 = 1 then '2020-12-31' else '2026-12-31' end as valid_to from supplier""")


@query("par5_layer_validity", """
select candidate_id, e.endpoint, verified and evidence <> '' and coalesce(e.endpoint between try_cast(valid_from as date) and try_cast(valid_to as date), false) as usable
from x_layers l join (values ('2015', date '2015-01-01'), ('2025', date '2025-01-01')) e(target, endpoint) on e.target = l.target""")
def _(f):
    cand = f.sql("""select 'L' || cast(s_suppkey as string) as candidate_id, case when s_suppkey % 2 = 0 then '2015' else '2025' end as target, s_suppkey % 3 <> 0 as verified,
       case when s_suppkey % 7 = 0 then '' else 'decree' end as evidence, case when s_suppkey % 5 = 0 then '2015-02-30' else '2010-01-01' end as valid_from,
       case when s_suppkey % 4 = 1 then '2020-12-31' else '2026-12-31' end as valid_to from supplier""")
    ends = f.spark.createDataFrame([("2015", "2015-01-01"), ("2025", "2025-01-01")], "target string, endpoint string").withColumn("endpoint", F.col("endpoint").cast("date"))
    return parents.layer_validity(cand, ends)


@query("par6_candidate_summary", f"""
select candidate_id, status, count(*) as sections, sum(known_population)::bigint as known_population, count(*) filter (status <> 'contained_candidate') as exceptions,
       round(max(case when status = 'missing_parent' then 0 else outside end), 6) as maximum_outside_ratio
from (select *, parent_id as candidate_id, {CONTAINED} as status from x_contained) group by 1, 2""")
def _(f):
    return rounded(parents.candidate_summary(contained(f).withColumn("candidate_id", F.get("parent_ids", F.lit(0)))))


@query("par7_accounting", """
with j as (select m.vintage, m.section_id, m.population, s.zone_id, z.classification, a.stable_parent from (select vintage, section_id, sum(population) as population from fx_membership group by all) m
  left join x_sections s on s.vintage = m.vintage and s.section_id = m.section_id left join x_zones z on z.zone_id = s.zone_id left join x_assessed a on a.zone_id = s.zone_id)
select vintage, sum(population) filter (zone_id is not null)::bigint as mapped, coalesce(sum(population) filter (zone_id is null), 0)::bigint as exceptions,
  coalesce(sum(population) filter (stable_parent), 0)::bigint as parent_stable, coalesce(sum(population) filter (classification = 'unchanged'), 0)::bigint as unchanged,
  25::bigint as missing_section, (sum(population) + 25)::bigint as total, round(coalesce(sum(population) filter (stable_parent), 0) / (sum(population) + 25), 6) as parent_stable_share from j group by 1""")
def _(f):
    zones, a = assessed(f)
    stock = f.membership.groupBy("vintage", "section_id").agg(F.sum("population").alias("population"))
    lost = f.membership.select("vintage").distinct().withColumn("population", F.lit(25).cast("bigint"))
    return rounded(parents.review_accounting(zones, a, stock, lost))


@query("par7_review_counts", """
select classification, raw_parent_status, count(*) as zones, count(*) filter (not stable_district) as cross_district, round(max(ratio), 6) as maximum_ratio
from x_zones z join x_assessed a on a.zone_id = z.zone_id group by 1, 2""")
def _(f):
    zones, a = assessed(f)
    return rounded(parents.review_counts(zones, a))


@query("par8_exceptions", """
select z.zone_id, classification, stable_parent, raw_parent_status from x_zones z join x_assessed a on a.zone_id = z.zone_id where classification <> 'unchanged' or not stable_parent""")
def _(f):
    zones, a = assessed(f)
    return parents.exceptions(zones, a)


def named_parents(f: Fixtures) -> DataFrame:
    """Parents named for the sections of each zone, in both vintages."""
    zones, _ = overlay(f)
    walk = xwk.crosswalk(zones).select("vintage", "source_id", "zone_id")
    named = f.sql("""
select section_id as source_id, vintage, 'R' || cast(n_regionkey as string) as district, barrio
from fx_membership join nation on 'N' || cast(n_nationkey as string) = barrio""")
    return stage(named.join(walk, ["vintage", "source_id"]).select("zone_id", "vintage", "district", "barrio"))


def members(named: DataFrame, level: str) -> DataFrame:
    return named.select("zone_id", "vintage", F.col(level).alias("code"))


shared("x_named", """
select w.zone_id, m.vintage, 'R' || cast(n_regionkey as string) as district, barrio
from fx_membership m join nation on 'N' || cast(n_nationkey as string) = barrio
join x_walk w on w.vintage = m.vintage and w.source_id = m.section_id""")


def _pool_sql(level: str, prefix: str, want: str) -> str:
    return f"""
with recursive m as (select distinct zone_id, vintage || '|' || {level} as node, {level} as code from x_named),
l as (select distinct a.node as a, b.node as b from m a join m b on b.zone_id = a.zone_id),
r(node, other) as (select node, node from m union select r.node, l.b from r join l on l.a = r.other),
c as (select node, min(other) as component from r group by 1),
p as (select component, list_sort(list(distinct code)) as codes from c join (select distinct node, code from m) n on n.node = c.node group by 1)
{want.format(prefix=prefix)}"""


POOLS = "select '{prefix}' || array_to_string(codes, '+') as pool_id, array_to_string(codes, '|') as codes from p"
ZONE_POOLS = "select distinct m.zone_id, '{prefix}' || array_to_string(codes, '+') as pool_id from m join c on c.node = m.node join p on p.component = c.component"


@query("hie6_pooled_parents", _pool_sql("barrio", "B-", POOLS))
def _(f):
    pools, _ = parents.pool(members(named_parents(f), "barrio"), "B-")
    return flat(pools)


@query("hie6_zone_pools", _pool_sql("district", "D-", ZONE_POOLS))
def _(f):
    _, zones = parents.pool(members(named_parents(f), "district"), "D-")
    return zones


shared("x_zone_barrio", f"select * from ({_pool_sql('barrio', 'B-', ZONE_POOLS)})")
shared("x_zone_district", f"select * from ({_pool_sql('district', 'D-', ZONE_POOLS)})")


@query("hie7_pooled_hierarchy", """
with b as (select zone_id, pool_id as barrio_id from x_zone_barrio), d as (select zone_id, pool_id as district_id from x_zone_district),
j as (select b.zone_id, barrio_id, district_id from b join d on d.zone_id = b.zone_id)
select zone_id as area_id, 'Zone ' || zone_id as name, 'section' as level, barrio_id as parent_id from j
union all select barrio_id, replace(substr(barrio_id, 3), '+', ' + '), 'barrio', min(district_id) from j group by 1
union all select district_id, replace(substr(district_id, 3), '+', ' + '), 'district', 'ALL' from j group by 1
union all select 'ALL', 'ALL', 'city', null""")
def _(f):
    named = named_parents(f)
    bp, bz = parents.pool(members(named, "barrio"), "B-")
    dp, dz = parents.pool(members(named, "district"), "D-")
    labels = f.sql("select 'barrio' as level, 'N' || cast(n_nationkey as string) as code, 'N' || cast(n_nationkey as string) as name from nation "
                   "union all select 'district', 'R' || cast(r_regionkey as string), 'R' || cast(r_regionkey as string) from region")
    return parents.pooled_hierarchy(bz, dz, bp, dp, labels, "ALL")


@query("hie7_last_labels", """
select 'barrio' as level, code, array_to_string(list_transform(string_split(lower(label), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name
from (select 'N' || cast(s_nationkey as string) as code, arg_max(s_name, s_suppkey) as label from supplier group by 1)""")
def _(f):
    raw = f.sql("select 'barrio' as level, 'N' || cast(s_nationkey as string) as code, s_name as label, s_suppkey as row_number from supplier")
    return parents.last_labels(raw)


# Registry

REG_DATES = """
case when {c}_raw = '' then 'missing' when try_strptime({c}_raw, '%Y%m%d') is null then 'invalid_date_year_only' else 'valid' end as {c}_status,
try_strptime(nullif({c}_raw, ''), '%Y%m%d')::date as {c}, try_cast(substr({c}_raw, 1, 4) as int) as {c}_year"""
shared("x_registry", "select *, " + ", ".join(REG_DATES.format(c=c) for c in ("created", "closed", "modified")) + " from fx_registry")
shared("x_endpoints", "select * from (values (date '2015-01-01'), (date '2025-01-01'), (date '2018-06-01')) e(endpoint)")
shared("x_states", """
select endpoint, row_number, section_id, case when created_status <> 'valid' then 'unresolved' when created > endpoint or (closed is not null and closed <= endpoint) then 'inactive'
  when pthen is null then 'unresolved' else 'active' end as state, pthen, basis
from (select *, case when previous_parent is null then parent when modified_status = 'valid' then case when endpoint < modified then previous_parent else parent end
    when modified_status = 'invalid_date_year_only' and year(endpoint) < modified_year then previous_parent when modified_status = 'invalid_date_year_only' and year(endpoint) > modified_year then parent end as pthen,
  case when previous_parent is null then 'no_previous_parent_recorded' when modified_status = 'valid' then 'dated_reassignment'
    when modified_status = 'invalid_date_year_only' and year(endpoint) <> modified_year then 'year_bracket_only' else 'unresolved_modification_date' end as basis
  from x_registry cross join x_endpoints)""")
ENDPOINTS = ["2015-01-01", "2025-01-01", "2018-06-01"]


def states(f: Fixtures) -> DataFrame:
    return registry.at_endpoints(registry.parsed(f.registry), ENDPOINTS)


@query("reg1_dates", """
select row_number, created_status, created as created_iso, modified_status, modified as modified_iso, modified_year, closed_status from x_registry""")
def _(f):
    r = registry.parsed(f.registry)
    return r.select("row_number", F.col("created.status").alias("created_status"), F.col("created.iso").alias("created_iso"),
                    F.col("modified.status").alias("modified_status"), F.col("modified.iso").alias("modified_iso"),
                    F.col("modified.year").alias("modified_year"), F.col("closed.status").alias("closed_status"))


@query("reg2_parent_at_endpoint", "select endpoint, row_number, section_id, state, case when state = 'active' then pthen end as parent_then, basis from x_states")
def _(f):
    return states(f)


shared("x_raw_parents", """
select e.endpoint, section_id, list_sort(list(distinct barrio)) as raw_parents from fx_membership m join x_endpoints e on (vintage = 'old') = (e.endpoint < date '2020-01-01') group by all""")
shared("x_compared", """
select coalesce(r.endpoint, a.endpoint) as endpoint, coalesce(r.section_id, a.section_id) as section_id, raw_parents, registry_parents,
  case when raw_parents is null then 'registry_only' when raw_parents = coalesce(registry_parents, []) then 'match' else 'difference' end as outcome
from x_raw_parents r full join (select endpoint, section_id, list_sort(list(distinct pthen)) as registry_parents from x_states where state = 'active' group by all) a
  on a.endpoint = r.endpoint and a.section_id = r.section_id""")


def compared(f: Fixtures, s: DataFrame) -> DataFrame:
    dates = F.when(F.col("vintage") == "old", F.array(F.lit("2015-01-01"), F.lit("2018-06-01"))).otherwise(F.array(F.lit("2025-01-01")))
    raw = f.membership.select(F.explode(dates).alias("endpoint"), "section_id", "barrio")
    return registry.compare(s, raw.withColumn("endpoint", F.col("endpoint").cast("date")))


@query("reg3_comparison", """
select endpoint, section_id, outcome, array_to_string(coalesce(raw_parents, []), '|') as raw_parents, array_to_string(coalesce(registry_parents, []), '|') as registry_parents from x_compared""")
def _(f):
    return flat(compared(f, states(f)))


@query("reg3_summary", """
select c.endpoint, count(*) filter (registry_parents is not null) as active_sections, count(*) filter (outcome = 'match') as matches, count(*) filter (outcome = 'difference') as differences,
  count(*) filter (outcome = 'registry_only') as registry_only, (select count(*) from x_states s where s.endpoint = c.endpoint and state = 'unresolved') as unresolved_rows from x_compared c group by 1""")
def _(f):
    s = states(f)
    return registry.summary(s, compared(f, s))


@query("reg4_corroboration", """
select z.zone_id, count(i.section_id) = 0 as corroborated from x_zones z join x_assessed a on a.zone_id = z.zone_id and not stable_parent and z.classification = 'unchanged'
join x_sections s on s.zone_id = z.zone_id left join x_compared i on i.outcome = 'difference' and i.section_id = s.section_id
  and i.endpoint = case when s.vintage = 'old' then date '2015-01-01' else date '2025-01-01' end group by 1""")
def _(f):
    zones, a = assessed(f)
    return registry.corroborated(zones, a, compared(f, states(f)), "2015-01-01", "2025-01-01")


# Layers as text, and extracts

def geojson(f: Fixtures) -> DataFrame:
    """The new layer as one GeoJSON feature text per polygon."""
    return layers.collection(f.layer("new"))


@query("snk6_geojson_features", """
select id, '{"type":"Feature","properties":{"area_id":"' || id || '"},"geometry":{"type":"Polygon","coordinates":[[' ||
  string_agg('[' || x || ',' || y || ']', ',' order by seq) || ']]}}' as feature from x_new group by id""")
def _(f):
    return geojson(f)


@query("src9_geojson_vertices", "select id, 0 as part, ring, seq, x, y from x_new")
def _(f):
    text = geojson(f).select(F.from_json(F.concat(F.lit('{"type":"FeatureCollection","features":['), "feature", F.lit("]}")), layers.FEATURES).alias("c"))
    return layers.vertices(layers.features(text.select("c.*")), "area_id")


SECTION_ATTRIBUTES = """
select case when s_suppkey % 9 = 8 then '99999' else '28079' end as cumun, cast(s_nationkey % 24 as string) as district, cast(s_suppkey % 999 + 1 as string) as section,
       '28079' || lpad(cast(s_nationkey % 24 as string), 2, '0') || lpad(cast((s_suppkey + (case when s_suppkey % 14 = 3 then 1 else 0 end)) % 999 + 1 as string), 3, '0') as code from supplier"""


@query("src10_section_attributes", f"""
with a as ({SECTION_ATTRIBUTES}) select 'district outside its range' as rule, count(*) filter (district::int not between 1 and 21) as violations from a where cumun = '28079'
union all select 'code components disagree', count(*) filter (code <> '28079' || lpad(district, 2, '0') || lpad(section, 3, '0')) from a where cumun = '28079'""")
def _(f):
    return violations(f.sql(SECTION_ATTRIBUTES).filter("cumun = '28079'"), layers.section_rules("28079"))


PARENT_RECORDS = """
select s_suppkey as row_number, cast(s_nationkey % 21 + 1 as string) as district, cast((s_nationkey % 21 + 1) * 10 + s_suppkey % 9 + 1 as string) as barrio from supplier"""


# A layer has each parent once.
PARENT_RECORDS = f"""
select min(row_number) as row_number, district, min(barrio) as barrio from ({PARENT_RECORDS}) group by district, cast(barrio as int) % 10"""


@query("src11_parent_codes", f"""
select row_number, district, barrio, lpad(district, 2, '0') || lpad((barrio::int % 10)::varchar, 2, '0') as parent_id from ({PARENT_RECORDS})""")
def _(f):
    records = f.sql(PARENT_RECORDS)
    return layers.parent_layer(records, records.count())


@query("snk5_zone_outlines", f"select zone_id, 'EPSG:25830' as crs, '2024-' || vintage as version, {R('area perimeter')}, 0::bigint as open_rings from x_outlines")
def _(f):
    zones, _ = overlay(f)
    walk_, folder = stage(xwk.crosswalk(zones)), f"{shared_folder(f.spark)}/trip-{uuid.uuid4().hex}"
    shapes = stage(dissolve.zone_polygons(walk_, f.layer("old"), f.layer("new")))
    back = []
    for vintage in ("old", "new"):  # zones that only the old layer has, and the others, are two releases here
        latest = walk_.groupBy("zone_id").agg(F.min("vintage").alias("vintage"))  # "new" comes before "old"
        mine = latest.filter(F.col("vintage") == vintage)
        kept = shapes.join(mine.select(F.col("zone_id").alias("id")), "id", "left_semi")
        sinks.write_zones(kept, walk_, f"{folder}/{vintage}", version=f"2024-{vintage}")
        named, vertices = sinks.read_zones(f.spark, f"{folder}/{vintage}")
        back.append(named.join(outline_measures(stage(vertices)), "zone_id"))
    return rounded(back[0].unionByName(back[1]))


@query("snk9_boundary_review", """
select z.zone_id, array_to_string(old_ids, '|') as old_ids, array_to_string(new_ids, '|') as new_ids, classification, round(ratio, 6) as symmetric_difference_ratio,
  quality_status, raw_parent_status, stable_parent from x_zones z join x_assessed a on a.zone_id = z.zone_id""")
def _(f):
    zones, a = assessed(f)
    return rounded(sinks.boundary_review(zones, a))
