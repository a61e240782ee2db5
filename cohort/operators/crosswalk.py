"""Common zones of two boundary vintages, crosswalks and re-aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import guard, must_fail
from cohort.functions.expressions import divide, is_finite
from cohort.operators import graph, polygons
from cohort.operators.staging import stage
from cohort.params import Params

EXACT = ("unchanged", "exact_harmonisation")
# Bases that justify a fractional weight.
CAPACITY_BASES = ("residential_capacity", "building_population")


def _node(vintage: str, column: str) -> Column:
    return F.concat(F.lit(vintage + "|"), F.col(column))


def memberships(overlaps: DataFrame, old_areas: DataFrame, new_areas: DataFrame, material: Column) -> DataFrame:
    """``(vintage, id, area, component)`` of every polygon of both layers."""
    linked = overlaps.filter(material).select(_node("old", "old_id").alias("src"), _node("new", "new_id").alias("dst"))

    def side(df: DataFrame, vintage: str) -> DataFrame:
        return df.select(F.lit(vintage).alias("vintage"), "id", "area", _node(vintage, "id").alias("node"))

    nodes = side(old_areas, "old").unionByName(side(new_areas, "new"))
    return stage(nodes.join(graph.components(linked, nodes), "node").drop("node"))


def _internal(overlaps: DataFrame, members: DataFrame) -> DataFrame:
    """Per component: all pair overlaps inside it, also those too small to link polygons."""
    def of(vintage: str, name: str) -> DataFrame:
        return members.filter(F.col("vintage") == vintage).select(F.col("id").alias(f"{vintage}_id"), F.col("component").alias(name))

    met = overlaps.join(of("old", "_c"), "old_id").join(of("new", "_d"), "new_id").filter("_c = _d")
    return met.groupBy(F.col("_c").alias("component")).agg(F.sum("area").alias("shared"))


def _sides(members: DataFrame) -> DataFrame:
    old, new = F.col("vintage") == "old", F.col("vintage") == "new"
    return members.groupBy("component").agg(
        F.array_sort(F.collect_list(F.when(old, F.col("id")))).alias("old_ids"),
        F.array_sort(F.collect_list(F.when(new, F.col("id")))).alias("new_ids"),
        F.coalesce(F.sum(F.when(old, F.col("area"))), F.lit(0.0)).alias("old_area"),
        F.coalesce(F.sum(F.when(new, F.col("area"))), F.lit(0.0)).alias("new_area"),
    )


def zones(overlaps: DataFrame, members: DataFrame, params: Params, reviews: DataFrame | None = None) -> DataFrame:
    """One row per component: id lists, class, symmetric-difference ratio, status and review.

    Polygons of one vintage must not overlap each other (see ``polygons.self_overlaps``), so the
    areas of unions are sums and the symmetric difference is ``a + b - 2 * shared``.
    """
    c = _sides(members).join(_internal(overlaps, members), "component", "left").fillna(0.0, ["shared"])
    before, after = F.size("old_ids"), F.size("new_ids")
    ratio = (F.col("old_area") + F.col("new_area") - 2 * F.col("shared")) / F.greatest("old_area", "new_area", F.lit(1e-12))
    c = c.withColumn("symmetric_difference_ratio", ratio)
    compatible = (before > 0) & (after > 0) & (F.col("symmetric_difference_ratio") <= params.overlap_tolerance)
    one = (before == 1) & (after == 1)
    kind = (
        F.when(before == 0, "extra")
        .when(after == 0, "missing")
        .when(one & compatible & (F.col("old_ids") == F.col("new_ids")), "unchanged")
        .when(one & compatible, "renumbered")
        .when(one, "materially_redrawn")
        .when(before == 1, "split")
        .when(after == 1, "merged")
        .otherwise("materially_redrawn")
    )
    c = c.withColumns({"compatible": compatible, "classification": kind})
    digest = F.substring(F.sha2(F.array_join(F.concat("old_ids", "new_ids"), "|"), 256), 1, 12)
    same = F.col("classification") == "unchanged"
    c = c.withColumns({
        "zone_id": F.when(same, F.get("new_ids", F.lit(0))).otherwise(F.concat(F.lit("Z-"), digest)),
        "quality_status": F.when(same, "unchanged").when(F.col("compatible"), "exact_harmonisation").otherwise("unreliable"),
    })
    c = c.join(reviews, "zone_id", "left") if reviews is not None else c.withColumn("review", F.lit(None).cast("string"))
    return c.withColumn("requires_review", (F.col("classification") != "unchanged") & (F.coalesce("review", F.lit("")) == ""))


def crosswalk(zones_: DataFrame) -> DataFrame:
    """One row per source polygon: its zone, weight 1 and the reason."""
    ids = F.explode(F.concat(
        F.transform("old_ids", lambda i: F.struct(F.lit("old").alias("vintage"), i.alias("source_id"))),
        F.transform("new_ids", lambda i: F.struct(F.lit("new").alias("vintage"), i.alias("source_id"))),
    ))
    same = F.col("quality_status") == "unchanged"
    return zones_.withColumn("_s", ids).select(
        "_s.vintage", "_s.source_id", "zone_id", F.lit(1.0).alias("weight"), "quality_status",
        F.when(F.col("compatible"), "exact_union").otherwise("excluded_union").alias("weight_basis"),
        F.when(same, "unchanged").when(F.col("compatible"), "exact_aggregate").otherwise("excluded").alias("boundary_method"),
        "review",
    )


def overlay(old: DataFrame, new: DataFrame, params: Params, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(zones, overlaps)`` of two vertex tables."""
    old, new = polygons.prepared(old), polygons.prepared(new)
    met = stage(polygons.overlaps(old, new))
    material = F.col("area") > params.material_overlap * F.least("area_a", "area_b")
    members = memberships(met, polygons.areas(old), polygons.areas(new), material)
    return zones(met, members, params, reviews), met


def provisional(old: DataFrame, new: DataFrame, tolerance: float = 1e-3, least: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidate classifier: ``(components, overlaps, members)`` under its own thresholds."""
    old, new = polygons.prepared(old), polygons.prepared(new)
    met = stage(polygons.overlaps(old, new))
    limit = F.greatest(F.lit(least), tolerance * F.least("area_a", "area_b"))
    members = memberships(met, polygons.areas(old), polygons.areas(new), F.col("area") > limit)
    c = _sides(members).join(_internal(met, members), "component", "left").fillna(0.0, ["shared"])
    c = c.withColumns({
        "old_mutual_overlap": divide(F.col("shared"), F.col("old_area")),
        "new_mutual_overlap": divide(F.col("shared"), F.col("new_area")),
        "symmetric_difference": F.col("old_area") + F.col("new_area") - 2 * F.col("shared"),
    })
    both = (F.size("old_ids") > 0) & (F.size("new_ids") > 0)
    close = F.least("old_mutual_overlap", "new_mutual_overlap") >= 1 - tolerance
    one = (F.size("old_ids") == 1) & (F.size("new_ids") == 1)
    status = (
        F.when(~both, "unreliable_candidate")
        .when(~close, "redrawn_candidate")
        .when(one & (F.col("old_ids") == F.col("new_ids")), "unchanged_candidate")
        .when(one, "renumbered_candidate")
        .otherwise("exact_aggregate_candidate")
    )
    c = c.withColumn("status", status)
    for name in ("old_mutual_overlap", "new_mutual_overlap", "symmetric_difference"):
        c = c.withColumn(name, F.when(both, F.col(name)))
    return c, met, members


def provisional_summary(components: DataFrame, overlaps: DataFrame, tolerance: float = 1e-3, least: float = 1.0) -> DataFrame:
    """Counts per status, with the overlap area that stayed below the thresholds."""
    limit = F.greatest(F.lit(least), tolerance * F.least("area_a", "area_b"))
    ignored = overlaps.agg(F.coalesce(F.sum(F.when(F.col("area") <= limit, F.col("area"))), F.lit(0.0)).alias("i"))
    counts = components.groupBy("status").agg(F.count(F.lit(1)).alias("components"))
    return counts.withColumn("ignored_area", ignored.scalar())


def rules() -> dict[str, Column]:
    """Row rules of a crosswalk (sums and id sets are checked by :func:`problems`)."""
    w, status = F.col("weight"), F.col("quality_status")
    reviewed = (F.coalesce("review", F.lit("")) != "") & F.col("weight_basis").isin(*CAPACITY_BASES)
    return {
        "weight": F.coalesce(~is_finite(w) | ~w.between(0, 1), F.lit(True)),
        "fractional exact weight": status.isin(*EXACT) & ~w.isin(0.0, 1.0),
        "estimated allocation without evidence": (status == "estimated_harmonisation") & ~reviewed,
    }


def problems(rows: DataFrame, population: DataFrame) -> DataFrame:
    """``(source_id, problem)``: ids on one side only, repeated destinations, lost mass."""
    per_target = rows.groupBy("source_id", "zone_id").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    source = per_target.groupBy("source_id").agg(F.abs(F.sum("weight") - 1).alias("gap"), F.max("n").alias("n"))
    ids = population.groupBy(F.col("geography_id").alias("source_id")).agg(F.lit(True).alias("populated"))
    joined = source.join(ids, "source_id", "full")
    problem = (
        F.when(F.col("n").isNull(), "population without crosswalk")
        .when(F.col("populated").isNull(), "crosswalk without population")
        .when(F.col("n") > 1, "duplicate destination")
        .when(F.col("gap") > 1e-9, "mass loss")
    )
    return joined.withColumn("problem", problem).filter("problem is not null").select("source_id", "problem")


def harmonise(population: DataFrame, rows: DataFrame) -> DataFrame:
    """Population re-keyed to zones; a source without a row fails the job.

    Weights of a source sum to 1 (:func:`problems`), so the total is preserved.
    """
    checked = guard(rows, rules()).select(F.col("source_id").alias("geography_id"), "zone_id", "weight")
    joined = population.join(checked, "geography_id", "left")
    zone = F.coalesce("zone_id", must_fail("population outside the crosswalk"))
    return joined.groupBy(zone.alias("geography_id"), "age", "sex", "nationality").agg(
        F.sum(F.col("population") * F.col("weight")).alias("population")
    )


def preserved(before: DataFrame, after: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Totals on both sides of a harmonisation and whether they agree."""
    a = before.agg(F.sum(F.col("population").cast("double")).alias("population_before"))
    b = after.agg(F.sum(F.col("population").cast("double")).alias("population_after"))
    gap = F.abs(F.col("population_before") - F.col("population_after"))
    return a.withColumn("population_after", b.scalar()).withColumn("preserved", gap <= tolerance)


def capacity_weights(sources: DataFrame, targets: DataFrame, pairs: DataFrame, buildings: DataFrame, capacity: DataFrame) -> DataFrame:
    """Residential weights against land area for sources tiled by their targets.

    ``pairs`` is (source_id, target_id); ``capacity`` is (id, capacity, vintage_ok, licensed) per
    building. Targets must lie inside their source and cover it; otherwise the job fails, since
    a building would then need a three-way clip.
    """
    sources, targets, buildings = (polygons.prepared(x) for x in (sources, targets, buildings))
    met = polygons.intersections(sources, targets)
    area = polygons.areas(targets).toDF("target_id", "target_area")
    t = pairs.join(met.toDF("source_id", "target_id", "clip"), ["source_id", "target_id"]).join(area, "target_id")
    s = polygons.areas(sources).toDF("source_id", "source_area")
    evidence = guard(capacity, {
        "residential evidence needs the same vintage and a licence": ~F.coalesce(F.col("vintage_ok") & F.col("licensed"), F.lit(False))
    })
    inside = polygons.intersections(buildings, targets).toDF("id", "target_id", "part_area")
    size = polygons.areas(buildings).toDF("id", "building_area")
    share = F.col("capacity") * F.col("part_area") / F.col("building_area")
    value = evidence.join(inside, "id").join(size, "id").groupBy("target_id").agg(F.sum(share).alias("value"))
    t = stage(t.join(value, "target_id", "left").fillna(0.0, ["value"]))
    sums = t.groupBy("source_id").agg(
        F.sum("value").alias("total"), F.sum("clip").alias("covered"),
        F.max(F.abs(F.col("clip") / F.col("target_area") - 1)).alias("sticks_out"),
    )
    sums = guard(sums.join(s, "source_id"), {
        "no residential capacity": F.col("total") <= 0,
        "targets do not cover their source": F.abs(F.col("covered") / F.col("source_area") - 1) > 1e-6,
        "targets reach outside their source": F.col("sticks_out") > 1e-6,
    })
    weight = F.col("value") / F.col("total")
    return t.join(sums, "source_id").select(
        "source_id", "target_id", weight.alias("weight"), (weight - F.col("clip") / F.col("covered")).alias("area_difference")
    )


def coverage(population: DataFrame, members: DataFrame, zones_: DataFrame, good: tuple[str, ...]) -> DataFrame:
    """Per vintage: population share in zones of good status, and ids without a counterpart.

    ``population`` is (vintage, geography_id, population); ``members`` is (vintage, id, component).
    """
    stock = population.groupBy("vintage", F.col("geography_id").alias("id")).agg(F.sum(F.col("population").cast("double")).alias("stock"))
    state = members.join(zones_.select("component", "status"), "component").select("vintage", "id", "status", F.lit(True).alias("drawn"))
    joined = state.join(stock, ["vintage", "id"], "full")
    on = F.coalesce(F.col("status").isin(*good), F.lit(False))
    return joined.groupBy("vintage").agg(
        divide(F.sum(F.when(on, F.col("stock"))), F.sum("stock")).alias("covered_share"),
        F.sum(F.when(F.col("drawn"), F.col("stock"))).alias("population_with_geometry"),
        F.count_if(F.col("drawn").isNull()).alias("population_ids_without_geometry"),
        F.count_if(F.col("stock").isNull()).alias("geometry_ids_without_population"),
    )


def one_sided(population: DataFrame, layer_ids: DataFrame) -> DataFrame:
    """Ids of a vintage found on one side only: ``(id, side)``."""
    p, g = population.select(F.col("geography_id").alias("id")).distinct(), layer_ids.select("id").distinct()
    only_p = p.join(g, "id", "left_anti").withColumn("side", F.lit("population"))
    return only_p.unionByName(g.join(p, "id", "left_anti").withColumn("side", F.lit("geometry")))


def status_mismatch(zones_: DataFrame, geographies: DataFrame) -> DataFrame:
    """Zones whose audited status differs from the supplied one."""
    supplied = geographies.select(F.col("area_id").alias("zone_id"), "boundary_status")
    joined = zones_.select("zone_id", "quality_status").join(supplied, "zone_id", "left")
    return joined.filter(~F.col("quality_status").eqNullSafe(F.col("boundary_status")))


def map_to_zones(facts: DataFrame, zone_map: DataFrame) -> DataFrame:
    """Section facts keyed by zone; unmapped rows keep a NULL zone and are counted apart."""
    return facts.join(zone_map.select(F.col("source_id").alias("geography_id"), "zone_id"), "geography_id", "left")
