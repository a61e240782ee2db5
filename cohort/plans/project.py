"""Whole workflows: raw files to facts, facts to a checked bundle, boundaries to common zones.

Each returns lazy tables over a few written stages; nothing is collected but check counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.contracts import ContractError, unique
from cohort.operators import bands, controls, crosswalk, hierarchy, model, mortality, normalise, parents, polygons, profiling, qa, scenarios
from cohort.operators.staging import stage
from cohort.params import Params
from cohort.sources import sinks


@dataclass
class Bundle:
    """Named result tables of one window."""

    params: Params
    tables: dict[str, DataFrame] = field(default_factory=dict)
    reports: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str) -> list[str]:
        """Publish the tables; refused while an arithmetic check fails."""
        failed = self.reports["checks"].filter("not passed").take(3)
        if failed:
            raise ContractError(f"arithmetic checks failed: {[tuple(r) for r in failed]}")
        spark = next(iter(self.tables.values())).sparkSession
        with sinks.release(spark, folder) as out:
            for name, df in self.tables.items():
                out.write(name, df, partition_by=("level", "preset") if name == "map_indicator" else ())
            for name, df in self.reports.items():
                out.write(f"reports/{name}", df, form="json")
        return [n for n, c in out.counts.items() if c["*"] and not n.startswith("reports/")]


def enforce_tree(start: DataFrame, end: DataFrame, geographies: DataFrame, tree: hierarchy.Tree) -> None:
    """Unique keys, a sound tree and no population on both a leaf and its ancestor."""
    unique(geographies, ["area_id"])
    for population in (start, end):
        unique(population, list(model.CELL))
    lost = hierarchy.unreachable(geographies).take(3)
    if lost:
        raise ContractError(f"hierarchy: {[tuple(r) for r in lost]}")
    leaves = start.select(F.col("geography_id").alias("area_id")).unionByName(end.select(F.col("geography_id").alias("area_id")))
    mixed = hierarchy.mixed_grain(leaves, tree).take(3)
    if mixed:
        raise ContractError(f"population mixes leaves with their aggregates: {[r.area_id for r in mixed]}")


def analyse(
    start: DataFrame, end: DataFrame, qx: DataFrame, geographies: DataFrame, params: Params,
    *, published: DataFrame | None = None, variants: dict[str, DataFrame] | None = None, half_age: bool = True,
) -> Bundle:
    """Facts to results: detail, index, profile, composition, indicators, bands, checks and variants.

    ``variants`` maps a scenario name to its mortality schedule. The detail and the index are
    written once and feed every other table.
    """
    tree = hierarchy.tree(geographies)
    enforce_tree(start, end, geographies, tree)
    detail = stage(model.cohort_detail(start, end, qx, tree, params))
    index = stage(model.area_index(start, end, detail, geographies, tree, params))
    profile = model.profile(detail, params)
    composition = model.composition(start, end, tree, params)
    out = Bundle(params)
    out.tables = {
        "cohort_detail": detail,
        "area_index": index,
        "age_band_summary": bands.five_year(profile, index, params),
        "map_indicator": bands.rank(bands.indicators(profile, index, params)),
        "composition": composition,
    }
    out.reports["checks"] = stage(qa.invariants(detail, index))
    if published is not None:
        out.reports["reconciliation"] = controls.reconcile(composition, published, geographies)
    chains = {name: mortality.survival(q, params.start_year, params.end_year) for name, q in (variants or {}).items()}
    if half_age:
        chains["half_age"] = mortality.survival(qx, params.start_year, params.end_year, half_age=True)
    if chains:
        stacked = None
        for name, table in chains.items():
            one = table.withColumn("scenario", F.lit(name))
            stacked = one if stacked is None else stacked.unionByName(one)
        totals = scenarios.variant_totals(start, end, stacked, tree, params, list(chains))
        comparison = stage(scenarios.compare(index, totals))
        out.tables["sensitivities"] = comparison
        out.reports["materiality"] = scenarios.material(comparison)
    return out


def tiers(
    start: DataFrame, end: DataFrame, qx: DataFrame, geographies: DataFrame, params: Params, **options
) -> dict[str, Bundle]:
    """The inclusive run, and the exact run on areas and population of exact status only."""
    exact = scenarios.tier(geographies)
    kept = exact.select(F.col("area_id").alias("geography_id"))
    return {
        "inclusive": analyse(start, end, qx, geographies, params, **options),
        "exact": analyse(start.join(kept, "geography_id", "left_semi"), end.join(kept, "geography_id", "left_semi"), qx, exact, params, **options),
    }


@dataclass
class Zones:
    zones: DataFrame
    crosswalk: DataFrame
    overlaps: DataFrame
    start: DataFrame
    end: DataFrame
    feasibility: DataFrame


def common_zones(
    old: DataFrame, new: DataFrame, start: DataFrame, end: DataFrame, params: Params, reviews: DataFrame | None = None
) -> Zones:
    """Two boundary vintages and their populations to common zones.

    A layer that overlaps itself is refused, since union areas are taken as sums.
    """
    old, new = polygons.prepared(old), polygons.prepared(new)
    for name, layer in (("old", old), ("new", new)):
        bad = polygons.self_overlaps(layer, params.overlap_tolerance).take(3)
        if bad:
            raise ContractError(f"{name} layer overlaps itself: {[tuple(r) for r in bad]}")
    zones, met = crosswalk.overlay(old, new, params, reviews)
    zones = stage(zones)
    rows = stage(crosswalk.crosswalk(zones))
    for vintage, population in (("old", start), ("new", end)):
        bad = crosswalk.problems(rows.filter(F.col("vintage") == vintage), population).take(3)
        if bad:
            raise ContractError(f"{vintage} crosswalk: {[tuple(r) for r in bad]}")
    stock = start.select(F.lit("old").alias("vintage"), "geography_id", "population").unionByName(
        end.select(F.lit("new").alias("vintage"), "geography_id", "population"))
    return Zones(
        zones, rows, met,
        crosswalk.harmonise(start, rows.filter("vintage = 'old'")), crosswalk.harmonise(end, rows.filter("vintage = 'new'")),
        qa.feasibility(stock, rows, zones),
    )


def pooled_tree(zones: DataFrame, membership: DataFrame, labels: DataFrame, city: str) -> DataFrame:
    """Geography table over common zones, with parents pooled from both vintages' raw membership.

    ``membership`` is (vintage, section_id, district, barrio). Zone statuses come along.
    """
    ids = F.explode(F.concat(
        F.transform("old_ids", lambda i: F.struct(F.lit("old").alias("vintage"), i.alias("section_id"))),
        F.transform("new_ids", lambda i: F.struct(F.lit("new").alias("vintage"), i.alias("section_id"))),
    ))
    named = stage(zones.select("zone_id", ids.alias("_s")).select("zone_id", "_s.*").join(membership, ["vintage", "section_id"]))
    bp, bz = parents.pool(named.select("zone_id", "vintage", F.col("barrio").alias("code")), "B-")
    dp, dz = parents.pool(named.select("zone_id", "vintage", F.col("district").alias("code")), "D-")
    tree = parents.pooled_hierarchy(bz, dz, bp, dp, labels, city)
    status = zones.select(F.col("zone_id").alias("area_id"), "quality_status")
    return tree.join(status, "area_id", "left").select(
        "*", F.coalesce("quality_status", F.lit("exact_harmonisation")).alias("boundary_status")).drop("quality_status")


@dataclass
class Prepared:
    facts: DataFrame
    excluded: DataFrame
    profile: DataFrame
    snapshot: DataFrame


def prepare(wide: DataFrame, params: Params, *, total_column: str | None = None) -> Prepared:
    """A raw wide snapshot to strict facts with its exclusions and profiles."""
    facts = normalise.to_long(wide, prefix=params.prefix, total_column=total_column)
    _, excluded = normalise.split_excluded(wide)
    return Prepared(facts, excluded, profiling.facts(facts, excluded), profiling.snapshot(wide))


def research(
    snapshots: DataFrame, qx: DataFrame, tree: hierarchy.Tree, windows: Sequence[tuple[str, int, int, int]]
) -> DataFrame:
    """Area totals of many windows of dated snapshots in one job."""
    return model.window_totals(model.window_detail(snapshots, qx, tree, windows))
