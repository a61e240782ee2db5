"""Parent audits: raw membership, stability, containment, assignment and pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import guard, must_fail
from cohort.functions.expressions import divide, section_id, title_case
from cohort.operators import graph, polygons
from cohort.operators.normalise import COUNT_COLUMNS
from cohort.params import DISTRICTS, SECTION_PREFIX

UNKNOWN_BARRIO = "0000"


def raw_membership(wide: DataFrame, prefix: str = SECTION_PREFIX) -> DataFrame:
    """``(section_id, district, barrio, population)``: every declared parent, zero and blank rows too.

    Rows without a section come back under a NULL section.
    """
    d, b, s = (F.col(c).cast("int") for c in ("cod_distrito", "cod_dist_barrio", "cod_dist_seccion"))
    bad = F.coalesce(~d.between(1, DISTRICTS), F.lit(True)) | ((b != 0) & (F.floor(b / 100) != d)) | (F.floor(s / 1000) != d)
    known = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNT_COLUMNS), F.lit(0).cast("bigint"))
    return guard(wide, {"raw parent codes": F.coalesce(bad, F.lit(False))}).groupBy(
        section_id(s, prefix).alias("section_id"), F.lpad(d.cast("string"), 2, "0").alias("district"), F.lpad(b.cast("string"), 4, "0").alias("barrio")
    ).agg(F.sum(known).alias("population"))


def per_section(membership: DataFrame) -> DataFrame:
    """Known sections with their parent lists and population; a section has few parents."""
    return membership.filter("section_id is not null").groupBy("section_id").agg(
        F.array_sort(F.collect_set(F.struct("district", "barrio"))).alias("parents"), F.sum("population").alias("population")
    )


def assess(zones: DataFrame, membership: DataFrame) -> DataFrame:
    """Parent status of each zone from both vintages' raw membership.

    ``membership`` is (vintage, section_id, district, barrio). Precedence: missing, unknown
    barrio, ambiguous section, stable, reassigned, several parents.
    """
    ids = F.explode(F.concat(
        F.transform("old_ids", lambda i: F.struct(F.lit("old").alias("vintage"), i.alias("section_id"))),
        F.transform("new_ids", lambda i: F.struct(F.lit("new").alias("vintage"), i.alias("section_id"))),
    ))
    sections = zones.select("zone_id", ids.alias("_s")).select("zone_id", "_s.*")
    pairs = membership.select("vintage", "section_id", "district", "barrio").distinct()
    joined = sections.join(pairs, ["vintage", "section_id"], "left")
    each = joined.groupBy("zone_id", "vintage", "section_id").agg(
        F.count("barrio").alias("n"), F.collect_list(F.when(F.col("barrio").isNotNull(), F.struct("district", "barrio"))).alias("p")
    )

    def parents(v: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("vintage") == v, F.col("p"))))))

    z = each.groupBy("zone_id").agg(
        parents("old").alias("old_parents"), parents("new").alias("new_parents"),
        F.array_sort(F.collect_list(F.when((F.col("vintage") == "old") & (F.col("n") > 1), F.col("section_id")))).alias("ambiguous_old"),
        F.array_sort(F.collect_list(F.when((F.col("vintage") == "new") & (F.col("n") > 1), F.col("section_id")))).alias("ambiguous_new"),
        F.array_sort(F.collect_list(F.when(F.col("n") == 0, F.col("section_id")))).alias("missing"),
    )
    either = F.concat("old_parents", "new_parents")
    unknown = F.exists(either, lambda p: p["barrio"] == UNKNOWN_BARRIO)
    single = (F.size("old_parents") == 1) & (F.size("new_parents") == 1)
    stable = single & (F.col("old_parents") == F.col("new_parents")) & (F.size("missing") == 0) & ~unknown

    def districts(c: str) -> Column:
        return F.array_distinct(F.transform(c, lambda p: p["district"]))

    stable_d = (F.size(districts("old_parents")) == 1) & (districts("old_parents") == districts("new_parents")) & (F.size("missing") == 0)
    status = (
        F.when(F.size("missing") > 0, "missing_raw_membership")
        .when(unknown, "unknown_raw_barrio")
        .when((F.size("ambiguous_old") > 0) | (F.size("ambiguous_new") > 0), "ambiguous_section_membership")
        .when(stable, "stable_raw_parent_code_only")
        .when(single, "raw_parent_reassignment")
        .otherwise("multi_parent_zone")
    )
    return z.withColumns({"raw_parent_status": status, "stable_parent": stable, "stable_district": stable_d})


def containment(
    sections: DataFrame, layer: DataFrame, declared: DataFrame, population: DataFrame, tolerance: float = 1e-3
) -> DataFrame:
    """Share of each section outside its declared parents ``(section_id, parent_id)``.

    Only declared pairs are measured. Parents of one layer must not overlap each other.
    """
    sections, layer = polygons.prepared(sections), polygons.prepared(layer)
    pairs = declared.select("section_id", "parent_id").distinct()
    known = layer.select(F.col("id").alias("parent_id"), F.lit(1).alias("_k")).distinct()
    found = polygons.candidates(sections, layer).join(
        pairs.select(F.col("section_id").alias("a"), F.col("parent_id").alias("b")), ["a", "b"], "left_semi"
    )
    inside = polygons.intersections(sections, layer, found).toDF("section_id", "parent_id", "inside")
    per = pairs.join(known, "parent_id", "left").join(inside, ["section_id", "parent_id"], "left").groupBy("section_id").agg(
        F.array_sort(F.collect_list("parent_id")).alias("parent_ids"),
        F.count_if(F.col("_k").isNull()).alias("lost"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"),
    )
    size = polygons.areas(sections).toDF("section_id", "area")
    stock = population.select("section_id", "population")
    joined = size.join(per, "section_id", "left").join(stock, "section_id", "left")
    none = F.col("parent_ids").isNull() | (F.col("lost") > 0)
    outside = 1 - divide(F.col("inside"), F.col("area"))
    status = F.when(none, "missing_parent").when(outside <= tolerance, "contained_candidate").otherwise("outside_declared_parent")
    return joined.select(
        "section_id", F.coalesce("parent_ids", F.array().cast("array<string>")).alias("parent_ids"), status.alias("status"),
        F.when(~none, outside).alias("outside_area_ratio"), F.coalesce("population", F.lit(0)).alias("known_population"),
        F.when(~none, F.size("parent_ids") > 1).alias("ambiguous_parent"),
    )


def candidate_summary(reviewed: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Per candidate layer and status: sections, population, exceptions, largest outside ratio."""
    exception = (F.col("status") != "contained_candidate") | F.coalesce("ambiguous_parent", F.lit(False))
    return reviewed.groupBy(by, "status").agg(
        F.count(F.lit(1)).alias("sections"), F.sum("known_population").alias("known_population"),
        F.count_if(exception).alias("exceptions"), F.max(F.coalesce("outside_area_ratio", F.lit(0.0))).alias("maximum_outside_ratio"),
    )


def assign(zones: DataFrame, old: DataFrame, new: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``(zone_id, parents)``: parents equal in both vintages that hold the zone; one is needed.

    ``zones`` is a vertex table. :func:`assigned` turns it into a checked assignment.
    """
    zones, old, new = (polygons.prepared(x) for x in (zones, old, new))
    a0, a1 = polygons.areas(old).toDF("parent", "old_area"), polygons.areas(new).toDF("parent", "new_area")
    met = polygons.intersections(old, new).filter("a = b").select(F.col("a").alias("parent"), F.col("area").alias("shared"))
    symmetric = divide(F.col("old_area") + F.col("new_area") - 2 * F.col("shared"), F.greatest("old_area", "new_area"))
    equal = met.join(a0, "parent").join(a1, "parent").filter(symmetric <= tolerance).select("parent")
    size = polygons.areas(zones).toDF("zone_id", "zone_area")
    in0 = polygons.intersections(zones, old).toDF("zone_id", "parent", "in_old")
    in1 = polygons.intersections(zones, new).toDF("zone_id", "parent", "in_new")
    nested = in0.join(in1, ["zone_id", "parent"]).join(size, "zone_id")
    outside = 1 - divide(F.least("in_old", "in_new"), F.col("zone_area"))
    held = nested.filter(outside <= tolerance).join(equal, "parent", "left_semi").select("zone_id", "parent")
    possible = held.groupBy("zone_id").agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    out = size.select("zone_id").join(possible, "zone_id", "left")
    return out.select("zone_id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def assigned(possible: DataFrame) -> DataFrame:
    """Exactly one possible parent per zone, or the job fails."""
    one = F.when(F.size("parents") == 1, F.get("parents", F.lit(0))).otherwise(must_fail("zone without one harmonised parent"))
    return possible.select("zone_id", one.alias("parent_id"))


def layer_validity(layers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Whether each candidate layer is verified for each endpoint of its own ``target`` key.

    ``layers`` has (candidate_id, target, verified, evidence, valid_from, valid_to) as text dates.
    """
    start, end = F.try_to_date("valid_from"), F.try_to_date("valid_to")
    proven = F.coalesce(F.col("verified"), F.lit(False)) & (F.coalesce("evidence", F.lit("")) != "")
    joined = layers.join(endpoints, "target")
    usable = proven & F.coalesce(F.col("endpoint").between(start, end), F.lit(False))
    return joined.select("candidate_id", "endpoint", usable.alias("usable"))


def pool(zone_members: DataFrame, level_prefix: str) -> tuple[DataFrame, DataFrame]:
    """Pooled parents and each zone's pool.

    ``zone_members`` is (zone_id, vintage, code). Parents named by one zone are linked through
    their smallest code, which joins the same components as linking all of them pairwise, with
    one edge per member.
    """
    node = F.concat_ws("|", "vintage", "code")
    members = zone_members.select("zone_id", "code", node.alias("node")).distinct()
    hub = members.groupBy("zone_id").agg(F.min("node").alias("hub"))
    linked = members.join(hub, "zone_id")
    edges = linked.select(F.col("node").alias("src"), F.col("hub").alias("dst")).filter("src <> dst").distinct()
    nodes = members.select("node", "code").distinct()
    found = nodes.join(graph.components(edges, nodes.select("node").distinct()), "node")
    codes = found.groupBy("component").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    pools = codes.withColumn("pool_id", F.concat(F.lit(level_prefix), F.array_join("codes", "+")))
    names = found.select("node", "component").join(pools.select("component", "pool_id"), "component").select("node", "pool_id")
    zones = hub.join(names, F.col("hub") == F.col("node")).select("zone_id", "pool_id")
    return pools.select("pool_id", "codes"), zones


def pooled_hierarchy(zone_barrio: DataFrame, zone_district: DataFrame, barrios: DataFrame, districts: DataFrame, labels: DataFrame, city: str) -> DataFrame:
    """Zones → pooled barrio → pooled district → city as a geography table.

    ``labels`` is (level, code, name). A pooled barrio in two pooled districts fails the job.
    """
    both = zone_barrio.withColumnRenamed("pool_id", "barrio_id").join(zone_district.withColumnRenamed("pool_id", "district_id"), "zone_id")
    lift = both.groupBy("barrio_id").agg(F.min("district_id").alias("low"), F.max("district_id").alias("high"))
    lift = guard(lift, {"pooled barrio crosses districts": F.col("low") != F.col("high")})

    def named(pools: DataFrame, level: str) -> DataFrame:
        parts = pools.select("pool_id", F.posexplode("codes").alias("pos", "code")).join(
            labels.filter(F.col("level") == level).select("code", "name"), "code", "left"
        )
        joined = parts.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "code").alias("n")))).alias("n"))
        return joined.select("pool_id", F.array_join(F.transform("n", lambda x: x["n"]), " + ").alias("name"))

    b = named(barrios, "barrio").join(lift, F.col("pool_id") == F.col("barrio_id")).select(
        F.col("pool_id").alias("area_id"), "name", F.lit("barrio").alias("level"), F.col("low").alias("parent_id"))
    d = named(districts, "district").select(F.col("pool_id").alias("area_id"), "name", F.lit("district").alias("level"), F.lit(city).alias("parent_id"))
    z = both.select(F.col("zone_id").alias("area_id"), F.concat(F.lit("Zone "), "zone_id").alias("name"), F.lit("section").alias("level"), F.col("barrio_id").alias("parent_id"))
    root = d.limit(1).select(F.lit(city).alias("area_id"), F.lit(city).alias("name"), F.lit("city").alias("level"), F.lit(None).cast("string").alias("parent_id"))
    return z.unionByName(b).unionByName(d).unionByName(root)


def last_labels(raw: DataFrame) -> DataFrame:
    """``(level, code, name)``: the label of the last raw row of each code, in title case."""
    return raw.groupBy("level", "code").agg(title_case(F.max_by("label", "row_number")).alias("name"))


def review_accounting(zones: DataFrame, assessed: DataFrame, population: DataFrame, missing_section: DataFrame) -> DataFrame:
    """Per vintage: mapped, unmapped and section-less population, which must add up to the total.

    ``population`` is (vintage, section_id, population) and ``missing_section`` (vintage, population).
    """
    ids = F.explode(F.concat(
        F.transform("old_ids", lambda i: F.struct(F.lit("old").alias("vintage"), i.alias("section_id"))),
        F.transform("new_ids", lambda i: F.struct(F.lit("new").alias("vintage"), i.alias("section_id"))),
    ))
    z = zones.select("zone_id", "classification", ids.alias("_s")).select("zone_id", "classification", "_s.*")
    z = z.join(assessed.select("zone_id", "stable_parent"), "zone_id")
    joined = population.join(z, ["vintage", "section_id"], "left")

    def stock(on: Column) -> Column:
        return F.coalesce(F.sum(F.when(on, F.col("population"))), F.lit(0))

    mapped = F.col("zone_id").isNotNull()
    sums = joined.groupBy("vintage").agg(
        stock(mapped).alias("mapped"), stock(~mapped).alias("exceptions"), F.sum("population").alias("with_section"),
        stock(mapped & F.col("stable_parent")).alias("parent_stable"), stock(F.col("classification") == "unchanged").alias("unchanged"),
    )
    out = sums.join(missing_section.select("vintage", F.col("population").alias("missing_section")), "vintage", "left").fillna(0, ["missing_section"])
    total = F.col("with_section") + F.col("missing_section")
    out = out.withColumn("total", total)
    out = guard(out, {"component population accounting": F.col("mapped") + F.col("exceptions") + F.col("missing_section") != F.col("total")})
    return out.withColumn("parent_stable_share", divide(F.col("parent_stable"), F.col("total"))).drop("with_section")


def review_counts(zones: DataFrame, assessed: DataFrame) -> DataFrame:
    """Zones by class and parent status, with cross-district and largest-ratio figures."""
    joined = zones.join(assessed, "zone_id")
    return joined.groupBy("classification", "raw_parent_status").agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(~F.col("stable_district")).alias("cross_district"),
        F.max("symmetric_difference_ratio").alias("maximum_ratio"),
    )


def exceptions(zones: DataFrame, assessed: DataFrame) -> DataFrame:
    """Zones to look at: changed, or with an unstable parent; unstable first, then id."""
    joined = zones.select("zone_id", "classification").join(assessed.select("zone_id", "stable_parent", "raw_parent_status"), "zone_id")
    return joined.filter((F.col("classification") != "unchanged") | ~F.col("stable_parent")).orderBy("stable_parent", "zone_id")
