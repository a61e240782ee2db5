"""Polygon layers from GeoJSON, and the checks a layer must pass before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.contracts import ContractError, guard, must_fail, unique
from cohort.functions.expressions import canonical_parent
from cohort.operators import polygons
from cohort.params import DISTRICTS

_RINGS = "array<array<array<double>>>"
FEATURES = (
    "type string, features array<struct<type:string,properties:map<string,string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections as ``(properties, kind, coordinates)``, one row per feature."""
    collections = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return features(collections)


def features(collections: DataFrame) -> DataFrame:
    each = collections.select(F.explode("features").alias("f"))
    return each.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def vertices(features_: DataFrame, id_field: str) -> DataFrame:
    """``id, part, ring, seq, x, y``; anything but polygons, and a feature without an id, fails the job."""
    polygon = F.array(F.from_json("coordinates", _RINGS))
    multi = F.from_json("coordinates", f"array<{_RINGS}>")
    parts = F.when(F.col("kind") == "Polygon", polygon).when(F.col("kind") == "MultiPolygon", multi).otherwise(
        must_fail("only polygons are accepted"))
    gid = F.coalesce(F.col("properties")[id_field], must_fail("feature without an id"))
    opened = features_.select(gid.alias("id"), F.posexplode(F.coalesce(parts, must_fail("unreadable geometry"))).alias("part", "rings"))
    rings = opened.select("id", "part", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("id", "part", "ring", F.posexplode("points").alias("seq", "p"))
    return polygons.guarded(points.select("id", "part", "ring", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")))


def feature_ids(features_: DataFrame, id_field: str) -> DataFrame:
    return features_.select(F.col("properties")[id_field].alias("id"))


def checked_layer(features_: DataFrame, id_field: str) -> DataFrame:
    """Vertices of a layer with unique ids and valid, non-empty polygons; otherwise refuse it."""
    unique(feature_ids(features_, id_field), ["id"])
    v = vertices(features_, id_field)
    bad = polygons.validity(v).filter("not valid").select("id").take(3)
    if bad:
        raise ContractError(f"invalid polygons: {[r.id for r in bad]}")
    if v.isEmpty():
        raise ContractError("empty geometry layer")
    return v


def section_rules(municipality: str, municipality_column: str = "cumun") -> dict[str, Column]:
    """Attribute rules of a section layer: (cumun, district, section, code) must agree."""
    d, s = F.col("district").try_cast("int"), F.col("section").try_cast("int")
    code = F.concat(F.lit(municipality), F.lpad(d.cast("string"), 2, "0"), F.lpad(s.cast("string"), 3, "0"))
    return {
        "district outside its range": F.coalesce(~d.between(1, DISTRICTS), F.lit(True)),
        "code components disagree": F.coalesce(F.col("code") != code, F.lit(True)),
    }


def sections(attributes: DataFrame, municipality: str) -> DataFrame:
    """Section attributes of one municipality, checked; a repeated code or a municipality without sections raises."""
    kept = guard(attributes.filter(F.col("cumun") == municipality), section_rules(municipality))
    if kept.isEmpty():
        raise ContractError(f"no sections of {municipality}")
    return unique(kept, ["code"])


def parent_layer(records: DataFrame, expected: int) -> DataFrame:
    """Canonical parent ids of a layer's records; another number of features than declared, or a repeated id, raises."""
    coded = records.withColumn("parent_id", canonical_parent(F.col("district"), F.col("barrio")))
    coded = guard(coded, {"parent code": F.col("parent_id").isNull()})
    found = records.count()
    if found != expected:
        raise ContractError(f"{found} features where the contract has {expected}")
    return unique(coded, ["parent_id"])


def collection(vertices_: DataFrame) -> DataFrame:
    """``(id, feature)``: one GeoJSON feature text per polygon, for writing as lines."""
    v = polygons.with_part(vertices_)
    ring = v.groupBy("id", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", F.array("x", "y").alias("p")))).alias("_p"))
    ring = ring.select("id", "part", "ring", F.transform("_p", lambda p: p["p"]).alias("points"))
    part = ring.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("_r"))
    part = part.select("id", "part", F.transform("_r", lambda r: r["points"]).alias("rings"))
    whole = part.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("_a"))
    parts = F.transform("_a", lambda a: a["rings"])
    head = '{"type":"Feature","properties":{"area_id":'
    single = F.concat(F.lit('"Polygon","coordinates":'), F.to_json(F.get(parts, F.lit(0))))
    several = F.concat(F.lit('"MultiPolygon","coordinates":'), F.to_json(parts))
    name = F.concat(F.lit('"'), F.replace(F.replace("id", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.concat(F.lit(head), name, F.lit('},"geometry":{"type":'), F.when(F.size("_a") == 1, single).otherwise(several), F.lit("}}"))
    return whole.select("id", body.alias("feature"))
