"""Polygon measures on a vertex table: areas, overlaps, validity, boundaries, projection.

Input is one row per vertex, ``id, part, ring, seq, x, y`` with closed rings (ring 0 is the
shell, the rest are holes) and consecutive ``seq``. Coordinates are planar metres unless said
otherwise. Neighbouring vertices are joined by ``seq``, so a polygon of any size is spread over
the cluster and never sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.contracts import guard
from cohort.functions.expressions import divide
from cohort.operators.ordering import running_sum
from cohort.operators.spatial import Partition, overlap_join, partition_of
from cohort.operators.staging import stage

RING = ("id", "part", "ring")


def with_part(vertices: DataFrame) -> DataFrame:
    return vertices if "part" in vertices.columns else vertices.withColumn("part", F.lit(0))


def edges(layer: DataFrame) -> DataFrame:
    """``id, part, ring, seq, xa, ya, xb, yb``: consecutive vertices of closed rings.

    A table that already has edges passes through, so a layer can be prepared once (:func:`prepared`).
    """
    if "xa" in layer.columns:
        return layer
    v = with_part(layer)
    tail = v.select(*RING, (F.col("seq") - 1).alias("seq"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    return v.select(*RING, "seq", F.col("x").alias("xa"), F.col("y").alias("ya")).join(tail, [*RING, "seq"])


def prepared(layer: DataFrame) -> DataFrame:
    """The written edge table of a layer, for callers that use the layer several times."""
    return layer if "xa" in layer.columns else stage(edges(layer))


def boxes(layer: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Extent of each polygon; rings are closed, so edge starts visit every vertex."""
    x, y = ("xa", "ya") if "xa" in layer.columns else ("x", "y")
    return layer.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def _rings(layer: DataFrame) -> DataFrame:
    """Doubled signed area per ring."""
    cross = (F.col("xa") - F.col("xb")) * (F.col("ya") + F.col("yb"))
    return edges(layer).groupBy(*RING).agg(F.sum(cross).alias("twice"))


def _moments(layer: DataFrame) -> DataFrame:
    """Per ring: doubled area and first moments about the polygon's own low corner."""
    e = edges(layer)
    e = e.join(e.groupBy("id").agg(F.min("xa").alias("ox"), F.min("ya").alias("oy")), "id")
    xa, ya = F.col("xa") - F.col("ox"), F.col("ya") - F.col("oy")
    xb, yb = F.col("xb") - F.col("ox"), F.col("yb") - F.col("oy")
    cross = xa * yb - xb * ya
    return e.groupBy(*RING).agg(
        F.sum(cross).alias("twice"), F.sum((xa + xb) * cross).alias("mx"), F.sum((ya + yb) * cross).alias("my"),
        F.first("ox").alias("ox"), F.first("oy").alias("oy"),
    )


def _weight(ring: str = "ring", area: str = "twice") -> Column:
    """Shells count positive and holes negative, whatever way round they were drawn."""
    return F.when(F.col(ring) == 0, 1.0).otherwise(-1.0) * F.signum(area)


def measures(vertices: DataFrame) -> DataFrame:
    """``id, area, cx, cy, x0, y0, x1, y1``."""
    m = _moments(vertices).withColumn("w", _weight())
    sums = m.groupBy("id").agg(
        (F.sum(F.col("w") * F.col("twice")) / 2).alias("area"),
        F.sum(F.col("w") * F.col("mx")).alias("sx"), F.sum(F.col("w") * F.col("my")).alias("sy"),
        F.first("ox").alias("ox"), F.first("oy").alias("oy"),
    )
    centred = sums.select(
        "id", "area",
        (F.col("ox") + divide(F.col("sx"), 6 * F.col("area"))).alias("cx"),
        (F.col("oy") + divide(F.col("sy"), 6 * F.col("area"))).alias("cy"),
    )
    return centred.join(boxes(vertices), "id")


def areas(vertices: DataFrame) -> DataFrame:
    return _rings(vertices).groupBy("id").agg((F.sum(_weight() * F.col("twice")) / 2).alias("area"))


def ring_signs(vertices: DataFrame) -> DataFrame:
    """``id, part, ring, sign``: what one unit under a ring's edges adds to the polygon."""
    return _rings(vertices).select(*RING, (-_weight()).alias("sign"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of polygons whose boxes overlap with positive area: ``a, b`` and the shared box."""
    met = overlap_join(boxes(left), boxes(right), [])
    out = met.select(
        F.col("l_id").alias("a"), F.col("r_id").alias("b"),
        F.greatest("l_x0", "r_x0").alias("x0"), F.least("l_x1", "r_x1").alias("x1"),
        F.greatest("l_y0", "r_y0").alias("y0"), F.least("l_y1", "r_y1").alias("y1"),
        F.least("l_y0", "r_y0").alias("base"),
    )
    return out.filter("x1 > x0 and y1 > y0")


def _pair_edges(pairs: DataFrame, side: str, layer: DataFrame, strips: Partition) -> DataFrame:
    """Edges of one side cut to the x-range of each pair they matter to; heights are measured from the pair's base."""
    e = edges(layer).filter("xa <> xb")
    e = e.select(
        F.col("id").alias(side), "part", "ring",
        F.least("xa", "xb").alias("x0"), F.greatest("xa", "xb").alias("x1"),
        F.when(F.col("xa") < F.col("xb"), F.col("ya")).otherwise(F.col("yb")).alias("y_low"),
        ((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"),
        F.when(F.col("xa") < F.col("xb"), 1.0).otherwise(-1.0).alias("turn"),
    )
    met = overlap_join(pairs.select("a", "b", "x0", "x1", "base"), e, [side], ("x",), strips)
    low, high = F.greatest("l_x0", "r_x0"), F.least("l_x1", "r_x1")
    at = F.col("r_y_low") + (low - F.col("r_x0")) * F.col("r_slope") - F.col("l_base")
    return met.filter(low < high).select(
        F.col("l_a").alias("a"), F.col("l_b").alias("b"), F.col("r_part").alias("part"), F.col("r_ring").alias("ring"),
        low.alias("x0"), high.alias("x1"),
        at.alias("y"), F.col("r_slope").alias("slope"), F.col("r_turn").alias("turn"),
    )


def _pieces(met: DataFrame) -> DataFrame:
    """``piece``: signed area under the lower of two edges on their shared x-range.

    Heights at both ends come first, as columns, so that no expression is repeated; two edges
    cross at most once.
    """
    low, high = F.greatest("l_x0", "r_x0"), F.least("l_x1", "r_x1")
    d = met.withColumns({"low": low, "width": high - low})
    d = d.withColumns({
        "ya": F.col("l_y") + (F.col("low") - F.col("l_x0")) * F.col("l_slope"),
        "yb": F.col("r_y") + (F.col("low") - F.col("r_x0")) * F.col("r_slope"),
    })
    d = d.withColumns({"za": F.col("ya") + F.col("width") * F.col("l_slope"), "zb": F.col("yb") + F.col("width") * F.col("r_slope")})
    d = d.withColumns({"first": F.least("ya", "yb"), "last": F.least("za", "zb"), "gap": F.col("ya") - F.col("yb"), "end_gap": F.col("za") - F.col("zb")})
    d = d.withColumn("t", F.when(F.col("gap") * F.col("end_gap") < 0, F.col("gap") / (F.col("gap") - F.col("end_gap"))))
    d = d.withColumn("y", F.col("ya") + F.col("t") * (F.col("za") - F.col("ya")))
    crossed = F.col("t") * (F.col("first") + F.col("y")) + (1 - F.col("t")) * (F.col("y") + F.col("last"))
    mean = F.coalesce(crossed, F.col("first") + F.col("last")) / 2
    return d.withColumn("piece", F.col("l_turn") * F.col("r_turn") * F.col("width") * mean)


def intersections(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(a, b, area)`` for each candidate pair, exact for simple polygons with holes.

    A polygon is the signed sum of the strips under its edges, so the overlap is the signed sum,
    over edge pairs that share an x-range, of the area under the lower edge. Edge pairs come from
    an interval join inside each polygon pair, so the work follows the edges that meet and not
    the product of two boundaries. Ring signs are applied after the sums, on one row per ring pair.
    """
    left, right = prepared(left), prepared(right)
    found = stage(candidates(left, right) if pairs is None else pairs)
    spans = [e.select(F.least("xa", "xb").alias("x0"), F.greatest("xa", "xb").alias("x1")) for e in (left, right)]
    strips = partition_of(*spans, ("x",))
    ea, eb = _pair_edges(found, "a", left, strips), _pair_edges(found, "b", right, strips)
    met = overlap_join(ea, eb, ["a", "b"], ("x",), strips)
    rings = (
        _pieces(met)
        .groupBy(
            F.col("l_a").alias("a"), F.col("l_b").alias("b"),
            F.col("l_part").alias("part_a"), F.col("l_ring").alias("ring_a"),
            F.col("r_part").alias("part_b"), F.col("r_ring").alias("ring_b"),
        )
        .agg(F.sum("piece").alias("area"))
    )
    sa = ring_signs(left).toDF("a", "part_a", "ring_a", "sign_a")
    sb = ring_signs(right).toDF("b", "part_b", "ring_b", "sign_b")
    signed = rings.join(sa, ["a", "part_a", "ring_a"]).join(sb, ["b", "part_b", "ring_b"])
    return signed.groupBy("a", "b").agg(F.sum(F.col("sign_a") * F.col("sign_b") * F.col("area")).alias("area"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every pair with its area, both polygon areas and the two shares."""
    old, new = prepared(old), prepared(new)
    a = areas(old).select(F.col("id").alias("a"), F.col("area").alias("area_a"))
    b = areas(new).select(F.col("id").alias("b"), F.col("area").alias("area_b"))
    joined = intersections(old, new).join(a, "a").join(b, "b")
    return joined.select(
        F.col("a").alias("old_id"), F.col("b").alias("new_id"), "area", "area_a", "area_b",
        divide(F.col("area"), F.col("area_a")).alias("old_share"), divide(F.col("area"), F.col("area_b")).alias("new_share"),
    )


def self_overlaps(layer: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Pairs of one layer that overlap by more than the tolerated share of the smaller polygon."""
    layer = prepared(layer)
    pairs = candidates(layer, layer).filter("a < b")
    size = areas(layer)
    met = intersections(layer, layer, pairs)
    met = met.join(size.toDF("a", "area_a"), "a").join(size.toDF("b", "area_b"), "b")
    limit = tolerance * F.least("area_a", "area_b")
    return met.filter(F.col("area") > limit).select("a", "b", F.col("area").alias("overlap_area"))


def topology(layer: DataFrame, municipality: DataFrame) -> DataFrame:
    """One row: union area, gap inside and area outside the enclosing polygon.

    The union is the sum of the areas, which holds once :func:`self_overlaps` is empty.
    """
    layer, municipality = prepared(layer), prepared(municipality)
    total = areas(layer).agg(F.sum("area").alias("union_area"), F.count(F.lit(1)).alias("polygons"))
    inside = intersections(layer, municipality).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("inside"))
    outer = areas(municipality).agg(F.sum("area").alias("outer"))
    return total.withColumn("inside", inside.scalar()).withColumn("outer", outer.scalar()).select(
        "polygons", "union_area",
        (F.col("outer") - F.col("inside")).alias("gap_area"),
        (F.col("union_area") - F.col("inside")).alias("outside_area"),
    )


def validity(vertices: DataFrame) -> DataFrame:
    """Per polygon: open rings, flat rings and proper edge crossings; valid when none occur."""
    v = with_part(vertices)
    ends = v.groupBy(*RING).agg(
        F.min_by(F.struct("x", "y"), "seq").alias("first"), F.max_by(F.struct("x", "y"), "seq").alias("last"),
        F.count(F.lit(1)).alias("vertices"),
    )
    open_rings = ends.groupBy("id").agg(F.count_if((F.col("first") != F.col("last")) | (F.col("vertices") < 4)).alias("open_rings"))
    flat = _rings(v).groupBy("id").agg(F.count_if(F.col("twice") == 0).alias("flat_rings"))
    e = edges(v).withColumns({
        "x0": F.least("xa", "xb"), "x1": F.greatest("xa", "xb"), "y0": F.least("ya", "yb"), "y1": F.greatest("ya", "yb"),
    })
    e = e.withColumn("key", F.struct("part", "ring", "seq"))
    met = overlap_join(e, e.select("id", "key", "xa", "ya", "xb", "yb", "x0", "x1", "y0", "y1"), ["id"])

    def side(o: str, p: str, q: str) -> Column:
        x, y = F.col(f"{q[0]}_x{q[1]}"), F.col(f"{q[0]}_y{q[1]}")
        ox, oy, px, py = F.col(f"{o[0]}_x{o[1]}"), F.col(f"{o[0]}_y{o[1]}"), F.col(f"{p[0]}_x{p[1]}"), F.col(f"{p[0]}_y{p[1]}")
        return F.signum((px - ox) * (y - oy) - (py - oy) * (x - ox))

    crosses = (side("la", "lb", "ra") * side("la", "lb", "rb") < 0) & (side("ra", "rb", "la") * side("ra", "rb", "lb") < 0)
    crossings = met.filter(F.col("l_key") < F.col("r_key")).groupBy(F.col("l_id").alias("id")).agg(F.count_if(crosses).alias("crossings"))
    joined = open_rings.join(flat, "id", "left").join(crossings, "id", "left").fillna(0, ["flat_rings", "crossings"])
    return joined.withColumn("valid", (F.col("open_rings") == 0) & (F.col("flat_rings") == 0) & (F.col("crossings") == 0))


def quantise(vertices: DataFrame, grid: int = 100_000) -> DataFrame:
    """Integer grid coordinates and the step from the previous vertex of the ring."""
    v = with_part(vertices)
    frame = v.agg(F.struct(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))).scalar()
    v = v.withColumn("_f", frame)

    def on_grid(axis: str) -> Column:
        low, span = F.col(f"_f.{axis}0"), F.col(f"_f.{axis}1") - F.col(f"_f.{axis}0")
        scale = F.when(span == 0, 1.0).otherwise(span / (grid - 1))
        return F.rint((F.col(axis) - low) / scale).cast("bigint")

    q = v.select(*RING, "seq", on_grid("x").alias("gx"), on_grid("y").alias("gy"))
    before = q.select(*RING, (F.col("seq") + 1).alias("seq"), F.col("gx").alias("px"), F.col("gy").alias("py"))
    joined = q.join(before, [*RING, "seq"], "left")
    zero = F.lit(0)
    return joined.select(
        *RING, "seq", (F.col("gx") - F.coalesce("px", zero)).alias("dx"), (F.col("gy") - F.coalesce("py", zero)).alias("dy")
    )


def restore(deltas: DataFrame, frame: tuple[float, float, float, float], grid: int = 100_000) -> DataFrame:
    """Coordinates from ring deltas; ``frame`` is (x0, y0, x1, y1) of the encoded layer."""
    x0, y0, x1, y1 = frame
    sx, sy = (x1 - x0) / (grid - 1) or 1.0, (y1 - y0) / (grid - 1) or 1.0
    summed = running_sum(deltas, list(RING), "seq", ["dx", "dy"])
    return summed.select(*RING, "seq", (F.col("sum_dx") * sx + x0).alias("x"), (F.col("sum_dy") * sy + y0).alias("y"))


# GRS80 ellipsoid and the UTM zone 30 north grid (EPSG:25830).
_A, _F = 6378137.0, 1 / 298.257222101
_K0, _FE, _LON0 = 0.9996, 500_000.0, math.radians(-3.0)


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius and the Krüger coefficients to third order in n (Karney 2011)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    to_lat = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, forward, inverse, to_lat


def to_lonlat(vertices: DataFrame) -> DataFrame:
    """UTM 30N metres to longitude and latitude degrees, as plain column arithmetic."""
    radius, _, inverse, to_lat = _series()
    xi, eta = F.col("y") / (_K0 * radius), (F.col("x") - _FE) / (_K0 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(inverse, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(to_lat, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.atan2(F.sinh(eta1), F.cos(xi1)) + _LON0
    return vertices.withColumns({"lon": F.degrees(lon), "lat": F.degrees(lat)})


def from_lonlat(vertices: DataFrame) -> DataFrame:
    """Longitude and latitude degrees to UTM 30N metres."""
    radius, forward, _, _ = _series()
    n = _F / (2 - _F)
    e = 2 * math.sqrt(n) / (1 + n)
    lat, lon = F.radians("lat"), F.radians("lon") - _LON0
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi1 = F.atan2(t, F.cos(lon))
    eta1 = F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(forward, 1):
        xi = xi + a * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + a * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    return vertices.withColumns({"x": _FE + _K0 * radius * eta, "y": _K0 * radius * xi})


def guarded(vertices: DataFrame) -> DataFrame:
    """Fail on vertices that are not finite numbers."""
    bad = F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    return guard(vertices, {"finite coordinates": F.coalesce(bad, F.lit(True))})
