"""Areas, overlaps, components and weights against shapes with known answers."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from cohort.operators import crosswalk, dissolve, graph, ordering, parents, polygons, spatial
from cohort.params import Params
from cohort.plans import project
from cohort.sources import layers, sinks

from conftest import rows

VERTEX = "id string, part int, ring int, seq int, x double, y double"
P = Params()


def shapes(spark, **named):
    """Polygons from point lists; a list of lists is shell and holes."""
    out = []
    for name, points in named.items():
        rings = points if isinstance(points[0], list) else [points]
        for r, ring in enumerate(rings):
            closed = [*ring, ring[0]]
            out += [(name, 0, r, i, float(x), float(y)) for i, (x, y) in enumerate(closed)]
    return spark.createDataFrame(out, VERTEX)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def circle(cx, cy, r, n):
    return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]


def one(df):
    return {(r.a, r.b): r.area for r in df.collect()}


def test_overlap_of_nonconvex_shapes_and_holes(spark):
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    left = shapes(spark, ell=ell, ring=[box(10, 0, 20, 10), box(13, 3, 17, 7)], turned=list(reversed(box(30, 0, 32, 2))))
    right = shapes(spark, square=box(0.5, 0.5, 3, 3), centre=box(12, 2, 18, 8), diamond=[(31, -1), (33, 1), (31, 3), (29, 1)])
    got = one(polygons.intersections(left, right))
    assert got[("ell", "square")] == pytest.approx(0.5 * 2.5 + 0.5 * 2.0)
    assert got[("ring", "centre")] == pytest.approx(36 - 16)
    assert got[("turned", "diamond")] == pytest.approx(4.0)
    sizes = {r.id: r.area for r in polygons.areas(left).collect()}
    assert sizes == pytest.approx({"ell": 7.0, "ring": 84.0, "turned": 4.0})


def test_overlap_of_shapes_with_many_vertices(spark):
    n, r, d = 3000, 100.0, 120.0
    got = one(polygons.intersections(shapes(spark, a=circle(440000, 4470000, r, n)), shapes(spark, b=circle(440000 + d, 4470000, r, n))))
    lens = 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)
    assert got[("a", "b")] == pytest.approx(lens, rel=1e-5)


def test_small_and_large_polygons_meet(spark):
    small = shapes(spark, **{f"s{i}": box(i * 3, 5, i * 3 + 1, 6) for i in range(50)})
    large = shapes(spark, big=box(-1000, -1000, 100.5, 1000), tiny=box(0.25, 5.25, 0.5, 5.5))
    got = one(polygons.intersections(small, large))
    assert len([k for k in got if k[1] == "big" and got[k] > 0]) == 34
    assert got[("s33", "big")] == pytest.approx(1.0) and got[("s0", "tiny")] == pytest.approx(0.0625)


def test_overlap_join_equals_brute_force(spark):
    boxes = [(f"i{i}", (i * 37 % 101) / 7.0, (i * 53 % 97) / 5.0, (i % 7) ** 2 / 3.0, (i % 5) ** 2 / 2.0) for i in range(120)]
    df = spark.createDataFrame([(n, x, y, x + w, y + h) for n, x, y, w, h in boxes], "id string, x0 double, y0 double, x1 double, y1 double")
    got = rows(spatial.overlap_join(df, df, []), "l_id", "r_id")
    plain = sorted((a[0], b[0]) for a in boxes for b in boxes
                   if a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4])
    assert got == plain


def test_self_overlap_gap_and_outside(spark):
    layer = shapes(spark, a=box(0, 0, 10, 10), b=box(9, 0, 19, 10), c=box(30, 0, 40, 10))
    assert rows(polygons.self_overlaps(layer), "a", "b", "overlap_area") == [("a", "b", 10.0)]
    whole = polygons.topology(shapes(spark, a=box(0, 0, 10, 10), b=box(10, 0, 21, 10)), shapes(spark, city=box(0, 0, 20, 11))).head()
    assert (whole.union_area, whole.gap_area, whole.outside_area) == pytest.approx((210, 20, 10))


def test_centroid_with_a_hole_and_far_origin(spark):
    far = [[(x + 440000, y + 4470000) for x, y in ring] for ring in (box(0, 0, 10, 10), box(5, 0, 10, 10))]
    m = polygons.measures(shapes(spark, half=far)).head()
    assert (m.area, m.cx - 440000, m.cy - 4470000) == pytest.approx((50, 2.5, 5), abs=1e-6)


def test_validity(spark):
    bow = [(0, 0), (4, 4), (4, 0), (0, 5)]
    layer = shapes(spark, good=box(0, 0, 1, 1), bow=bow).unionByName(shapes(spark, open=box(5, 5, 6, 6)).filter("seq < 4"))
    assert rows(polygons.validity(layer), "id", "open_rings", "crossings", "valid") == [("bow", 0, 1, False), ("good", 0, 0, True), ("open", 1, 0, False)]


def test_projection_round_trip_and_known_point(spark):
    point = spark.createDataFrame([(-3.7038, 40.4168), (-3.0, 0.0)], "lon double, lat double")
    xy = polygons.from_lonlat(point)
    first, second = xy.collect()
    assert (first.x, first.y) == pytest.approx((440293, 4474256), abs=30)
    assert (second.x, second.y) == pytest.approx((500000, 0), abs=1e-6)
    back = polygons.to_lonlat(xy.drop("lon", "lat")).collect()[0]
    assert (back.lon, back.lat) == pytest.approx((-3.7038, 40.4168), abs=1e-9)


def test_boundary_and_quantised_round_trip(spark):
    layer = shapes(spark, a=box(0, 0, 10, 10), b=box(10, 0, 20, 10))
    groups = spark.createDataFrame([("a", "z"), ("b", "z")], "id string, group_id string")
    assert dissolve.boundary(layer, groups).count() == 6
    back = polygons.restore(polygons.quantise(layer), (0, 0, 20, 10)).join(layer.withColumnsRenamed({"x": "x_in", "y": "y_in"}), ["id", "part", "ring", "seq"])
    worst = back.agg(F.max(F.abs(F.col("x") - F.col("x_in"))).alias("dx"), F.max(F.abs(F.col("y") - F.col("y_in"))).alias("dy")).head()
    assert worst.dx < 2e-4 and worst.dy < 2e-4


def zones_of(spark, old, new):
    z, _ = crosswalk.overlay(shapes(spark, **old), shapes(spark, **new), P)
    return {(tuple(r.old_ids), tuple(r.new_ids)): r for r in z.collect()}


def test_component_classes(spark):
    got = zones_of(
        spark,
        {"same": box(0, 0, 10, 10), "old": box(20, 0, 30, 10), "whole": box(40, 0, 60, 10), "left": box(70, 0, 80, 10), "right": box(80, 0, 90, 10),
         "moved": box(100, 0, 110, 10), "gone": box(200, 0, 210, 10)},
        {"same": box(0, 0, 10, 10), "fresh": box(20, 0, 30, 10), "w1": box(40, 0, 50, 10), "w2": box(50, 0, 60, 10), "joined": box(70, 0, 90, 10),
         "moved": box(101, 0, 111, 10), "added": box(300, 0, 310, 10)})
    kinds = {k: v.classification for k, v in got.items()}
    assert kinds == {
        (("same",), ("same",)): "unchanged", (("old",), ("fresh",)): "renumbered", (("whole",), ("w1", "w2")): "split",
        (("left", "right"), ("joined",)): "merged", (("moved",), ("moved",)): "materially_redrawn", (("gone",), ()): "missing", ((), ("added",)): "extra"}
    moved = got[(("moved",), ("moved",))]
    assert moved.symmetric_difference_ratio == pytest.approx(0.2) and moved.quality_status == "unreliable" and moved.requires_review
    assert got[(("whole",), ("w1", "w2"))].zone_id.startswith("Z-") and got[(("same",), ("same",))].zone_id == "same"


def test_workflow_to_common_zones(spark):
    old, new = shapes(spark, a=box(0, 0, 10, 10)), shapes(spark, a1=box(0, 0, 5, 10), a2=box(5, 0, 10, 10))
    cell = "geography_id string, age int, sex string, nationality string, population bigint"
    start = spark.createDataFrame([("a", 30, "male", "ESP", 10)], cell)
    end = spark.createDataFrame([("a1", 40, "male", "ESP", 6), ("a2", 40, "male", "ESP", 5)], cell)
    z = project.common_zones(old, new, start, end, P)
    assert z.end.head().population == 11 and z.start.head().geography_id == z.end.head().geography_id
    assert z.feasibility.head().exact_population_share == 1.0
    with pytest.raises(Exception, match="overlaps itself"):
        project.common_zones(old, shapes(spark, a1=box(0, 0, 7, 10), a2=box(5, 0, 10, 10)), start, end, P)
    with pytest.raises(Exception, match="population without crosswalk"):
        project.common_zones(old, new, start, end.withColumn("geography_id", F.lit("x")), P)


def test_capacity_weights(spark):
    source, targets = shapes(spark, s=box(0, 0, 10, 10)), shapes(spark, l=box(0, 0, 5, 10), r=box(5, 0, 10, 10))
    pairs = spark.createDataFrame([("s", "l"), ("s", "r")], "source_id string, target_id string")
    buildings = shapes(spark, b1=box(1, 1, 2, 2), b2=box(6, 1, 8, 3))
    capacity = spark.createDataFrame([("b1", 10.0, True, True), ("b2", 30.0, True, True)], "id string, capacity double, vintage_ok boolean, licensed boolean")
    got = rows(crosswalk.capacity_weights(source, targets, pairs, buildings, capacity), "target_id", "weight", "area_difference")
    assert got == [("l", pytest.approx(0.25), pytest.approx(-0.25)), ("r", pytest.approx(0.75), pytest.approx(0.25))]
    with pytest.raises(Exception, match="licence"):
        crosswalk.capacity_weights(source, targets, pairs, buildings, capacity.withColumn("licensed", F.lit(False))).collect()
    with pytest.raises(Exception, match="do not cover"):
        crosswalk.capacity_weights(source, targets.filter("id = 'l'"), pairs.filter("target_id = 'l'"), buildings, capacity).collect()


def test_containment_ratio(spark):
    sections, parent = shapes(spark, s=box(0, 0, 10, 10), t=box(20, 0, 30, 10)), shapes(spark, p=box(0, 0, 9, 10))
    declared = spark.createDataFrame([("s", "p"), ("t", "q")], "section_id string, parent_id string")
    stock = spark.createDataFrame([("s", 7)], "section_id string, population bigint")
    got = {r.section_id: r for r in parents.containment(sections, parent, declared, stock).collect()}
    assert got["s"].outside_area_ratio == pytest.approx(0.1) and got["s"].status == "outside_declared_parent" and got["s"].known_population == 7
    assert got["t"].status == "missing_parent" and got["t"].outside_area_ratio is None


def test_components_of_chains_stars_and_lone_nodes(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(200)]
    edges = spark.createDataFrame([*chain, *star, ("p", "q"), ("q", "p"), ("p", "p")], "src string, dst string")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().unionByName(spark.createDataFrame([("alone",)], "node string"))
    got = dict(rows(graph.components(edges, nodes), "node", "component"))
    assert {got[n] for n in got if n.startswith("n")} == {"n000"}
    assert {got[n] for n in got if n.startswith(("hub", "leaf"))} == {"hub"}
    assert got["q"] == "p" and got["alone"] == "alone" and len(got) == 61 + 201 + 2 + 1


def test_row_numbers_on_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    got = ordering.row_numbers(df, ["g"], [F.col("v")], buckets=16)
    for g in ("hot", "cold"):
        want = sorted(r.v for r in df.filter(F.col("g") == g).collect())
        assert [r.v for r in got.filter(F.col("g") == g).orderBy("row_number").collect()] == want


def test_running_sum_over_blocks_and_order_statistic(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("pos"), (F.col("id") % 13).alias("v"))
    total, out = 0, {r.pos: r.sum_v for r in ordering.running_sum(df, ["g"], "pos", ["v"], block=64).collect()}
    for i in range(1000):
        total += i % 13
        assert out[i] == total
    for n in (1, 10, 20, 21, 100):
        small = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
        assert ordering.order_statistic(small, ["g"], "v", 0.95).head().v == math.floor((n - 1) * 0.95)


def test_geojson_file_to_vertices(spark, tmp_path):
    text = ('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"area_id":"a"},"geometry":{"type":"Polygon",'
            '"coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},{"type":"Feature","properties":{"area_id":"m"},"geometry":{"type":"MultiPolygon",'
            '"coordinates":[[[[5,5],[6,5],[6,6],[5,6],[5,5]]],[[[8,8],[9,8],[9,9],[8,9],[8,8]]]]}}]}')
    (tmp_path / "layer.geojson").write_text(text)
    features = layers.read_geojson(spark, str(tmp_path / "layer.geojson"))
    layer = layers.checked_layer(features, "area_id")
    assert {r.id: r.area for r in polygons.areas(layer).collect()} == {"a": 1.0, "m": 2.0}
    lines = {r.id: r.feature for r in layers.collection(layer).collect()}
    assert '"MultiPolygon"' in lines["m"] and '"Polygon"' in lines["a"]
    with pytest.raises(Exception, match="only polygons"):
        layers.vertices(features.withColumn("kind", F.lit("Point")), "area_id").collect()
    with pytest.raises(Exception, match="duplicate key"):
        layers.checked_layer(features.unionByName(features), "area_id")


def random_boxes(rng, n, scale, clustered):
    out = []
    for k in range(n):
        far = 1.0 if not clustered or rng.random() < 0.3 else 0.01
        x, y = rng.random() * scale * far, rng.random() * scale * far
        size = scale / math.sqrt(n) * far * rng.random() * (30 if k % 500 == 0 else 1)
        out.append((f"i{k}", x, y, x + size, y + size * rng.random()))
    return out


@pytest.mark.parametrize("scale, clustered", [(100_000.0, False), (1.0, False), (1e-3, True)])
def test_overlap_keys_stay_small_in_any_unit(spark, scale, clustered):
    rng = random.Random(5)
    boxes = spark.createDataFrame(random_boxes(rng, 20_000, scale, clustered), "id string, x0 double, y0 double, x1 double, y1 double")
    partition = spatial.learn(*spatial._sampled(boxes, boxes, ("x", "y")), 2)
    dealt = spatial.deal(boxes, ("x", "y"), partition)
    largest = dealt.groupBy("_part_0", "_part_1", "_cell_0", "_cell_1").count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).head()
    assert largest.most <= 200 and largest.rows < 4 * 20_000


def test_overlap_join_of_many_boxes_equals_brute_force(spark):
    for scale, clustered in ((1000.0, False), (1e-3, True)):
        boxes = random_boxes(random.Random(8), 2500, scale, clustered) + [("same", 0.1 * scale, 0.1 * scale, 0.2 * scale, 0.2 * scale)] * 40
        df = spark.createDataFrame(boxes, "id string, x0 double, y0 double, x1 double, y1 double")
        holes = df.unionByName(spark.createDataFrame([("none", None, 0.0, 1.0, 1.0)], df.schema))
        got = spatial.overlap_join(df, holes, []).groupBy("l_id", "r_id").count().collect()
        import duckdb

        plain = duckdb.connect()
        plain.register("b", df.toPandas())
        expected = plain.execute("select a.id, b.id, count(*) from b a join b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1 group by all").fetchall()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_interval_join_with_keys_equals_brute_force(spark):
    rng = random.Random(2)
    rows_ = [(rng.choice("aaaab"), n, x := rng.random() * 50, x + rng.random() ** 4 * 20) for n in range(3000)]
    df = spark.createDataFrame(rows_, "k string, n int, x0 double, x1 double")
    got = spatial.overlap_join(df, df, ["k"], ("x",)).groupBy("l_n").count().collect()
    starts, ends = ({k: sorted(r[c] for r in rows_ if r[0] == k) for k in "ab"} for c in (2, 3))
    expected = {n: bisect.bisect_right(starts[k], b) - bisect.bisect_left(ends[k], a) for k, n, a, b in rows_}
    assert dict(map(tuple, got)) == expected


def test_dissolve_with_t_junctions_holes_and_touching_corners(spark, tmp_path):
    layer = shapes(
        spark, a=box(0, 0, 10, 10), b=box(10, 0, 20, 5), c=list(reversed(box(10, 5, 20, 10))),
        d=[box(100, 0, 110, 10), box(103, 3, 107, 7)], e=box(110, 2, 120, 8), h=[box(104, 4, 106, 6), box(104.5, 4.5, 105, 5)],
        f=box(200, 0, 201, 1), g=box(201, 1, 202, 2), s=[(300, 0), (306, 3), (300, 3)], t=[(302, 1), (306, 1), (306, 3)])
    groups = spark.createDataFrame([(x, z) for z, xs in {"z1": "abc", "z2": "deh", "z3": "fg", "z4": "st"}.items() for x in xs], "id string, group_id string")
    made = dissolve.polygons_of(dissolve.rings(dissolve.outline(layer, groups)))
    points = {}
    for r in made.orderBy("seq").collect():
        points.setdefault((r.id, r.part, r.ring), []).append((r.x, r.y))
    assert all(p[0] == p[-1] and len(set(p)) == len(p) - 1 for p in points.values())
    assert points["z1", 0, 0] == [(0, 0), (10, 0), (20, 0), (20, 5), (20, 10), (10, 10), (0, 10), (0, 0)] and len([k for k in points if k[0] == "z1"]) == 1
    shells = {k: v for k, v in points.items() if k[0] == "z2"}
    assert sorted(len(v) for v in shells.values()) == [5, 5, 5, 9]
    of = {v[0]: k for k, v in shells.items()}  # by the first vertex, the lowest of its ring
    assert of[103, 3][1] == of[100, 0][1] and of[104.5, 4.5][1] == of[104, 4][1] and of[100, 0][2] == of[104, 4][2] == 0 < of[103, 3][2]
    assert sorted(len(v) for k, v in points.items() if k[0] == "z3") == [5, 5]  # touching corners are two rings
    assert {r.id: round(r.area, 9) for r in polygons.areas(made).collect()} == {"z1": 200.0, "z2": 100 - 16 + 60 + 4 - 0.25, "z3": 2.0, "z4": 9 + 4.0}
    assert polygons.validity(made).filter("not valid").isEmpty()

    walk = spark.createDataFrame([("z1", "new", "a", 1.0)], "zone_id string, vintage string, source_id string, weight double")
    sinks.write_zones(made, walk, str(tmp_path), version="7", crs="EPSG:4326")
    named, back = sinks.read_zones(spark, str(tmp_path))
    assert rows(named, "zone_id", "crs", "version") == [(z, "EPSG:4326", "7") for z in ("z1", "z2", "z3", "z4")]
    assert rows(back, "id", "part", "ring", "seq", "x", "y") == rows(made, "id", "part", "ring", "seq", "x", "y")


def test_long_rings_are_ranked_and_zones_fall_back_to_the_old_layer(spark):
    old, new = shapes(spark, gone=box(0, 0, 1, 1), kept=box(5, 0, 6, 1)), shapes(spark, kept=circle(9, 9, 2, 700), half=box(20, 0, 21, 1))
    walk = spark.createDataFrame([("z1", "old", "gone"), ("z2", "old", "kept"), ("z2", "new", "kept"), ("z2", "new", "half")], "zone_id string, vintage string, source_id string")
    made = dissolve.zone_polygons(walk, old, new)
    assert {r.id: (r.n, r.parts) for r in made.groupBy("id").agg(F.count("x").alias("n"), F.countDistinct("part").alias("parts")).collect()} == {"z1": (5, 1), "z2": (706, 2)}
    assert sorted(round(r.area, 6) for r in polygons.areas(made).collect()) == [1.0, round(polygons.areas(new).agg(F.sum("area")).head()[0], 6)]
