"""Outlines of groups of polygons: shared borders go, and what is left is put together to closed rings.

Borders need not share whole edges: every vertex of a group that lies on another member's edge splits that edge, so that two
members side by side have the same pieces in opposite directions, which cancel. Rings are found by list ranking: every piece
knows its successor, and pointers of doubling length tell each piece the first piece of its ring and the way there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort.operators import polygons
from cohort.operators.spatial import overlap_join
from cohort.operators.staging import stage

TOLERANCE = 1e-9  # of an edge's length: how far beside the edge a vertex may lie that splits it

_PIECE = ("xa", "ya", "xb", "yb")


def _directed(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of the members with the inside on their left, ``group_id, edge, xa, ya, xb, yb``."""
    e = polygons.edges(layer).filter("xa <> xb or ya <> yb")
    e = e.join(groups.select("id", "group_id"), "id").join(polygons.ring_signs(layer), list(polygons.RING))
    # The sign of a ring is that of the area under its edges, from left to right: minus one if they go round counterclockwise.
    keep = F.col("sign") < 0
    ends = [F.when(keep, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_PIECE, ("xb", "yb", "xa", "ya"), strict=True)]
    return e.select("group_id", F.struct(*polygons.RING, "seq").alias("edge"), *ends)


def noded(edges: DataFrame) -> DataFrame:
    """The edges cut at every vertex of their group that lies on them, ``group_id, xa, ya, xb, yb``."""
    low, high = [F.least(f"{a}a", f"{a}b").alias(f"{a}0") for a in "xy"], [F.greatest(f"{a}a", f"{a}b").alias(f"{a}1") for a in "xy"]
    edges = stage(edges)
    boxes = edges.select("*", *low, *high)
    points = stage(edges.select("group_id", F.col("xa").alias("x0"), F.col("ya").alias("y0")).distinct()).withColumns({"x1": F.col("x0"), "y1": F.col("y0")})
    met = overlap_join(boxes, points, ["group_id"])
    dx, dy = F.col("l_xb") - F.col("l_xa"), F.col("l_yb") - F.col("l_ya")
    px, py = F.col("r_x0") - F.col("l_xa"), F.col("r_y0") - F.col("l_ya")
    size = dx * dx + dy * dy
    along, beside = (px * dx + py * dy) / size, (px * dy - py * dx) / size
    inside = (along > 0) & (along < 1) & (F.abs(beside) <= TOLERANCE)
    same = ((px == 0) & (py == 0)) | ((F.col("r_x0") == F.col("l_xb")) & (F.col("r_y0") == F.col("l_yb")))
    cuts = met.filter(inside & ~same).select("l_group_id", "l_edge", along.alias("at"), F.col("r_x0").alias("x"), F.col("r_y0").alias("y")).toDF("group_id", "edge", "at", "x", "y")
    ends = edges.select("group_id", "edge", F.inline(F.array(
        F.struct(F.lit(0.0).alias("at"), F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.lit(1.0).alias("at"), F.col("xb").alias("x"), F.col("yb").alias("y")))))
    way = Window.partitionBy("group_id", "edge").orderBy("at")
    each = ends.unionByName(cuts).select("group_id", F.col("x").alias("xa"), F.col("y").alias("ya"), F.lead("x").over(way).alias("xb"), F.lead("y").over(way).alias("yb"))
    return each.filter("xb is not null")


def outline(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Directed outline of each group, the inside on the left: ``group_id, xa, ya, xb, yb``.

    Members must not overlap each other (see ``polygons.self_overlaps``); they may touch along parts of edges.
    """
    pieces = noded(_directed(polygons.prepared(layer), groups))
    forward = (F.col("xa") < F.col("xb")) | ((F.col("xa") == F.col("xb")) & (F.col("ya") < F.col("yb")))
    low = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_PIECE, ("xb", "yb", "xa", "ya"), strict=True)]
    net = pieces.select("group_id", *low, F.when(forward, 1).otherwise(-1).alias("way")).groupBy("group_id", *_PIECE).agg(F.sum("way").alias("way")).filter("way <> 0")
    turned = [F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_PIECE, ("xb", "yb", "xa", "ya"), strict=True)]
    return net.select("group_id", *turned)


def _successors(pieces: DataFrame) -> DataFrame:
    """``piece, next``. Where a ring passes a point twice, the piece that closes the inside next to this one follows."""
    ahead = pieces.select("group_id", F.col("xa").alias("xb"), F.col("ya").alias("yb"), F.col("piece").alias("next"), F.col("xb").alias("xc"), F.col("yb").alias("yc"))
    met = pieces.join(ahead, ["group_id", "xb", "yb"])

    def angle(x: Column, y: Column) -> Column:
        return F.atan2(y - F.col("yb"), x - F.col("xb"))

    clockwise = F.pmod(angle(F.col("xa"), F.col("ya")) - angle(F.col("xc"), F.col("yc")), F.lit(2 * 3.141592653589793))
    return met.groupBy("piece").agg(F.min_by("next", clockwise).alias("next"))


def rings(outlines: DataFrame) -> DataFrame:
    """Closed rings of directed outlines: ``id, part, ring, seq, x, y`` and ``hole``, with ``id`` the group.

    Every ring is a ``part`` of its own with ``ring`` 0: a shell goes round counterclockwise, a hole (``hole``) clockwise. The first
    vertex, that of the smallest piece, comes again at the end. The rounds are logarithmic in the longest ring.
    """
    pieces = stage(outlines.withColumn("piece", F.struct("group_id", *_PIECE)))
    at = stage(_successors(pieces).select("piece", "next", F.col("piece").alias("first"), F.lit(0).cast("bigint").alias("away")))
    step = 1
    while True:
        there = at.select(F.col("piece").alias("next"), F.col("next").alias("_next"), F.col("first").alias("_first"), F.col("away").alias("_away"))
        nearer = F.col("_first") < F.col("first")
        at = stage(at.join(there, "next").select(
            "piece", F.col("_next").alias("next"), F.when(nearer, F.col("_first")).otherwise(F.col("first")).alias("first"),
            F.when(nearer, F.col("_away") + step).otherwise(F.col("away")).alias("away"), (F.col("_first") == F.col("first")).alias("same")))
        step *= 2
        # A ring whose pieces all agree with their successors has one first piece.
        if at.filter("not same").isEmpty():
            break
    sizes = at.groupBy("first").agg(F.count(F.lit(1)).alias("n"), (F.sum((F.col("piece.xa") * F.col("piece.yb") - F.col("piece.xb") * F.col("piece.ya"))) < 0).alias("hole"))
    order = Window.partitionBy("id").orderBy("hole", "first")
    parts = sizes.select(F.col("first.group_id").alias("id"), "first", "n", "hole").withColumn("part", F.row_number().over(order) - 1)
    placed = at.select("piece", "first", "away").join(parts, "first").withColumn("seq", F.pmod(F.col("n") - F.col("away"), F.col("n")))
    points = placed.select("id", "part", F.lit(0).alias("ring"), "seq", F.col("piece.xa").alias("x"), F.col("piece.ya").alias("y"), "hole", "n")
    again = points.filter("seq = 0").withColumn("seq", F.col("n"))
    return points.unionByName(again).select("id", "part", "ring", F.col("seq").cast("int").alias("seq"), "x", "y", "hole")


def boundary(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """The outline's pieces without direction, the lower end first."""
    a, b = F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y"))
    ends = outline(layer, groups).select("group_id", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    return ends.select("group_id", F.col("p.x").alias("xa"), F.col("p.y").alias("ya"), F.col("q.x").alias("xb"), F.col("q.y").alias("yb"))


def polygons_of(rings_: DataFrame) -> DataFrame:
    """Vertices ``id, part, ring, seq, x, y`` of the polygons that :func:`rings` describe: each hole with the shell around it.

    A hole belongs to the smallest shell of its group that holds the middle of its first edge.
    """
    rings_ = stage(rings_)
    e = stage(polygons.edges(rings_.drop("hole")))
    boxes = polygons.boxes(e, ("id", "part")).join(rings_.filter("seq = 0").select("id", "part", "hole"), ["id", "part"])
    middle = e.filter("seq = 0").select("id", "part", ((F.col("xa") + F.col("xb")) / 2).alias("px"), ((F.col("ya") + F.col("yb")) / 2).alias("py"))
    holes = stage(boxes.filter("hole").drop("hole").join(middle, ["id", "part"]))
    shells = stage(boxes.filter("not hole").drop("hole"))
    met = overlap_join(holes, shells, ["id"]).select(F.col("l_id").alias("id"), F.col("l_part").alias("hole_part"), F.col("r_part").alias("part"), F.col("l_px").alias("px"), F.col("l_py").alias("py"))
    crossing = e.join(met, ["id", "part"]).filter("(ya <= py) <> (yb <= py) and px < xa + (py - ya) / (yb - ya) * (xb - xa)")
    around = crossing.groupBy("id", "hole_part", "part").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    size = e.groupBy("id", "part").agg(F.sum(F.col("xa") * F.col("yb") - F.col("xb") * F.col("ya")).alias("size"))
    owner = around.join(size, ["id", "part"]).groupBy("id", "hole_part").agg(F.min_by("part", F.struct("size", "part")).alias("shell"))
    order = Window.partitionBy("id", "shell").orderBy("hole_part")
    owner = owner.withColumn("at", F.row_number().over(order)).select("id", F.col("hole_part").alias("part"), "shell", "at")
    return rings_.join(owner, ["id", "part"], "left").select("id", F.coalesce("shell", "part").alias("part"), F.coalesce("at", F.lit(0)).alias("ring"), "seq", "x", "y")


def zone_polygons(crosswalk: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices of every zone of a crosswalk: the union of its new polygons, or of the old ones where it has no new one."""
    latest = crosswalk.groupBy("zone_id").agg(F.when(F.count_if(F.col("vintage") == "new") > 0, "new").otherwise("old").alias("vintage"))
    name = F.concat_ws("|", "vintage", "source_id")
    groups = crosswalk.join(latest, ["zone_id", "vintage"], "left_semi").select(name.alias("id"), F.col("zone_id").alias("group_id"))
    both = [polygons.edges(layer).withColumn("id", F.concat(F.lit(f"{vintage}|"), "id")) for vintage, layer in (("old", old), ("new", new))]
    return polygons_of(rings(outline(both[0].unionByName(both[1]), groups)))
